"""Report operators on small hand-built facts: the edge rows of FIXTURES.md §C."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions.scalars import inr
from ledgerline.operators import customers as H
from ledgerline.operators import kpi as E
from ledgerline.operators import quality as K
from ledgerline.operators import ranking as G
from ledgerline.operators import timeseries as TS
from ledgerline.operators.filters import date_range, fy_spellings, month_label_start, preset
from ledgerline.operators.ingest import add_calendar
from ledgerline.plans.common import running_sum
from tests.conftest import rows

SCHEMA = "DATE timestamp_ntz, INVOICE_NO string, CUSTOMER_NAME string, ITEMNAME string, ITEM_NAME_GROUP string, " \
         "STATE string, CITY string, QTY double, AMOUNT decimal(26,4)"


def fact(spark, recs):
    out = []
    for r in recs:
        r = list(r) + [None] * (9 - len(r))
        if r[8] is not None:
            r[8] = Decimal(str(r[8]))
        out.append(tuple(r))
    return add_calendar(spark.createDataFrame(out, SCHEMA))


def d(y, m, day=1, h=0):
    return dt.datetime(y, m, day, h)


def test_gap_fill_vs_no_fill(spark):
    df = fact(spark, [(d(2024, 1, 5), "1", "A", "i", "g", "S", "C", 1.0, 10), (d(2024, 4, 2), "2", "A", "i", "g", "S", "C", 1.0, 20),
                      (None, "3", "A", "i", "g", "S", "C", 1.0, 99)])
    assert rows(TS.trend(df, None).orderBy("DATE")) == [("2024-01", 10.0), ("2024-02", 0.0), ("2024-03", 0.0), ("2024-04", 20.0)]
    assert [r[0] for r in TS.monthly(df).orderBy("MONTH").collect()] == ["2024-01", "2024-04"]
    assert rows(TS.trend(df, 2).orderBy("DATE")) == [("2024-03", 0.0), ("2024-04", 20.0)]


def test_previous_period_window():
    ps, s, e, incl = E.previous_window("2024-01-01", "2024-01-31")
    assert (ps, s, e, incl) == (d(2023, 11, 30), d(2024, 1, 1), d(2024, 2, 1), False)  # one day longer
    ps2, *_ = E.previous_window("2024-01-01", "2024-01-31", aligned=True)
    assert ps2 == d(2023, 12, 1)


def test_compare_previous_empty_and_zero(spark):
    df = fact(spark, [(d(2024, 1, 10), "1", "A", "i", "g", "S", "C", 1.0, 100)])
    out = {r[0]: r[1:] for r in rows(E.compare_previous(df, "2024-01-01", "2024-01-31"))}
    assert out["revenue"] == (100.0, None, None)  # previous window empty
    df2 = fact(spark, [(d(2024, 1, 10), "1", "A", "i", "g", "S", "C", 1.0, 100), (d(2023, 12, 10), "2", "A", "i", "g", "S", "C", 1.0, 0)])
    out2 = {r[0]: r[1:] for r in rows(E.compare_previous(df2, "2024-01-01", "2024-01-31"))}
    assert out2["revenue"] == (100.0, 0.0, 0.0)  # previous revenue 0 -> pct 0
    assert out2["orders"] == (1.0, 1.0, 0.0)


def test_mtd_edges(spark):
    df = fact(spark, [
        (d(2024, 3, 31), "1", "A", "i", "g", "S", "C", 1.0, 50), (d(2024, 3, 1), "2", "A", "i", "g", "S", "C", 1.0, 50),
        (d(2024, 2, 29), "3", "A", "i", "g", "S", "C", 1.0, 40), (d(2024, 2, 1), "4", "A", "i", "g", "S", "C", 1.0, 10)])
    r = E.mtd_growth(df).collect()[0]
    assert (r.current_mtd, r.previous_mtd, r.growth_pct, r.label) == (100.0, 50.0, 100.0, "+100.0% (MTD)")
    jan = fact(spark, [(d(2024, 1, 15), "1", "A", "i", "g", "S", "C", 1.0, 5)])
    r = E.mtd_growth(jan).collect()[0]
    assert (r.previous_mtd, r.label) == (0.0, "+100% (New)")


def test_top_n_others(spark):
    recs = [(d(2024, 1, 1), str(i), "A", "i", f"g{i}", "S", "C", 1.0, v) for i, v in enumerate([50, 40, 30, 0, 0])]
    df = fact(spark, recs)
    assert [r[0] for r in G.top_n_others(df, "ITEM_NAME_GROUP", 3).collect()] == ["g0", "g1", "g2"]  # rest sums to 0
    assert [r[0] for r in G.top_n_others(df, "ITEM_NAME_GROUP", 3, mode="always").collect()][-1] == "Others"
    assert len(G.top_n_others(df, "ITEM_NAME_GROUP", 5).collect()) == 5  # n groups = N: no Others
    neg = fact(spark, recs + [(d(2024, 1, 1), "9", "A", "i", "g9", "S", "C", 1.0, -20)])
    assert "Others" not in [r[0] for r in G.top_n_others(neg, "ITEM_NAME_GROUP", 3).collect()]


def test_abc_classes_at_boundaries(spark):
    recs = [(d(2024, 1, 1), str(i), "A", "i", f"g{i}", "S", "C", 1.0, v) for i, v in enumerate([80, 15, 5])]
    out = rows(G.abc_pareto(fact(spark, recs)).orderBy(F.desc("AMOUNT")), "Cumulative", "Class")
    assert out == [(80.0, "A"), (95.0, "B"), (100.0, "C")]
    one = rows(G.abc_pareto(fact(spark, recs[:1])), "Percentage", "Cumulative", "Class")
    assert one == [(100.0, 100.0, "C")]


def test_value_classes_70_90(spark):
    recs = [(d(2024, 1, 1), str(i), "A", "i", f"g{i}", "S", "C", 1.0, v) for i, v in enumerate([70, 20, 10])]
    out = rows(G.classify_categories(fact(spark, recs), "ITEM_NAME_GROUP").orderBy(F.desc("Revenue")), "Classification")
    assert out == [("High Value",), ("Medium Value",), ("Low Value",)]


def test_modal_item_ties(spark):
    recs = [(d(2024, 1, 1), "1", "A", "b", "g", "S", "C", 1.0, 1), (d(2024, 1, 1), "2", "A", "a", "g", "S", "C", 1.0, 1),
            (d(2024, 1, 1), "3", "A", None, "h", "S", "C", 1.0, 1)]
    out = dict(rows(G.group_deep_dive(fact(spark, recs)), "ITEM_NAME_GROUP", "modal_item"))
    assert out == {"g": "a", "h": "N/A"}


def test_rfm_ties_and_small(spark):
    # all customers equal: every edge equals the value -> no edge strictly below -> R=4, F=1, M=1 -> 6 Potential
    recs = [(d(2024, 1, 1), str(i), f"C{i}", "i", "g", "S", "C", 1.0, 10) for i in range(5)]
    out = {r[0]: r[1] for r in rows(H.rfm_segments(fact(spark, recs)), "CUSTOMER_NAME", "Segment")}
    assert set(out.values()) == {"Potential"}
    # 3 customers: labels need >= 4 customers
    assert H.rfm_labels(fact(spark, recs[:3])).count() == 0


def test_rank_first_bins(spark):
    # 10 customers with tied frequency 1: rank-first by name gives bins 3,2,2,3 (not ntile's 3,3,2,2)
    recs = [(d(2024, 1, 1), str(i), f"C{i:02d}", "i", "g", "S", "C", 1.0, 10 + i) for i in range(10)]
    out = [r[0] for r in H.rfm_labels(fact(spark, recs)).orderBy("CUSTOMER_NAME").select("F_Score").collect()]
    assert out == ["One-time"] * 3 + ["Rare"] * 2 + ["Frequent"] * 2 + ["Loyal"] * 3


def test_recency_whole_days(spark):
    recs = [(d(2024, 1, 2, 1), "1", "A", "i", "g", "S", "C", 1.0, 1), (d(2024, 1, 1, 23), "2", "B", "i", "g", "S", "C", 1.0, 1)]
    out = dict(rows(H.rfm_base(fact(spark, recs)), "CUSTOMER_NAME", "Recency"))
    assert out == {"A": 0, "B": 0}  # 2 hours apart: 0 elapsed days


def test_forecast_min_months(spark):
    two = fact(spark, [(d(2024, 1, 1), "1", "A", "i", "g", "S", "C", 1.0, 10), (d(2024, 2, 1), "2", "A", "i", "g", "S", "C", 1.0, 20)])
    assert TS.forecast_next_month(two).collect()[0].forecast is None
    three = fact(spark, [(d(2024, 1, 1), "1", "A", "i", "g", "S", "C", 1.0, 10), (d(2024, 2, 1), "2", "A", "i", "g", "S", "C", 1.0, 20),
                         (d(2024, 4, 1), "3", "A", "i", "g", "S", "C", 1.0, 30)])  # March missing: index counts present months
    r = TS.forecast_next_month(three).collect()[0]
    assert (r.months, round(r.slope, 9), round(r.forecast, 9)) == (3, 10.0, 40.0)


def test_health_caps_and_empty(spark):
    recs = [(None, "1", "A", "i", "g", "S", "C", 1.0, -1)] * 4
    r = K.health(fact(spark, recs)).collect()[0]
    assert (r.total_rows, r.missing_dates, r.repeat_invoice_rows, r.negative_amounts) == (4, 4, 3, 4)
    assert (r.score, r.status) == (0.0, "poor")
    e = K.health(fact(spark, []).where(F.lit(False))).collect()[0]
    assert (e.total_rows, e.score, e.status) == (0, 0.0, "no_data")
    nodate = K.health(spark.createDataFrame([("1", Decimal(1))], "INVOICE_NO string, AMOUNT decimal(26,4)")).collect()[0]
    assert nodate.missing_dates == 1


def test_anomaly_flags(spark):
    recs = [(d(2024, 1, 1), "1", "A", "i", "g", "unknown", "X", 1.0, 0), (d(2024, 1, 1), "2", "A", "i", "g", "S", "City Not Found", 1.0, 5),
            (d(2024, 1, 1), "3", "A", "i", "g", "S", "X", 1.0, None), (d(2024, 1, 1), "4", "A", "i", "g", "unknown", "X", 1.0, 3),
            (d(2024, 1, 1), "5", "A", "i", "g", "S", "X", 1.0, -1)]
    out = [r[0] for r in K.with_anomaly_flag(fact(spark, recs)).select("Anomaly_Flag").collect()]
    assert out == ["Zero/Negative Amount", "Missing Location Data", "Clean", "Missing Location Data", "Zero/Negative Amount"]


def test_currency_text(spark):
    vals = [999, 1000, 99999, 100000, 10000000, -5000, 0, None, 15000000]
    df = spark.createDataFrame([(Decimal(v) if v is not None else None,) for v in vals], "v decimal(26,4)")
    out = [r[0] for r in df.select(inr(F.col("v"))).collect()]
    assert out == ["₹ 999", "₹ 1.00 K", "₹ 100.00 K", "₹ 1.00 L", "₹ 1.00 Cr", "₹ -5,000", "₹ 0", None, "₹ 1.50 Cr"]


def test_filter_helpers(spark):
    assert fy_spellings(["FY25-26", " 24-25 ", ""]) == ["24-25", "25-26", "FY24-25", "FY25-26"]
    assert preset("ytd", "2024-03-05") == ("2024-01-01", "2024-03-05")
    assert preset("last_7_days", "2024-03-05") == ("2024-02-27", "2024-03-05")
    assert preset("all", "2024-03-05") == (None, None)
    df = spark.createDataFrame([("APR-24",), ("Apr-92",), ("bad",), ("JAN-69",)], "m string")
    out = [r[0] for r in df.select(month_label_start(F.col("m"))).collect()]
    assert out == [dt.date(2024, 4, 1), dt.date(1992, 4, 1), None, dt.date(1969, 1, 1)]


def test_drop_alerts_threshold(spark):
    recs = [(d(2024, 1, 10), "1", "A", "i", "g", "S", "C", 1.0, 80), (d(2023, 12, 10), "2", "A", "i", "g", "S", "C", 1.0, 100),
            (d(2024, 1, 10), "3", "B", "i", "g", "S", "C", 1.0, 50), (d(2023, 12, 10), "4", "C", "i", "g", "S", "C", 1.0, 100)]
    out = rows(H.revenue_drops(fact(spark, recs), "2024-01-01", "2024-01-31"), "entity", "change_pct")
    assert out == [("A", -20.0)]  # exactly at threshold is an alert; one-period customers are not


def test_zero_totals_do_not_raise(spark):
    """Revenue netting to zero (a refund line) must give NULL shares, not a divide-by-zero error."""
    recs = [(d(2024, 1, 1), "1", "A", "i", "g", "S", "C", 1.0, 5), (d(2024, 1, 2), "2", "A", "i", "g", "S", "C", 1.0, -5)]
    df = fact(spark, recs)
    assert rows(G.abc_pareto(df), "Percentage", "Cumulative") == [(None, None)]
    assert rows(G.classify_categories(df, "ITEM_NAME_GROUP"), "Share") == [(None,)]
    assert rows(G.core_tail(df), "core_count", "tail_count") == [(0, 0)]  # NaN share: neither side, as in pandas
    assert rows(G.contribution(df), "pct") == [(None,)]
    assert G.pareto(df).count() == 1


def test_drop_alerts_default_window(spark):
    # no dates given: the window is the data's first..last date (last day whole), previous one before it
    recs = [(d(2024, 1, 10), "1", "A", "i", "g", "S", "C", 1.0, 80), (d(2024, 1, 31), "2", "A", "i", "g", "S", "C", 1.0, 0),
            (d(2023, 12, 10), "3", "A", "i", "g", "S", "C", 1.0, 100)]
    df = fact(spark, recs).where(F.col("DATE") >= F.lit("2024-01-01").cast("timestamp"))
    assert H.revenue_drops(df).count() == 0  # nothing before the data's own start
    # end defaults to the last date (Jan 31): current 80 vs previous (Nov 30 .. Dec 31) 100 -> -20 %
    assert rows(H.revenue_drops(fact(spark, recs), "2024-01-01"), "entity", "change_pct") == [("A", -20.0)]


def test_entity_linking_edges(spark):
    from ledgerline.operators import questions as Q

    f = spark.createDataFrame(
        [("GOA", "Goa", "WIDGET"), ("KERALA", "Big Red Cat Co", "GEAR"), ("KERALA", "Red", "GEAR")],
        "STATE string, CUSTOMER_NAME string, MATERIALGROUP string")
    qs = spark.createDataFrame([
        ("q1", "total for big red cat co?"),     # four-word name wins over the one-word "red"
        ("q2", "top 3 in goa in 2025"),          # "goa" is a state and a customer: the later index (customer) wins
        ("q3", "how are we doing"),              # no entity
        ("q4", "Gear sales in kerala, 2031!"),   # edge punctuation stripped; year token
    ], "q_id string, text string")
    got = sorted((r.q_id, r.column, r.value) for r in Q.link_entities(qs, Q.dictionary(f)).collect())
    assert got == [("q1", "CUSTOMER_NAME", "Big Red Cat Co"), ("q2", "CUSTOMER_NAME", "Goa"), ("q2", "YEAR", "2025"),
                   ("q4", "PRODUCT", "GEAR"), ("q4", "STATE", "KERALA"), ("q4", "YEAR", "2031")]
    intents = {r.q_id: (r.metric, r.shape, r.k) for r in Q.parse_intent(qs).collect()}
    assert intents["q2"] == ("AMOUNT", "top", 3) and intents["q3"] == ("AMOUNT", "total", None)


DASHBOARD_RECS = [
    (d(2024, 1, 3), "1", "A", "i", "g", "S", "C", 1.0, 80), (d(2024, 1, 3), "1", "B", "j", None, "S", "C", 1.0, "0.1"),
    (d(2024, 1, 31, 23), "2", "A", "i", "h", "S", "C", 1.0, None), (d(2024, 1, 9), None, None, "i", "g", "S", "C", 1.0, 7),
    (d(2023, 12, 10), "2", "C", "i", "g", "S", "C", 1.0, 100), (d(2023, 12, 1), "3", "C", "i", "g", "S", "C", 1.0, -3),
    (None, "4", "A", "i", "g", "S", "C", 1.0, 50), (d(2023, 10, 1), "5", "D", "i", "k", "S", "C", 1.0, 9)]


def _frames_one_by_one(df, start, end):
    cur = date_range(df, start, end)
    out = {"summary": E.kpi_summary(cur), "goals": E.goals(E.kpi_summary(cur), 100.0, 4), "trend": TS.trend(cur),
           "material_groups": G.top_n(cur, "ITEM_NAME_GROUP"), "top_customers": G.top_n(cur, "CUSTOMER_NAME")}
    if start and end:
        out["comparison"] = E.compare_previous(df, start, end)
    return out


def test_dashboard_frames_equal_their_own_reports(spark):
    """NULL dates, invoices, customers, groups and amounts; date-only and exact ends; no bound; windows without rows."""
    df = fact(spark, DASHBOARD_RECS)
    for start, end in (("2024-01-01", "2024-01-31"), ("2024-01-01", "2024-01-31T23:00:00"), (None, None), ("2023-12-01", None),
                       (None, "2024-01-09"), ("2030-01-01", "2030-01-31"), ("2023-10-01", "2023-10-02")):
        got = E.dashboard(df, start, end, goal_revenue=100.0, goal_orders=4)
        want = _frames_one_by_one(df, start, end)
        assert got.keys() == want.keys()
        for name, frame in want.items():
            assert got[name].columns == frame.columns and rows(got[name]) == rows(frame), (name, start, end)


def test_dashboard_reads_the_fact_once(spark):
    """No frame reads the fact: the pass that feeds them has run when they are returned."""
    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    df = T.sales(spark, SF_SMALL)
    got = E.dashboard(df, "1997-04-01", "1998-03-31", goal_revenue=1e6, goal_orders=10)
    want = _frames_one_by_one(df, "1997-04-01", "1998-03-31")
    for name, frame in got.items():
        assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString(), name
        if name != "goals":
            assert rows(frame) == rows(want[name]), name


def test_core_tail_splits_large_entities(spark, monkeypatch):
    """A customer with a third of all pairs, many of one value, is dealt to several ranges with the same result."""
    recs = [(d(2024, 1, 1), "1", "hot", f"i{i:03d}", "g", "S", "C", 1.0, 10 if i % 3 else i) for i in range(120)]
    recs += [(d(2024, 1, 1), "2", f"c{i % 24}", f"i{i:03d}", "g", "S", "C", 1.0, i) for i in range(240)]
    recs += [(d(2024, 1, 1), "3", "zero", "a", "g", "S", "C", 1.0, 5), (d(2024, 1, 1), "3", "zero", "b", "g", "S", "C", 1.0, -5)]
    df = fact(spark, recs)
    want = sorted(map(str, rows(G.core_tail(df))))
    dealt = []

    def spied(g, *args, **kw):
        out = running_sum(g, *args, ranges=4, **kw)
        parts = g.repartitionByRange(4, F.col("CUSTOMER_NAME"), F.col("__s").desc(), F.col("ITEMNAME"))
        dealt.append((sorted({r[0] for r in g.select("CUSTOMER_NAME").collect()}), parts.select(F.spark_partition_id()).distinct().count()))
        return out

    monkeypatch.setattr(G, "running_sum", spied)
    assert sorted(map(str, rows(G.core_tail(df, split=100)))) == want
    assert dealt == [(["hot"], 4)]
    assert sorted(map(str, rows(G.core_tail(df, split=1)))) == want  # every entity by ranges
    assert G.core_tail(df.where(F.lit(False))).count() == 0
