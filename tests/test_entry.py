"""Driver contract: entry(), every registered query against its DuckDB twin
on the smallest tables, brute-force checks for the queries with no SQL twin,
and plan assertions."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline import catalog
from ledgerline.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = catalog.QUERIES
SQL = catalog.SQL


def test_contract_shapes(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    df = entry.entry(spark)
    assert df.columns == ["CUSTOMER_NAME", "Recency", "Frequency", "Monetary", "Segment"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(v):
    import math

    import pandas as pd

    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v.item() if hasattr(v, "item") else v


def _multiset(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


# A window with no partitionBy runs in one task. It is allowed over per-range totals of a running sum (one row per
# range) and calendar rows (months, fiscal years); any other must read the rows of a limit.
CALENDAR_OR_RANGE_KEYS = ("__rid", "month_start", "__fy")


def _bracket_groups(s):
    groups, depth, start = [], 0, None
    for i, ch in enumerate(s):
        if ch == "[":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "]":
            depth -= 1
            if depth == 0:
                groups.append(s[start:i + 1])
    return groups


def _unbounded_global_windows(plan: str):
    """Windows without a partition whose input is neither calendar-sized nor limited."""
    lines = plan.split("\n")
    found = []
    for at, line in enumerate(lines):
        m = re.search(r"\bWindow (\[.*)$", line)
        groups = _bracket_groups(m.group(1)) if m else []  # [functions], [partition columns], [order]; empty ones are left out
        if not groups or len(groups) > 2 or len(groups) == 2 and not re.search("(ASC|DESC) NULLS", groups[1]):
            continue
        key = re.search(r"windowspecdefinition\((\w+)#", line)
        key = key.group(1) if key else ""
        depth = len(re.match(r"[\s:+-]*", line).group())
        below = []
        for x in lines[at + 1:]:
            if len(re.match(r"[\s:+-]*", x).group()) <= depth:
                break
            below.append(x)
        if key not in CALENDAR_OR_RANGE_KEYS and not any(re.search("TakeOrderedAndProject|GlobalLimit", x) for x in below):
            found.append(key)
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql_twin(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = df.toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _multiset(got) == _multiset(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not _unbounded_global_windows(plan), name
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


# (date, invoice, customer, product, state, quantity, amount)
ANSWER_LINES = [
    ("2023-05-01", "1", "ANIL", "Steel Pipe", "GOA", 10.0, 100), ("2023-05-01", "1", "ANIL", "Wire", "GOA", 1.0, 50),
    ("2023-06-01", "2", "ANIL", "Wire", "KERALA", 2.0, 30), ("2024-01-05", "3", "BINA", "Wire", "GOA", 7.0, 70),
    ("2024-02-05", "4", "BINA", "Steel Pipe", "KERALA", 4.0, 400), ("2024-03-05", "5", "CHAND STORES", "Cable", "KERALA", 3.0, 5),
    ("2024-03-06", "6", "CHAND STORES", "Cable", None, 1.0, 20), (None, "7", "BINA", "Cable", "GOA", 5.0, 25),
]
# answers worked out by hand from the lines above
ANSWERS = [
    ("total sales", [("Total", 700.0)]),
    ("how many orders", [("Total", 7.0)]),
    ("quantity sold in goa", [("Total", 23.0)]),
    ("revenue for anil?", [("Total", 180.0)]),
    ("Sales of ANIL in Goa, please", [("Total", 150.0)]),
    ("orders of chand stores", [("Total", 2.0)]),
    ("revenue of steel pipe in 2024", [("Total", 400.0)]),
    ("top 2 customers", [("BINA", 495.0), ("ANIL", 180.0)]),
    ("top 99999999999 customers", [("BINA", 495.0), ("ANIL", 180.0), ("CHAND STORES", 25.0)]),
    ("top 99999999999999999999999999 states", [("KERALA", 435.0), ("GOA", 245.0)]),
    ("best products by units in kerala", [("Steel Pipe", 4.0), ("Cable", 3.0), ("Wire", 2.0)]),
    ("top 1 products for bina in 2024", [("Steel Pipe", 400.0)]),
    ("best state by invoices", [("GOA", 3.0), ("KERALA", 3.0)]),
    ("top 1 regions for wire by count", [("GOA", 2.0)]),
    ("sales of anil in 2024", [("NO DATA", None)]),
    ("top 3 items of cable for anil", [("NO DATA", None)]),
]


def test_answers_worked_out_by_hand(spark):
    from ledgerline.operators import questions as L

    rows = [(None if d is None else __import__("datetime").datetime.fromisoformat(d), i, c, p, s, q, __import__("decimal").Decimal(a))
            for d, i, c, p, s, q, a in ANSWER_LINES]
    fact = spark.createDataFrame(rows, "DATE timestamp_ntz, INVOICE_NO string, CUSTOMER_NAME string, MATERIALGROUP string, STATE string, "
                                       "QTY double, AMOUNT decimal(26,4)")
    asked = spark.createDataFrame([(str(i), q) for i, (q, _) in enumerate(ANSWERS)], "q_id string, text string")
    got: dict = {}
    for r in L.answer(asked, fact).orderBy("q_id", "rank").collect():
        got.setdefault(int(r.q_id), []).append((r.name, r.value))
    assert got == {i: a for i, (_, a) in enumerate(ANSWERS)}


def test_deep_lists_are_ranked_without_a_global_window(spark, monkeypatch):
    from ledgerline.operators import questions as L

    want = {(r.q_id, r["rank"], r.name, r.value) for r in QUERIES["l3_answer"](spark, SF_SMALL).collect()}
    monkeypatch.setattr(L, "WINDOW_K", 0)
    assert {(r.q_id, r["rank"], r.name, r.value) for r in QUERIES["l3_answer"](spark, SF_SMALL).collect()} == want


def test_ngrams_are_dealt_by_the_questions(spark, monkeypatch):
    """N-grams go to as many tasks as they ask for, and one that every question holds is not left to one of them."""
    from ledgerline.operators import questions as L
    from ledgerline.plans import common

    asked = spark.createDataFrame([(f"q{i}", f"top 3 products for Cust {i} in ASIA") for i in range(400)], "q_id string, text string")
    known = spark.createDataFrame([("asia", "STATE", "ASIA"), *((f"cust {i}", "CUSTOMER_NAME", f"Cust {i}") for i in range(400))], "key string, column string, value string")
    monkeypatch.setattr(common, "TASK_ROWS", 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = L.link_entities(asked, known)
        parts = [int(n) for n in re.findall(r"hashpartitioning\(chunk[^,]*, __salt[^,]*, (\d+)\)", _plan(links))]
        assert parts and min(parts) >= 400 * 30 // 200
        got = sorted((r.q_id, r["column"], r.value) for r in links.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(f"q{i}", "STATE", "ASIA") for i in range(400)] + [(f"q{i}", "CUSTOMER_NAME", f"Cust {i}") for i in range(400)])


def test_churn_scores_invariants(spark):
    a = QUERIES["h6_churn_scores"](spark, SF_SMALL)
    rows1 = sorted((r.CUSTOMER_NAME, r.Churn_Probability) for r in a.collect())
    assert rows1 and all(0.0 <= p <= 100.0 for _, p in rows1)
    assert all(r.Recency <= 90 for r in a.collect())
    rows2 = sorted((r.CUSTOMER_NAME, r.Churn_Probability) for r in QUERIES["h6_churn_scores"](spark, SF_SMALL).collect())
    assert rows1 == rows2  # seeded forest: deterministic


def plain_lowess(x, y, frac=2 / 3, passes=3):
    """Point by point: the nearest points by sorting distances, a weighted line by least squares."""
    import numpy as np

    n, robust, fit = len(x), np.ones(len(x)), None
    for _ in range(passes + 1):
        if fit is not None:
            s = np.median(np.abs(y - fit))
            if s <= 0:
                break
            q = np.abs(y - fit) / (6 * s)
            robust = np.where(q < 1, (1 - q**2) ** 2, 0)
        made = []
        for x0 in x:
            far = np.abs(x - x0)
            radius = np.sort(far)[min(max(int(np.ceil(frac * n)), 2), n) - 1]
            w = np.clip(1 - (far / radius) ** 3, 0, None) ** 3 * robust
            root = np.sqrt(w)
            line = np.linalg.lstsq(np.stack([root, root * (x - x0)], 1), root * y, rcond=None)[0]
            made.append(line[0])
        fit = np.array(made)
    return fit


def test_lowess_trend(spark, monkeypatch):
    """Against a point-by-point fit: curves of one to 3,300 prices, in blocks of different tasks."""
    import numpy as np

    from ledgerline.operators import pricing

    rng = np.random.default_rng(3)
    curves, rows = {}, []
    for name, n in (("one", 1), ("two", 2), ("line", 30), ("short", 45), ("long", 3300)):
        x = np.sort(rng.choice(np.arange(4 * n, dtype=float), n, replace=False))
        y = 3 * x + 1 if name == "line" else np.sin(x / n) * 50 + rng.standard_normal(n) * 5 + (rng.random(n) < 0.02) * 400
        curves[name] = (x, y)
        rows += [(name, float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "product string, PRICE_BIN double, TOTAL_QTY double, TXN_COUNT int")
    out = pricing.smooth(df)
    assert out.columns == [*df.columns, "trend"]
    got = {}
    for r in out.collect():
        got.setdefault(r["product"], []).append((r.PRICE_BIN, r.TOTAL_QTY, r.TXN_COUNT, r.trend))
    for name, (x, y) in curves.items():
        found = sorted(got[name])
        assert [(a, b, i) for a, b, i, _ in found] == list(zip(x, y, range(len(x))))
        want = y if len(x) < 3 else plain_lowess(x, y)
        assert np.allclose([t for *_, t in found], want, rtol=1e-6, atol=1e-6)


def test_lowess_work_follows_the_points(spark, monkeypatch):
    """Twice the points of a curve take no more sets of running sums, and blocks of a long curve give what the whole curve gives."""
    import numpy as np

    from ledgerline.operators import pricing

    made, plain = [], pricing._by_moments
    monkeypatch.setattr(pricing, "_by_moments", lambda *a: made.append(1) or plain(*a))
    for n in (20_000, 40_000):
        made.clear()
        x = np.arange(n, dtype=float)
        fit = pricing.lowess_pass(x, 3 * x + 1, None, 0, n, 2 / 3)
        assert np.allclose(fit, 3 * x + 1) and len(made) <= 4 * pricing.SHARES
    monkeypatch.undo()

    rng = np.random.default_rng(5)
    rows = [(p, float(a), float(rng.random() * 9 + np.sin(a / n)), 1) for p, n in (("a", 700), ("b", 40)) for a in rng.choice(np.arange(3 * n), n, replace=False)]
    df = spark.createDataFrame(rows, "product string, PRICE_BIN double, TOTAL_QTY double, TXN_COUNT int")
    whole = {(r["product"], r.PRICE_BIN): r.trend for r in pricing.smooth(df).collect()}
    monkeypatch.setattr(pricing, "WHOLE_POINTS", 100)
    parted = {(r["product"], r.PRICE_BIN): r.trend for r in pricing.smooth(df).collect()}
    assert len(whole) == len(rows) and whole.keys() == parted.keys()
    assert all(abs(whole[k] - parted[k]) < 1e-8 for k in whole)


def test_lowess_of_the_table(spark):
    out = QUERIES["i4_lowess_trend"](spark, SF_SMALL)
    assert out.where("trend IS NULL").count() == 0
    assert out.count() == QUERIES["i2_demand_curve"](spark, SF_SMALL).count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_stay_in_jvm(spark):
    d1 = QUERIES["d1_filtered_kpis"](spark, SF_SMALL)
    text = d1._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(DATE), GreaterThanOrEqual(DATE" in text or "GreaterThanOrEqual(DATE" in text
    assert "ReadSchema: struct<DATE" in text and "ITEMNAME" not in text.split("ReadSchema:")[1].split("\n")[0]
    for name in ("e1_kpi_summary", "g9_classify_categories", "h2_rfm_segments", "c18_ingest", "g12_core_tail"):
        p = _plan(QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
