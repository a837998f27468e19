"""KPI aggregates E1–E8.

Each KPI is one aggregation over the (already filtered) fact. Distinct
counts are exact (``count(DISTINCT ..)``): Catalyst expands rows once per
distinct column and aggregates map-side per (column, value) before the
shuffle, so no distinct set is ever held in one task. E1/E3 first reduce the
lines to one row per (invoice, customer), so the expansion is over invoices,
not lines.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..plans.common import materialize, revenue, top_k, with_total
from .filters import date_only, date_range, end_exclusive


def _aov(rev, orders):
    return F.when(orders > 0, rev / orders).otherwise(F.lit(0.0))


def _per_invoice(df: DataFrame, *extra: str) -> DataFrame:
    """Lines reduced to one row per (extra keys, invoice, customer) with partial
    sums (map-side aggregation). Distinct counts then expand invoice-level rows,
    not fact lines (Catalyst's Expand copies every input row once per distinct
    column). NULL keys stay as their own groups, so revenue keeps every line."""
    return df.groupBy(*extra, M.INVOICE_NO, M.CUSTOMER).agg(F.sum(M.AMOUNT).alias(M.AMOUNT),
                                                            F.count(F.lit(1)).alias("__lines"))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Revenue, orders (distinct invoices), customers, average order value."""
    agg = _per_invoice(df).agg(
        revenue().alias("revenue"),
        F.count_distinct(M.INVOICE_NO).alias("orders"),
        F.count_distinct(M.CUSTOMER).alias("customers"),
    )
    return agg.withColumn("average_order_value", _aov(F.col("revenue"), F.col("orders")))


def kpi_extended(df: DataFrame) -> DataFrame:
    """E1 plus quantity, distinct items and distinct groups.

    Lines are reduced per (invoice, customer), and to the distinct (item,
    group) pairs, before anything distinct is counted."""
    q = M.qty_col(df)
    grp, item = M.dashboard_group_col(df), M.item_col(df)
    quantity = (F.sum(q) if q else F.lit(0.0)).alias("__q")
    per_invoice = df.groupBy(M.INVOICE_NO, M.CUSTOMER).agg(F.sum(M.AMOUNT).alias(M.AMOUNT), quantity)
    agg = per_invoice.agg(
        revenue().alias("revenue"),
        F.count_distinct(M.INVOICE_NO).alias("orders"),
        F.count_distinct(M.CUSTOMER).alias("customers"),
        F.coalesce(F.sum("__q"), F.lit(0.0)).cast("double").alias("quantity"),
    )
    pairs = df.select(F.col(item).alias("__i"), F.col(grp).alias("__g")).distinct()
    agg = with_total(agg, pairs.agg(F.count_distinct("__i").alias("items"), F.count_distinct("__g").alias("groups")))
    return agg.withColumn("average_order_value", _aov(F.col("revenue"), F.col("orders")))


def previous_window(start: str, end: str, aligned: bool = False) -> tuple[_dt.datetime, _dt.datetime, _dt.datetime, bool]:
    """E3 window arithmetic. Returns (prev_start, cur_start, cur_end, end_inclusive).

    Reference rule: a date-only end is moved one day on; the previous window
    ends the day before ``start`` (read as a date-only bound, i.e. up to
    ``start``) and has the current window's length, so it is one day longer.
    ``aligned=True`` gives the same length exactly.
    """
    s = _dt.datetime.fromisoformat(start.strip())
    if date_only(end):
        e, incl = end_exclusive(end), False
    else:
        e, incl = _dt.datetime.fromisoformat(end.strip()), True
    delta = e - s
    if aligned:
        prev_start = s - delta
    else:
        prev_end = s - _dt.timedelta(days=1)
        prev_start = prev_end - delta
        prev_start = _dt.datetime(prev_start.year, prev_start.month, prev_start.day)
    return prev_start, s, e, incl


def compare_previous(df: DataFrame, start: str, end: str, aligned: bool = False) -> DataFrame:
    """The 4 KPIs of [start, end] and of the previous window, one scan.

    Rows (metric, current, previous, pct); ``previous``/``pct`` are NULL when
    the previous window is empty; pct is 0 when the previous value is <= 0.
    """
    prev_start, s, e, incl = previous_window(start, end, aligned)
    d = F.col(M.DATE)
    upper = (d <= F.lit(e)) if incl else (d < F.lit(e))
    w = _per_invoice(df.where((d >= F.lit(prev_start)) & upper).withColumn("__cur", d >= F.lit(s)), "__cur")
    cur, prv = F.col("__cur"), ~F.col("__cur")
    a = w.agg(
        F.coalesce(F.sum(F.when(cur, F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("cr"),
        F.count_distinct(F.when(cur, F.col(M.INVOICE_NO))).alias("co"),
        F.count_distinct(F.when(cur, F.col(M.CUSTOMER))).alias("cc"),
        F.coalesce(F.sum(F.when(prv, F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("pr"),
        F.count_distinct(F.when(prv, F.col(M.INVOICE_NO))).alias("po"),
        F.count_distinct(F.when(prv, F.col(M.CUSTOMER))).alias("pc"),
        F.coalesce(F.sum(F.when(prv, F.col("__lines"))), F.lit(0)).alias("prows"),
    )
    return _comparison(a)


def _comparison(a: DataFrame) -> DataFrame:
    """Rows of E3 from one row of sums: revenue, orders, customers of the current (``c.``) and previous (``p.``) window."""
    a = a.withColumn("ca", _aov(F.col("cr"), F.col("co"))).withColumn("pa", _aov(F.col("pr"), F.col("po")))
    rows = a.select(F.col("prows"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("current"),
                 F.col(p).cast("double").alias("previous"))
        for name, c, p in (("revenue", "cr", "pr"), ("orders", "co", "po"),
                           ("customers", "cc", "pc"), ("average_order_value", "ca", "pa"))
    ])).alias("r")).select("prows", "r.*")
    has_prev = F.col("prows") > 0
    pct = F.round(F.when(F.col("previous") > 0,
                         (F.col("current") - F.col("previous")) / F.col("previous") * 100).otherwise(F.lit(0.0)), 1)
    return rows.select("metric", "current",
                       F.when(has_prev, F.col("previous")).alias("previous"),
                       F.when(has_prev, pct).alias("pct"))


def goals(kpi: DataFrame, revenue_target: float | None = None, orders_target: int | None = None) -> DataFrame:
    """Achievement % for the given goals (a goal <= 0 or None is skipped)."""
    parts = []
    if revenue_target is not None and revenue_target > 0:
        parts.append(F.struct(F.lit("revenue").alias("metric"), F.lit(float(revenue_target)).alias("target"),
                              F.round(F.col("revenue") / F.lit(float(revenue_target)) * 100, 1).alias("achievement_pct")))
    if orders_target is not None and orders_target > 0:
        parts.append(F.struct(F.lit("orders").alias("metric"), F.lit(float(orders_target)).alias("target"),
                              F.round(F.col("orders") / F.lit(float(orders_target)) * 100, 1).alias("achievement_pct")))
    if not parts:
        return kpi.select(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("target"),
                          F.lit(None).cast("double").alias("achievement_pct")).where(F.lit(False))
    return kpi.select(F.explode(F.array(*parts)).alias("g")).select("g.*")


def mtd_growth(df: DataFrame) -> DataFrame:
    """E5: month-to-date up to the latest date vs the same day span last month.

    The latest date is a scalar subquery; the fact is then filtered to the two
    months before anything is summed (the filter reaches the scan). The previous
    span ends one month earlier, clamped to that month's end (timestamp minus a
    month interval clamps, as the reference's fallback does).
    """
    d = F.col(M.DATE)
    mx = df.agg(F.max(M.DATE).alias("__mx"))
    first_day = F.date_trunc("month", mx.scalar() - F.expr("INTERVAL 1 MONTH"))
    b = with_total(df.where(d >= first_day.cast(df.schema[M.DATE].dataType)).select(M.DATE, M.AMOUNT), mx)
    mxc = F.col("__mx")
    cur_start = F.date_trunc("month", mxc)
    prev_end = mxc - F.expr("INTERVAL 1 MONTH")
    prev_start = F.date_trunc("month", prev_end)
    a = b.agg(
        F.coalesce(F.sum(F.when((d >= cur_start) & (d <= mxc), F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("current_mtd"),
        F.coalesce(F.sum(F.when((d >= prev_start) & (d <= prev_end), F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("previous_mtd"),
    )
    cur, prev = F.col("current_mtd"), F.col("previous_mtd")
    g = F.round(F.when(prev > 0, (cur - prev) / prev * 100).otherwise(F.lit(0.0)), 1)
    label = (F.when(prev > 0, F.format_string("%+.1f%% (MTD)", g))
              .when(cur > 0, F.lit("+100% (New)")).otherwise(F.lit("0% (MTD)")))
    return a.select(cur, prev, g.alias("growth_pct"), label.alias("label"))


def target_achievement(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of the months present in the fact vs revenue.

    The month list is a distinct of the fact's MONTH (partial distinct, then a
    semi join of the small targets table against it)."""
    months = df.select(M.MONTH).where(F.col(M.MONTH).isNotNull()).distinct()
    t = targets.join(months, M.MONTH, "left_semi").agg(
        F.coalesce(F.sum("TARGET_AMOUNT"), F.lit(0)).cast("double").alias("target"))
    rev = df.agg(revenue().alias("revenue"))
    out = with_total(rev, t)
    return out.select("revenue", "target",
                      F.when(F.col("target") > 0, F.round(F.col("revenue") / F.col("target") * 100, 1)).alias("pct"))


def monthly_vs_target(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Revenue per MONTH label left-joined to target sums per month (missing -> 0),
    ordered by time (``month_start``, never by label)."""
    from .filters import month_label_start

    m = (df.where(F.col(M.MONTH).isNotNull()).groupBy(M.MONTH).agg(revenue().alias(M.AMOUNT)))
    t = targets.groupBy(M.MONTH).agg(F.sum("TARGET_AMOUNT").cast("double").alias("TARGET_AMOUNT"))
    j = m.join(t, M.MONTH, "left").na.fill(0.0, ["TARGET_AMOUNT"])
    return j.select(F.date_format(month_label_start(F.col(M.MONTH)), "yyyy-MM-dd").alias(M.MONTH_START),
                    M.MONTH, M.AMOUNT, "TARGET_AMOUNT")


def _dashboard_sums(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """One row per month, group and customer, and one for all invoices, with sums and counts of the current and the
    previous window: one scan and one shuffle (``GROUPING SETS``), written.

    ``set`` tells what a row stands for. Lines are reduced per set before the shuffle; invoices are folded into one row
    right after it, so that what is written has a row per month, group and customer.
    """
    d = F.col(M.DATE)
    if start and end:
        prev_start, s, e, incl = previous_window(start, end)
        df = df.where((d >= F.lit(prev_start)) & ((d <= F.lit(e)) if incl else (d < F.lit(e))))
        cur = d >= F.lit(s)
    else:
        df, cur = date_range(df, start, end), F.lit(True)
    month = F.col(M.MONTH_START) if M.MONTH_START in df.columns else F.trunc(F.to_date(d), "month")
    keys = {"month": F.when(d.isNotNull(), month), "group": F.col(M.dashboard_group_col(df)),
            "customer": F.col(M.CUSTOMER), "invoice": F.col(M.INVOICE_NO)}
    lines = df.select(*[c.alias(k) for k, c in keys.items()], cur.alias("cur"), F.col(M.AMOUNT).alias("a"))
    now, before = F.col("cur"), ~F.col("cur")
    sets = lines.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.sum(F.when(now, F.col("a"))).alias("cr"), F.count(F.when(now, 1)).alias("cn"),
        F.sum(F.when(before, F.col("a"))).alias("pr"), F.count(F.when(before, 1)).alias("pn"), F.grouping_id().alias("gid"))
    alone = {(1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)): k for i, k in enumerate(keys)}
    name = F.coalesce(*[F.when(F.col("gid") == gid, F.lit(k)) for gid, k in alone.items()])
    known = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    return materialize(sets.select(name.alias("set"), "*", known.alias("known")).groupBy("set", "month", "group", "customer").agg(
        *[F.sum(c).alias(c) for c in ("cr", "cn", "pr", "pn")],
        F.count_if(F.col("known") & (F.col("cn") > 0)).alias("cd"), F.count_if(F.col("known") & (F.col("pn") > 0)).alias("pd")))


def dashboard(df: DataFrame, start: str | None = None, end: str | None = None, trend_limit: int = 36,
              material_limit: int = 10, top_customers_limit: int = 10, goal_revenue: float | None = None,
              goal_orders: int | None = None) -> dict[str, DataFrame]:
    """The dashboard's result frames, all from one pass over the fact.

    ``df`` is the fact under all filters but dates; ``start`` and ``end`` are read as A6 reads them, and with both the
    comparison takes the previous window from the same pass. The pass runs when this is called (``_dashboard_sums``);
    the frames read its rows, one per month, group and customer.
    """
    from .timeseries import trend_of

    sums = _dashboard_sums(df, start, end)
    part = F.col("set")
    over_all = part == "month"  # every line has one row of this set, also without a date
    a = sums.agg(
        *[F.coalesce(F.sum(F.when(over_all, F.col(c))), F.lit(0)).cast("double").alias(c) for c in ("cr", "pr")],
        F.coalesce(F.sum(F.when(over_all, F.col("pn"))), F.lit(0)).alias("prows"),
        *[F.coalesce(F.sum(F.when(part == k, F.col(c))), F.lit(0)).alias(to)
          for k, c, to in (("invoice", "cd", "co"), ("customer", "cd", "cc"), ("invoice", "pd", "po"), ("customer", "pd", "pc"))])

    def listed(k: str, to: str) -> DataFrame:
        return (sums.where((part == k) & F.col(k).isNotNull() & (F.col("cn") > 0))
                    .select(F.col(k).alias(to), F.coalesce(F.col("cr"), F.lit(0)).cast("double").alias(M.AMOUNT)))

    def top(k: str, to: str, n: int) -> DataFrame:
        return top_k(listed(k, to), n, F.col(M.AMOUNT).desc(), F.col(to).asc())

    out = {"summary": a.select(F.col("cr").alias("revenue"), F.col("co").alias("orders"), F.col("cc").alias("customers"),
                               _aov(F.col("cr"), F.col("co")).alias("average_order_value"))}
    if start and end:
        out["comparison"] = _comparison(a)
    if goal_revenue or goal_orders:
        out["goals"] = goals(out["summary"], goal_revenue, goal_orders)
    out["trend"] = trend_of(listed("month", M.MONTH_START), trend_limit)
    out["material_groups"] = top("group", M.dashboard_group_col(df), material_limit)
    out["top_customers"] = top("customer", M.CUSTOMER, top_customers_limit)
    return out
