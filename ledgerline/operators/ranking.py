"""Ranking, share, Pareto and breakdown reports G1–G24.

Pattern: aggregate to one row per entity (partial aggregation before the
shuffle), then rank. Top-k is ``orderBy().limit()`` (TakeOrderedAndProject:
per-partition heaps, no full sort). Shares divide by a 1-row total joined by
broadcast. Cumulative shares use the bucketed running sum of
``plans.common.running_sum`` so a large entity set (customers, items) is never
ordered in a single task. Cumulative values are computed from exact decimal
running sums and one division, so they do not depend on summation order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..fixed_values import CRORE
from ..plans.common import keyed, materialize, revenue, running_sum, top_k, with_total


def _by(df: DataFrame, dim: str, *aggs: Column) -> DataFrame:
    return keyed(df, dim).groupBy(dim).agg(*aggs)


def _desc(value: str, key: str) -> list[Column]:
    return [F.col(value).desc(), F.col(key).asc()]


def _total(df: DataFrame, value: str, name: str = "__total") -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 (ANSI mode raises on a zero divisor)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _share(value: str, total: str = "__total", dp: int | None = 1) -> Column:
    s = _ratio(F.col(value), F.col(total)) * 100
    return F.round(s, dp) if dp is not None else s


# ---------------------------------------------------------------- G1, G2
def top_n(df: DataFrame, dim: str, n: int | None = 10, value: str = M.AMOUNT) -> DataFrame:
    """G1: top ``n`` of ``dim`` by summed ``value`` (ties by key)."""
    g = _by(df, dim, revenue(value).alias(value))
    return top_k(g, n, *_desc(value, dim))


def top_n_others(df: DataFrame, dim: str, n: int = 10, mode: str = "positive") -> DataFrame:
    """Top ``n`` plus one "Others" row with the rest.

    ``mode='positive'``: Others only when there are more than n groups and the
    rest is > 0; ``'always'``: whenever there are more than n groups.
    The rest is total minus the top sum (two 1-row aggregates), not a
    ranking of all groups.
    """
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    top = top_k(g, n, *_desc("__v", dim))
    stats = g.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("__v"), F.lit(0)).alias("__all"))
    topsum = top.agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__top"))
    rest = with_total(stats, topsum).select(
        F.lit("Others").alias("label"), (F.col("__all") - F.col("__top")).alias("__v"), F.col("__n"))
    cond = F.col("__n") > n
    if mode == "positive":
        cond = cond & (F.col("__v") > 0)
    rest = rest.where(cond).select("label", F.col("__v").cast("double").alias(M.AMOUNT))
    return top.select(F.col(dim).cast("string").alias("label"), F.col("__v").cast("double").alias(M.AMOUNT)).unionByName(rest)


# ---------------------------------------------------------------- G3, G4
def state_scorecard(df: DataFrame) -> DataFrame:
    """Per state revenue, orders, customers, market share (1 dp) and
    revenue in crore (2 dp); placeholder ("NOT FOUND") states removed first."""
    d = df.where(~F.coalesce(F.upper(F.col(M.STATE)).contains("NOT FOUND"), F.lit(False)))
    g = _by(d, M.STATE, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__rev"),
            F.count_distinct(M.INVOICE_NO).alias("Orders"), F.count_distinct(M.CUSTOMER).alias("Customers"))
    g = materialize(g)  # one row per state: read by the shares and by their total
    t = with_total(g, _total(g, "__rev"))
    share = F.when(F.col("__total") > 0, _share("__rev")).otherwise(F.lit(0.0))
    crore = F.round(F.col("__rev") / F.lit(Decimal(CRORE)), 2).cast("double")
    return t.select(M.STATE, F.col("__rev").cast("double").alias("Revenue"), "Orders", "Customers",
                    share.alias("MarketShare"), crore.alias("Revenue_Cr"))


def city_scorecard(df: DataFrame, n: int = 20) -> DataFrame:
    """Top cities (CITY, else STATE) by revenue with distinct customers."""
    col = M.city_col(df)
    g = _by(df, col, revenue().alias("Revenue"), F.count_distinct(M.CUSTOMER).alias("Customers"))
    return top_k(g, n, *_desc("Revenue", col))


# ---------------------------------------------------------------- G5–G7
def _cum_rounded_share(g: DataFrame, key: str, value: str, share_name: str, cum_name: str) -> DataFrame:
    """Share rounded to 1 dp, then the running sum of the *rounded* shares
    (exact in decimal(.,1); the last value need not be 100)."""
    g = materialize(g)  # one row per group: the total reads it too
    t = with_total(g, _total(g, value))
    t = t.withColumn(share_name, _share(value)).withColumn("__sd", F.col(share_name).cast("decimal(9,1)"))
    r = running_sum(t, value, key, "__sd", "__cum")
    return r.withColumn(cum_name, F.round(F.col("__cum"), 1).cast("double")).drop("__sd", "__cum", "__total")


def group_performance(df: DataFrame) -> DataFrame:
    """Per group revenue, orders, customers, mean line amount, share and
    cumulative share of the rounded shares."""
    grp = M.dashboard_group_col(df)
    g = _by(df, grp, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__rev"),
            F.count_distinct(M.INVOICE_NO).alias("Orders"), F.count_distinct(M.CUSTOMER).alias("Customers"),
            (F.sum(M.AMOUNT).cast("double") / F.count(M.AMOUNT)).alias("AvgPrice"))
    r = _cum_rounded_share(g, grp, "__rev", "Share", "CumulativeShare")
    return r.select(grp, F.col("__rev").cast("double").alias("Revenue"), "Orders", "Customers", "AvgPrice",
                    "Share", "CumulativeShare")


def abc_pareto(df: DataFrame) -> DataFrame:
    """ABC classes on the cumulative rounded share: A <= 80, B <= 95, else C."""
    grp = M.dashboard_group_col(df)
    g = _by(df, grp, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__rev"))
    r = _cum_rounded_share(g, grp, "__rev", "Percentage", "Cumulative")
    cls = F.when(F.col("Cumulative") <= 80, "A").when(F.col("Cumulative") <= 95, "B").otherwise("C")
    return r.select(grp, F.col("__rev").cast("double").alias(M.AMOUNT), "Percentage", "Cumulative", cls.alias("Class"))


def class_counts(pareto: DataFrame) -> DataFrame:
    """Number of groups per ABC class."""
    return pareto.groupBy("Class").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- G8–G12
def pareto(df: DataFrame, dim: str = M.CUSTOMER, n: int = 50) -> DataFrame:
    """The top ``n`` entities with their unrounded cumulative % of revenue.

    The cumulative % of the first n rows needs only those rows and the total:
    a TakeOrdered of n rows, a window over those n rows, and a 1-row total.
    """
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    top = top_k(g, n, *_desc("__v", dim))
    w = Window.orderBy(F.col("__v").desc(), F.col(dim).asc()).rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("__cum", F.sum("__v").over(w))  # n rows
    t = with_total(top, _total(g, "__v"))
    return t.select(dim, F.col("__v").cast("double").alias(M.AMOUNT),
                    (_ratio(F.col("__cum"), F.col("__total")) * 100).alias("cum_percent"))


def top_share(df: DataFrame, dim: str = M.CUSTOMER, frac: float = 0.2) -> DataFrame:
    """Revenue share of the top ``int(frac * n)`` entities (n = entity count).

    The rank is a bucketed running count, so this scales to any entity count.
    """
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    stats = g.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("__v"), F.lit(0)).alias("__total"))
    r = running_sum(g, "__v", dim, None, "__rank")
    k = F.floor(F.col("__n") * F.lit(frac))
    top = with_total(r, stats).where(F.col("__rank") <= k).agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__top"))
    out = with_total(stats, top)
    return out.select(F.col("__n").alias("entities"), F.floor(F.col("__n") * F.lit(frac)).cast("bigint").alias("top_count"),
                      F.col("__top").cast("double").alias("top_revenue"),
                      F.when(F.col("__total") != 0, F.col("__top").cast("double") / F.col("__total").cast("double") * 100)
                       .alias("share_pct"))


def _value_classes(df: DataFrame, grp: str) -> DataFrame:
    g = _by(df, grp, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__rev"),
            F.count_distinct(M.INVOICE_NO).alias("Orders"))
    g = materialize(g)  # one row per group: the total reads it too
    t = with_total(g, _total(g, "__rev"))
    r = running_sum(t, "__rev", grp, "__rev", "__cum")
    share = _ratio(F.col("__rev"), F.col("__total")) * 100
    cum = _ratio(F.col("__cum"), F.col("__total")) * 100
    cls = F.when(cum <= 70, "High Value").when(cum <= 90, "Medium Value").otherwise("Low Value")
    return r.select(grp, F.col("__rev").cast("double").alias("Revenue"), "Orders", share.alias("Share"),
                    cum.alias("CumShare"), cls.alias("Classification"))


def classify_categories(df: DataFrame, grp: str = M.ITEM_GROUP) -> DataFrame:
    """70/20/10 value classes on the unrounded cumulative share."""
    return _value_classes(df, grp)


def consolidation_candidates(df: DataFrame, grp: str = M.ITEM_GROUP) -> DataFrame:
    """Low/Medium value groups with more orders than the mean, with AOV."""
    c = materialize(_value_classes(df, grp))
    avg = c.agg((F.sum("Orders").cast("double") / F.count(F.lit(1))).alias("__avg_orders"))
    t = with_total(c, avg)
    return (t.where(F.col("Classification").isin("Low Value", "Medium Value") & (F.col("Orders") > F.col("__avg_orders")))
             .withColumn("Avg_Order_Value", _ratio(F.col("Revenue"), F.col("Orders"))).drop("__avg_orders"))


def consolidation_zone(df: DataFrame, grp: str = M.ITEM_GROUP, n: int = 10) -> DataFrame:
    """Revenue > 0, orders above the mean and AOV below the mean AOV; top n by orders."""
    g = _by(df, grp, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).cast("double").alias("Revenue"),
            F.count_distinct(M.INVOICE_NO).alias("Orders"))
    g = g.withColumn("AOV", _ratio(F.col("Revenue"), F.col("Orders"))).where(F.col("Revenue") > 0)
    avg = g.agg((F.sum("Orders").cast("double") / F.count(F.lit(1))).alias("__ao"),
                (F.sum("AOV") / F.count(F.lit(1))).alias("__av"))
    t = with_total(g, avg).where((F.col("Orders") > F.col("__ao")) & (F.col("AOV") < F.col("__av")))
    return top_k(t.select(grp, "Revenue", "Orders", "AOV"), n, *_desc("Orders", grp))


def _running_by_entity(g: DataFrame, entity: str, item: str) -> DataFrame:
    """Running sum and total of ``__s`` per entity by a window per entity."""
    whole = Window.partitionBy(entity)
    running = whole.orderBy(F.col("__s").desc(), F.col(item).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("__cum", F.sum("__s").over(running)).withColumn("__et", F.sum("__s").over(whole))


SPLIT_ITEMS = 100_000  # items of one entity above which its running sum is dealt to several tasks


def core_tail(df: DataFrame, entity: str = M.CUSTOMER, item: str | None = None, split: int = SPLIT_ITEMS) -> DataFrame:
    """Per entity (dealer), items split at cumulative share 90 into core
    and tail; micro-tail = items with 0 < share < 2 %; opportunity = 12 % of
    micro spend. All entities at once: one window per entity gives its running
    sum and total. Entities of more than ``split`` items, if the counted items
    show any, take the running sum by ranges instead (``running_sum``), so no
    task holds more than one range of them; the result is the same."""
    item = item or M.item_col(df)
    g = keyed(df, entity, item).groupBy(entity, item).agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__s"))
    g = materialize(g)  # one row per entity and item: counted, then summed
    large = g.groupBy(entity).agg(F.sum("__s").alias("__et"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > split).drop("__n")
    r = _running_by_entity(g, entity, item)
    if not large.isEmpty():
        large = materialize(large)  # at most pairs / split rows
        rest = _running_by_entity(g.join(large, entity, "left_anti"), entity, item)
        r = rest.unionByName(running_sum(g.join(large, entity), "__s", item, "__s", "__cum", partition_cols=(entity,)).select(*rest.columns))
    share = _ratio(F.col("__s"), F.col("__et")) * 100
    cum = _ratio(F.col("__cum"), F.col("__et")) * 100
    core, micro = cum <= 90, (share < 2.0) & (share > 0)
    out = r.groupBy(entity).agg(
        F.count(F.when(core, 1)).alias("core_count"),
        F.coalesce(F.sum(F.when(core, F.col("__s"))), F.lit(0)).cast("double").alias("core_spend"),
        F.count(F.when(~core, 1)).alias("tail_count"),
        F.coalesce(F.sum(F.when(~core, F.col("__s"))), F.lit(0)).cast("double").alias("tail_spend"),
        F.count(F.when(micro, 1)).alias("micro_count"),
        F.coalesce(F.sum(F.when(micro, F.col("__s"))), F.lit(0)).alias("__ms"),
    )
    return out.select(entity, "core_count", "core_spend", "tail_count", "tail_spend", "micro_count",
                      F.col("__ms").cast("double").alias("micro_spend"),
                      (F.col("__ms") * F.lit(Decimal("0.12"))).cast("double").alias("opportunity"))


# ---------------------------------------------------------------- G13, G14
def concentration(df: DataFrame, k: int = 5, threshold: float = 60.0, dim: str = M.CUSTOMER) -> DataFrame:
    """Share of the top ``k`` entities; verdict high when above ``threshold``."""
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    top = top_k(g, k, *_desc("__v", dim)).agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__top"))
    t = with_total(top, _total(g, "__v"))
    pct = F.when(F.col("__total") != 0, F.col("__top").cast("double") / F.col("__total").cast("double") * 100)
    return t.select(F.lit(k).alias("k"), F.round(pct, 2).alias("top_pct"),
                    F.when(pct > threshold, "high").otherwise("healthy").alias("verdict"))


def contribution(df: DataFrame, dim: str = M.CUSTOMER) -> DataFrame:
    """Revenue and % of total per entity."""
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    t = with_total(g, _total(g, "__v"))
    return t.select(dim, F.col("__v").cast("double").alias("sales"), _share("__v", dp=2).alias("pct"))


# ---------------------------------------------------------------- G15–G17
def item_details(df: DataFrame, n: int | None = None) -> DataFrame:
    """(item, group) -> revenue, orders, quantity (0 without a qty column)."""
    item, grp, q = M.ITEM, M.dashboard_group_col(df), M.qty_col(df)
    g = keyed(df, item, grp).groupBy(item, grp).agg(
        revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"),
        (F.coalesce(F.sum(q), F.lit(0.0)) if q else F.lit(0.0)).cast("double").alias("Quantity"))
    g = g.select(F.col(item).alias("Item"), F.col(grp).alias("Category"), "Revenue", "Orders", "Quantity")
    return top_k(g, n, F.col("Revenue").desc(), F.col("Item").asc(), F.col("Category").asc())


def group_deep_dive(df: DataFrame, n: int = 8) -> DataFrame:
    """Top groups with revenue, share of total, order count and the modal
    line item (most lines; ties -> smallest name; "N/A" when all NULL).

    Two fact passes: the groups (kept, NULL included, for the total), and the
    (group, item) line counts of the top groups only, whose arg-max is the mode
    (no group's item set is gathered into one buffer).
    """
    grp, item = M.dashboard_group_col(df), M.item_col(df)
    every = materialize(df.groupBy(grp).agg(F.sum(M.AMOUNT).alias("__v"), F.count_distinct(M.INVOICE_NO).alias("Order_Count")))
    g = keyed(every, grp).withColumn("__v", F.coalesce("__v", F.lit(0)))
    top = top_k(g, n, *_desc("__v", grp))
    lines = df.join(F.broadcast(top.select(grp)), grp, "left_semi").where(F.col(item).isNotNull())  # n rows
    counts = lines.groupBy(grp, item).agg(F.count(F.lit(1)).alias("__c"))
    mode = counts.groupBy(grp).agg(F.min_by(item, F.struct(-F.col("__c"), F.col(item))).alias("modal_item"))
    t = with_total(top.join(mode, grp, "left"), _total(every, "__v"))
    return t.select(grp, F.col("__v").cast("double").alias("Total_Revenue"),
                    F.when(F.col("__total") > 0, _share("__v")).otherwise(F.lit(0.0)).alias("share_pct"),
                    F.coalesce(F.col("modal_item"), F.lit("N/A")).alias("modal_item"), "Order_Count")


# ---------------------------------------------------------------- G18
def pivot_top_long(df: DataFrame, primary: str, secondary: str, n_primary: int = 8, n_secondary: int = 6) -> DataFrame:
    """G18 in long form: revenue of every (top primary, top secondary) cell, missing -> 0.

    The top secondaries (``n_secondary`` values, a bounded collect) become the
    literal pivot list; the pivot fills absent cells, and a stack turns the
    matrix back into rows — no cross product of the two lists is built.
    """
    wide = pivot_top(df, primary, secondary, n_primary, n_secondary)
    vals = [c for c in wide.columns if c != primary]
    if not vals:
        return wide.select(primary, F.lit(None).cast("string").alias(secondary), F.lit(0.0).alias(M.AMOUNT)).where(F.lit(False))
    stack = F.explode(F.array(*[F.struct(F.lit(v).alias(secondary), F.col(f"`{v}`").alias(M.AMOUNT)) for v in vals]))
    return wide.select(primary, stack.alias("s")).select(primary, f"s.{secondary}", f"s.{M.AMOUNT}")


def pivot_top(df: DataFrame, primary: str, secondary: str, n_primary: int = 8, n_secondary: int = 6) -> DataFrame:
    """Top primaries x top secondaries revenue matrix, one column per
    secondary value (at most ``n_secondary``), missing -> 0."""
    cells = materialize(df.groupBy(primary, secondary).agg(F.sum(M.AMOUNT).alias("__v")))  # the one fact pass

    def top(dim: str, n: int) -> DataFrame:
        return top_k(_by(cells, dim, F.coalesce(F.sum("__v"), F.lit(0)).alias("__t")), n, *_desc("__t", dim)).select(dim)

    tp = top(primary, n_primary)
    sec_values = [r[0] for r in top(secondary, n_secondary).collect()]  # bounded: n_secondary values
    d = cells.where(F.col(secondary).isin(sec_values)).join(F.broadcast(tp), primary, "left_semi")  # n_primary rows
    p = (d.groupBy(primary).pivot(secondary, sec_values)
          .agg(F.coalesce(F.sum("__v"), F.lit(0)).cast("double")))
    out = tp.join(p, primary, "left")
    return out.na.fill(0.0, [str(v) for v in sec_values])


# ---------------------------------------------------------------- G19, G20
def leader(df: DataFrame, dim: str) -> DataFrame:
    """The leading value of ``dim`` (arg-max revenue, ties -> smallest),
    its revenue and share (1 dp), and the number of active values."""
    g = _by(df, dim, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    a = g.agg(F.min_by(dim, F.struct(-F.col("__v"), F.col(dim))).alias("value"), F.max("__v").alias("__max"),
              F.coalesce(F.sum("__v"), F.lit(0)).alias("__total"), F.count(F.lit(1)).alias("active"))
    share = F.when(F.col("__total") > 0, _share("__max")).otherwise(F.lit(0.0))
    return a.select(F.lit(dim).alias("dim"), F.col("value").cast("string").alias("value"),
                    F.col("__max").cast("double").alias(M.AMOUNT), share.alias("share"), "active")


def insights(df: DataFrame, aov_threshold: float = 50000.0, concentration_k: int = 3,
             concentration_pct: float = 60.0) -> DataFrame:
    """Rule-based insight rows (kind, value, text) over E2/G13/G19 scalars."""
    from ..functions.scalars import inr
    from .kpi import kpi_summary

    grp = M.dashboard_group_col(df)
    g = _by(df, M.CUSTOMER, F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    top = top_k(g, concentration_k, *_desc("__v", M.CUSTOMER)).agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__top"))
    pct = F.round(F.col("__top").cast("double") / F.col("__total").cast("double") * 100, 1)
    conc = with_total(top, _total(g, "__v")).where(F.col("__total") > 0).select(
        F.lit("concentration").alias("kind"), pct.alias("value"),
        F.format_string(f"The {concentration_k} largest customers bring %.1f%% of revenue (%s).", pct,
                        F.when(pct > concentration_pct, "concentrated").otherwise("spread")).alias("text"))
    lg = leader(df, grp).select(
        F.lit("portfolio").alias("kind"), F.col("share").alias("value"),
        F.format_string("%d product groups sold; largest: %s with %.1f%% of revenue.", F.col("active"), F.col("value"), F.col("share")).alias("text"))
    k = kpi_summary(df).select(
        F.lit("order_size").alias("kind"), F.col("average_order_value").alias("value"),
        F.concat(F.lit("Mean order value "), inr(F.col("average_order_value"), "Rs."),
                 F.when(F.col("average_order_value") < aov_threshold, " (below the threshold).").otherwise(" (at or above the threshold)."))
         .alias("text")).where(F.col("value") > 0)
    geo = leader(df, M.STATE).select(
        F.lit("geography").alias("kind"), F.col("active").cast("double").alias("value"),
        F.format_string("Sales in %d states; largest: %s.", F.col("active"), F.col("value")).alias("text"))
    return conc.unionByName(lg).unionByName(k).unionByName(geo)


# ---------------------------------------------------------------- G21–G24
def product_mix(df: DataFrame, n: int = 9, entity: str = M.CUSTOMER) -> DataFrame:
    """Each customer's top ``n`` groups with share of that customer's revenue.

    All customers at once: (customer, group) sums, then a per-customer window
    (rows per customer <= number of groups); ``row_number() <= n`` lets Spark
    apply the group limit before the shuffle.
    """
    grp = M.dashboard_group_col(df)
    g = keyed(df, entity, grp).groupBy(entity, grp).agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    w = Window.partitionBy(entity).orderBy(F.col("__v").desc(), F.col(grp).asc())
    # the customer's total over all its lines (a line without a group still counts);
    # customers whose total is not positive get no mix, as in the reference
    tot = keyed(df, entity).groupBy(entity).agg(F.sum(M.AMOUNT).alias("__et")).where(F.col("__et") > 0)
    r = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(tot, entity)
    return r.select(entity, "rank", grp, F.col("__v").cast("double").alias("Revenue"),
                    F.round(F.col("__v").cast("double") / F.col("__et").cast("double") * 100, 1).alias("share_pct"))


def category_table(df: DataFrame, n: int = 15, grp: str | None = None) -> DataFrame:
    """Top ``n`` groups with revenue, orders and AOV."""
    grp = grp or M.dashboard_group_col(df)
    g = _by(df, grp, revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"))
    g = g.withColumn("AOV", F.when(F.col("Orders") > 0, F.col("Revenue") / F.col("Orders")).otherwise(F.lit(0.0)))
    return top_k(g, n, *_desc("Revenue", grp))


# Report dimension -> fact column
DIMENSIONS = {
    "customer": M.CUSTOMER, "state": M.STATE, "city": M.CITY, "material_group": M.ITEM_GROUP,
    "item": M.ITEM, "month": M.MONTH, "fiscal_year": M.FY,
}


def dimension_table(df: DataFrame, dimension: str, n: int = 12) -> DataFrame:
    """G23 top table: revenue, orders, customers for any of the 7 dimensions, n >= 3."""
    col = DIMENSIONS[dimension]
    n = max(3, int(n))
    g = _by(df, col, revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"),
            F.count_distinct(M.CUSTOMER).alias("Customers"))
    return top_k(g.withColumnRenamed(col, "label"), n, *_desc("Revenue", "label"))


def dynamic_report(df: DataFrame, primary: str, secondary: str | None = None, n: int = 12,
                   include_trend: bool = True, include_share: bool = True, include_table: bool = True,
                   include_pivot: bool = True) -> dict[str, DataFrame]:
    """The dynamic report's result frames (rendering is out of scope)."""
    from .kpi import kpi_extended
    from .timeseries import trend

    n = max(3, int(n))
    col = DIMENSIONS[primary]
    out = {"kpis": kpi_extended(df)}
    if include_trend:
        out["trend"] = trend(df, 24)
    if include_share:
        out["share"] = top_n_others(df, col, n)
    if include_table:
        out["table"] = dimension_table(df, primary, n)
    if include_pivot and secondary and secondary != primary:
        out["pivot"] = pivot_top(df, col, DIMENSIONS[secondary], 8, 6)
    return out


def report(df: DataFrame, axis: str, value: str | None = None) -> dict[str, DataFrame]:
    """Month-/city-/state-wise report frames for one entity or all."""
    from .filters import select_entity
    from .kpi import kpi_extended

    col = {"month": M.MONTH, "city": M.CITY, "state": M.STATE}[axis]
    d = select_entity(df, col, value)
    return {
        "kpis": kpi_extended(d),
        "groups": category_table(d, None),
        "items": item_details(d),
        "cities": city_scorecard(d, None),
        "customers": top_n(d, M.CUSTOMER, 30),
    }
