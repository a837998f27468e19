"""Customer analytics H1–H8: roll-up, RFM scores and labels, churn
features and classifier, risk flags, revenue-drop alerts.

Everything starts from one ``groupBy(CUSTOMER_NAME)`` (partial aggregation
before the shuffle). Global quantities (latest date, entity count) are 1-row
aggregates. Quartile edges are exact order statistics found by counting over
the written customer table: histograms of a fixed number of bins narrow the
value range of each edge until it is one value, without a sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..fixed_values import RFM_LOWEST, RFM_SEGMENTS
from ..plans.common import iso_date, keyed, materialize, order_statistics, text_statistics, with_total

QUARTILES = (0.25, 0.5, 0.75)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days (``timedelta.days`` for non-negative spans)."""
    return F.floor((F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 86400).cast("bigint")


def customer_rollup(df: DataFrame) -> DataFrame:
    """H1: revenue, orders, mean line amount, last order date per customer."""
    g = keyed(df, M.CUSTOMER).groupBy(M.CUSTOMER).agg(
        F.coalesce(F.sum(M.AMOUNT), F.lit(0)).cast("double").alias("Revenue"),
        F.count_distinct(M.INVOICE_NO).alias("Orders"),
        (F.sum(M.AMOUNT).cast("double") / F.count(M.AMOUNT)).alias("AvgOrder"),
        F.max(M.DATE).alias("__last"))
    return g.select(M.CUSTOMER, "Revenue", "Orders", "AvgOrder", iso_date("__last").alias("LastOrder"))


def rfm_base(df: DataFrame) -> DataFrame:
    """Per customer: Recency (whole days from the global latest date),
    Frequency (distinct invoices), Monetary (sum), plus first/last dates.

    One pass over the fact: lines without a customer are one more group of the
    written table, which the latest date is taken from, and then left out."""
    g = df.groupBy(M.CUSTOMER).agg(
        F.max(M.DATE).alias("__last"), F.min(M.DATE).alias("__first"),
        F.count_distinct(M.INVOICE_NO).alias("Frequency"),
        F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__money"),
        F.sum(M.AMOUNT).alias("__sum"), F.count(M.AMOUNT).alias("__lines"))
    g = materialize(g)
    g = with_total(keyed(g, M.CUSTOMER), g.agg(F.max("__last").alias("__mx")))
    return g.withColumn("Recency", elapsed_days(F.col("__mx"), F.col("__last")))


def quartile_edges(n: int, at: dict[int, tuple]) -> list[float | None]:
    """Quartile edges, linearly interpolated between the order statistics ``at`` the positions around them."""
    edges = []
    for q in QUARTILES:
        p = (n - 1) * q
        low, high = (float(at[i][0]) if i in at else None for i in (math.floor(p), math.ceil(p)))
        edges.append(None if low is None or high is None else low + (high - low) * (p - math.floor(p)))
    return edges


def _positions(n: int) -> list[int]:
    return sorted({f((n - 1) * q) for q in QUARTILES for f in (math.floor, math.ceil)}) if n else []


def below(v: Column, edges: str) -> Column:
    """Number of quartile edges strictly below ``v`` — the 0-based ``qcut`` bin,
    defined even when edges tie (where the reference raises)."""
    e = F.col(edges)
    return sum((F.when(v > e[i], 1).otherwise(0) for i in range(len(QUARTILES))), F.lit(0))


def _with_edges(base: DataFrame, rank_names: bool = False) -> DataFrame:
    """``base`` with the quartile edges of R, F and M as arrays and the number of customers, all found by counting.

    With ``rank_names`` also ``__fb``, the quartile bin of each customer's rank
    by Frequency, ties by name: a rank lies behind a quartile's position if
    (Frequency, name) lies behind that of the customer there, so three
    customers are looked up and none is ranked.
    """
    counts = base.agg(F.count("Recency").alias("r"), F.count("*").alias("n")).first()
    n = counts["n"]
    # k quarters of the ranks: 4 (rank - 1) > k (n - 1), exact in integers
    thirds = {k: k * (n - 1) // 4 for k in (1, 2, 3)} if n else {}
    at = order_statistics(base, {"Recency": _positions(counts["r"]), "Frequency": sorted({*_positions(n), *thirds.values()}), "__money": _positions(n)})
    out = base
    for name, col, size in (("__er", "Recency", counts["r"]), ("__ef", "Frequency", n), ("__em", "__money", n)):
        out = out.withColumn(name, F.array(*[F.lit(e).cast("double") for e in quartile_edges(size, at[col])]))
    out = out.withColumn("__n", F.lit(n))
    if rank_names:
        freq = {k: at["Frequency"][p] for k, p in thirds.items()}
        names = text_statistics(base, M.CUSTOMER, {k: (F.col("Frequency") == int(v), thirds[k] - smaller) for k, (v, smaller) in freq.items()})
        behind = [(F.col("Frequency") > int(freq[k][0])) | ((F.col("Frequency") == int(freq[k][0])) & (F.col(M.CUSTOMER) > F.lit(names[k]))) for k in thirds]
        out = out.withColumn("__fb", sum((F.when(b, 1).otherwise(0) for b in behind), F.lit(0)))
    return out


def segment_of(score: Column, segments=RFM_SEGMENTS, lowest: str = RFM_LOWEST) -> Column:
    out = None
    for threshold, name in segments:
        out = F.when(score >= threshold, name) if out is None else out.when(score >= threshold, name)
    return out.otherwise(lowest)


def rfm_segments(df: DataFrame) -> DataFrame:
    """H2 (flagship): quartile scores R (reversed), F, M summed to 3..12 ->
    Champions >= 10, Loyal >= 8, Potential >= 6, At Risk >= 4, else Lost."""
    b = _with_edges(rfm_base(df))
    r = F.lit(4) - below(F.col("Recency"), "__er")
    f = F.lit(1) + below(F.col("Frequency"), "__ef")
    m = F.lit(1) + below(F.col("__money").cast("double"), "__em")
    score = r + f + m
    return b.select(M.CUSTOMER, "Recency", "Frequency", F.col("__money").cast("double").alias("Monetary"),
                    segment_of(score).alias("Segment"))


# FIXED VALUES: RFM label sets (lowest bin first) and label-based segments.
R_LABELS = ["Active", "At Risk", "Churning", "Lost"]
F_LABELS = ["One-time", "Rare", "Frequent", "Loyal"]
M_LABELS = ["Low", "Medium", "High", "VIP"]


def _label(bin_: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), bin_ + 1)


def rfm_labels(df: DataFrame, min_customers: int = 4) -> DataFrame:
    """H3: R (Recency quartile: Active..Lost), F (quartile of the rank-first
    of Frequency, ties by name), M (Low..VIP) and the 5 label segments; later
    rules override earlier ones. Empty below ``min_customers`` customers."""
    b = _with_edges(rfm_base(df), rank_names=True).where(F.col("__n") >= min_customers)
    rb = below(F.col("Recency"), "__er")
    fb = F.col("__fb")
    mb = below(F.col("__money").cast("double"), "__em")
    R, Fq, Mo = _label(rb, R_LABELS), _label(fb, F_LABELS), _label(mb, M_LABELS)
    seg = (F.when(R == "Lost", "Inactive")
            .when((R == "At Risk") & Fq.isin("Loyal", "Frequent"), "Retention Opportunities")
            .when((R == "Active") & (Fq == "Frequent"), "Consistent Buyers")
            .when((R == "Active") & (Fq == "Loyal"), "Strategic Accounts")
            .otherwise("Standard"))
    return b.select(M.CUSTOMER, "Recency", "Frequency", F.col("__money").cast("double").alias("Monetary"),
                    R.alias("R_Score"), Fq.alias("F_Score"), Mo.alias("M_Score"), seg.alias("Segment"))


def segment_rollup(rfm: DataFrame) -> DataFrame:
    """H4: customers and revenue per segment (money summed exactly, in any order)."""
    return rfm.groupBy("Segment").agg(F.count(F.lit(1)).alias("Count"),
                                      F.coalesce(F.sum(F.col("Monetary").cast(M.MONEY)).cast("double"), F.lit(0.0)).alias("Revenue"))


CHURN_DAYS = 90


def churn_features(df: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    """H5: Recency, Frequency, Monetary, Tenure (days first->last), mean line
    amount and the proxy label Recency > churn_days."""
    b = rfm_base(df)
    return b.select(M.CUSTOMER, "Recency", "Frequency", F.col("__money").cast("double").alias("Monetary"),
                    elapsed_days(F.col("__last"), F.col("__first")).alias("Tenure"),
                    (F.col("__sum").cast("double") / F.col("__lines")).alias("Avg_Order_Value"),
                    (F.col("Recency") > churn_days).cast("int").alias("Is_Churned"))


FEATURES = ["Recency", "Frequency", "Monetary", "Tenure", "Avg_Order_Value"]


def churn_scores(features: DataFrame, min_customers: int = 10, churn_days: int = CHURN_DAYS,
                 num_trees: int = 100, seed: int = 42) -> DataFrame:
    """H6: standardise, random forest (100 trees, seed 42), in-sample P(churn) x 100;
    a single class gives that class as a constant; active customers only
    (Recency <= churn_days), by risk. Spark ML trains on the customer table,
    distributed. Fewer than ``min_customers`` customers -> empty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    features = materialize(features)  # one row per customer: statistics, scaler, forest and scores read it, not the fact
    stats = features.agg(F.count(F.lit(1)).alias("n"), F.min("Is_Churned").alias("lo"),
                         F.max("Is_Churned").alias("hi")).first()  # 1-row scalar, decides the plan
    out_cols = [M.CUSTOMER, *FEATURES, "Is_Churned"]
    active = F.col("Recency") <= churn_days
    if stats is None or stats["n"] < min_customers:
        return features.select(*out_cols, F.lit(None).cast("double").alias("Churn_Probability")).where(F.lit(False))
    if stats["lo"] == stats["hi"]:
        return (features.withColumn("Churn_Probability", F.lit(float(stats["lo"]) * 100.0))
                .where(active).select(*out_cols, "Churn_Probability"))
    data = features.na.fill(0.0, FEATURES)
    prep = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
    ]).fit(data)
    x = prep.transform(data)
    forest = RandomForestClassifier(featuresCol="__x", labelCol="Is_Churned", numTrees=num_trees, seed=seed,
                                    probabilityCol="__p", rawPredictionCol="__rp", predictionCol="__pred").fit(x)
    # score with a copy: the fitted model's training summary holds the session, which must not
    # travel inside task closures
    scored = forest.copy().transform(x).withColumn("Churn_Probability", vector_to_array(F.col("__p"))[1] * 100.0)
    return scored.where(active).select(*out_cols, "Churn_Probability")


def customer_risk(df: DataFrame, asof: str, inactive_days: int = 90) -> DataFrame:
    """H7: single-order customers (at most one invoice) and customers whose last
    order date is more than ``inactive_days`` days (fractional, from that
    date's midnight) before ``asof`` — a parameter, never the wall clock."""
    g = keyed(df, M.CUSTOMER).groupBy(M.CUSTOMER).agg(F.count_distinct(M.INVOICE_NO).alias("Orders"),
                                                      F.max(M.DATE).alias("__last"))
    last_day = F.to_date("__last").cast("timestamp")
    days = (F.unix_seconds(F.to_timestamp(F.lit(asof))) - F.unix_seconds(last_day)) / 86400
    return g.select(M.CUSTOMER, "Orders", iso_date("__last").alias("LastOrder"),
                    (F.col("Orders") <= 1).alias("single_order"),
                    F.coalesce(days > inactive_days, F.lit(False)).alias("inactive_90"))


def revenue_drops(df: DataFrame, start: str | None = None, end: str | None = None, threshold_pct: float = 20.0,
                  n: int = 20) -> DataFrame:
    """H8: customers present in both windows with previous revenue > 0 and a
    drop of at least ``threshold_pct``; change 1 dp; the ``n`` worst.

    One scan over both windows and one ``groupBy(customer)`` with conditional
    sums; the worst-n is a TakeOrdered on the alert rows.
    """
    from .kpi import previous_window

    if start is None or end is None:
        # the reference falls back to the data's first / last date: a 1-row scalar
        lo, hi = df.agg(F.min(M.DATE), F.max(M.DATE)).first()
        if lo is None:
            return df.sparkSession.createDataFrame([], "entity string, entity_type string, current_revenue double, "
                                                       "previous_revenue double, change_pct double")
        start = start or lo.date().isoformat()
        end = end or hi.date().isoformat()  # date-only: the last day is included whole, as in the reference
    # same window arithmetic as E3: the previous window ends at ``start``
    prev_start, s, e, incl = previous_window(start, end)
    d = F.col(M.DATE)
    upper = (d <= F.lit(e)) if incl else (d < F.lit(e))
    w = df.where((d >= F.lit(prev_start)) & upper).withColumn("__cur", d >= F.lit(s))
    g = keyed(w, M.CUSTOMER).groupBy(M.CUSTOMER).agg(
        F.coalesce(F.sum(F.when(F.col("__cur"), F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("cv"),
        F.count(F.when(F.col("__cur"), 1)).alias("cn"),
        F.coalesce(F.sum(F.when(~F.col("__cur"), F.col(M.AMOUNT))), F.lit(0)).cast("double").alias("pv"),
        F.count(F.when(~F.col("__cur"), 1)).alias("pn"))
    pct = F.try_divide(F.col("cv") - F.col("pv"), F.col("pv")) * 100
    a = g.where((F.col("cn") > 0) & (F.col("pn") > 0) & (F.col("pv") > 0) & (F.col("cv") < F.col("pv")))
    a = a.withColumn("__pct", pct).where(F.col("__pct") <= -threshold_pct)
    out = a.select(F.col(M.CUSTOMER).alias("entity"), F.lit("customer").alias("entity_type"),
                   F.col("cv").alias("current_revenue"), F.col("pv").alias("previous_revenue"),
                   F.round("__pct", 1).alias("change_pct"))
    return out.orderBy(F.col("change_pct").asc(), F.col("entity").asc()).limit(n)
