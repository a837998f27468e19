"""Data quality K1–K8: health score, row anomaly flags, null profile,
location checks, raw-vs-processed reconciliation, value distribution.

All checks are single aggregations or ``when`` columns; the per-column null
profile is one ``agg`` with one ``count_if`` per column, unpivoted after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..fixed_values import HOME_STATE
from ..plans.common import with_total

# FIXED VALUES: anomaly labels, health status bands and penalty caps.
FLAG_AMOUNT = "Zero/Negative Amount"
FLAG_LOCATION = "Missing Location Data"
FLAG_CLEAN = "Clean"
STATUS_GOOD, STATUS_WARNING = 80, 50
MISSING_DATE_WEIGHT, DUP_CAP, NEG_CAP = 30, 40, 30
REQUIRED_COLUMNS = ["CITY", "STATE", "CUSTOMER_NAME", "ITEMNAME"]


def health(df: DataFrame) -> DataFrame:
    """K1: 100 - 30 x missing-date share - min(repeat %, 40) - min(negative %, 30),
    1 dp, clamped to 0..100; good >= 80, warning >= 50, else poor; empty -> no_data.

    ``repeat_invoice_rows`` = rows - distinct (INVOICE_NO, DATE) pairs, with
    NULLs counted as values (a struct distinct), as the reference's
    drop_duplicates does. No DATE column -> every date missing.
    """
    has_date, has_inv = M.DATE in df.columns, M.INVOICE_NO in df.columns
    total = F.count(F.lit(1))
    missing = F.count_if(F.col(M.DATE).isNull()) if has_date else total
    distinct_pairs = (F.count_distinct(F.struct(F.col(M.INVOICE_NO), F.col(M.DATE))) if has_date and has_inv
                      else total)
    neg = F.count_if(F.col(M.AMOUNT) < 0) if M.AMOUNT in df.columns else F.lit(0)
    a = df.agg(total.alias("total_rows"), missing.alias("missing_dates"),
               (total - distinct_pairs).alias("repeat_invoice_rows"), neg.alias("negative_amounts"))
    t, mi, du, ne = (F.col(c).cast("double") for c in ("total_rows", "missing_dates", "repeat_invoice_rows",
                                                       "negative_amounts"))
    denom = F.greatest(t, F.lit(1.0))
    raw = (F.lit(100.0) - mi / t * MISSING_DATE_WEIGHT - F.least(du / denom * 100, F.lit(float(DUP_CAP)))
           - F.least(ne / denom * 100, F.lit(float(NEG_CAP))))
    score = F.when(F.col("total_rows") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1)))).otherwise(F.lit(0.0))
    status = (F.when(F.col("total_rows") == 0, "no_data").when(score >= STATUS_GOOD, "good")
               .when(score >= STATUS_WARNING, "warning").otherwise("poor"))
    return a.select("total_rows", "missing_dates", "repeat_invoice_rows", "negative_amounts",
                    score.alias("score"), status.alias("status"))


def _contains_any(c: Column, words: list[str]) -> Column:
    up = F.upper(c.cast("string"))
    cond = None
    for w in words:
        x = F.coalesce(up.contains(w), F.lit(False))
        cond = x if cond is None else cond | x
    return cond


def anomaly_flag(df: DataFrame) -> Column:
    """K2: AMOUNT <= 0 -> zero/negative; else STATE or CITY containing UNKNOWN or
    NOT FOUND -> missing location; else clean. A NULL AMOUNT is not flagged."""
    amount = F.coalesce(F.col(M.AMOUNT) <= 0, F.lit(False)) if M.AMOUNT in df.columns else F.lit(False)
    loc = F.lit(False)
    for c in (M.STATE, M.CITY):
        if c in df.columns:
            loc = loc | _contains_any(F.col(c), ["UNKNOWN", "NOT FOUND"])
    return F.when(amount, FLAG_AMOUNT).when(loc, FLAG_LOCATION).otherwise(FLAG_CLEAN)


def with_anomaly_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("Anomaly_Flag", anomaly_flag(df))


def anomaly_counts(df: DataFrame) -> DataFrame:
    """K3: rows per anomaly flag (clean included)."""
    return with_anomaly_flag(df).groupBy("Anomaly_Flag").agg(F.count(F.lit(1)).alias("n"))


def anomaly_summary(df: DataFrame) -> DataFrame:
    """K3: total rows, anomalies and health % = clean / total."""
    f = anomaly_flag(df)
    a = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(f != FLAG_CLEAN).alias("anomalies"))
    return a.withColumn("health_pct", F.when(F.col("total_rows") > 0,
                                            (F.col("total_rows") - F.col("anomalies")) / F.col("total_rows") * 100)
                        .otherwise(F.lit(0.0)))


def anomaly_rows(df: DataFrame) -> DataFrame:
    """K3: the flagged rows with the report columns."""
    cols = [c for c in (M.DATE, M.CUSTOMER, M.INVOICE_NO, M.CITY, M.STATE, M.AMOUNT) if c in df.columns]
    return with_anomaly_flag(df).where(F.col("Anomaly_Flag") != FLAG_CLEAN).select(*cols, "Anomaly_Flag")


def null_counts(df: DataFrame) -> DataFrame:
    """K4: NULL count per column, only columns with NULLs (sorted by the caller)."""
    a = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"))
                                        for c in df.columns])).alias("r")).select("r.*")
    return rows.where(F.col("missing") > 0)


def missing_location(df: DataFrame, home_state: str = HOME_STATE) -> DataFrame:
    """K5: rows whose CITY or STATE contains NOT FOUND / UNKNOWN (any case), or
    whose STATE is the home state (the reference's over-eager default check)."""
    cond = (_contains_any(F.col(M.CITY), ["NOT FOUND", "UNKNOWN"]) | _contains_any(F.col(M.STATE), ["NOT FOUND", "UNKNOWN"])
            | F.coalesce(F.upper(F.col(M.STATE)) == home_state.upper(), F.lit(False)))
    return df.where(cond).select(M.INVOICE_NO, M.CUSTOMER, M.CITY, M.STATE, M.AMOUNT)


def reconciliation(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """K6: raw vs processed rows and amounts; verdict LOST / GAINED / MATCH on rows.

    Raw amount = first raw column whose name contains AMOUNT; processed amount =
    TOTALAMOUNT if present else AMOUNT. Two 1-row aggregates joined.
    """
    ra = next((c for c in raw.columns if "AMOUNT" in c.upper()), None)
    pa = "TOTALAMOUNT" if "TOTALAMOUNT" in processed.columns else (M.AMOUNT if M.AMOUNT in processed.columns else None)
    r = raw.agg(F.count(F.lit(1)).alias("raw_rows"),
                (F.coalesce(F.sum(ra), F.lit(0)) if ra else F.lit(0)).cast("double").alias("raw_amount"))
    p = processed.agg(F.count(F.lit(1)).alias("out_rows"),
                      (F.coalesce(F.sum(pa), F.lit(0)) if pa else F.lit(0)).cast("double").alias("out_amount"))
    j = with_total(r, p)
    diff = F.col("raw_rows") - F.col("out_rows")
    verdict = F.when(diff > 0, "LOST").when(diff < 0, "GAINED").otherwise("MATCH")
    return j.select("raw_rows", "out_rows", diff.alias("diff"), "raw_amount", "out_amount",
                    (F.col("out_amount") - F.col("raw_amount")).alias("amount_diff"), verdict.alias("verdict"))


def required_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """K7: (column, present) for the required columns — schema only, no job."""
    spark = df.sparkSession
    return spark.createDataFrame([(c, c in df.columns) for c in required], "column string, present boolean")


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """K8: rows per value of ``col`` (NULL excluded, as value_counts does)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
