"""Time series F1–F11.

Every series is a ``groupBy`` on a calendar key (partial aggregation, then a
shuffle of one row per key per partition). Results are one row per month /
day / fiscal year — tiny — so the "last n" steps and the FY ``lag`` run on
those small results, never on the fact. The calendar of F1 is generated
from the min/max month (a 1-row aggregate), not collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..plans.common import revenue, year_month
from .filters import month_label_start


def _month(df: DataFrame) -> DataFrame:
    if M.MONTH_START in df.columns:
        return df
    return df.withColumn(M.MONTH_START, F.trunc(F.to_date(F.col(M.DATE)), "month"))


def _last(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """Keep the last ``n`` rows by ``order_col`` (TakeOrdered on a small result)."""
    if n is None:
        return df
    return df.orderBy(F.col(order_col).desc()).limit(n)


def trend(df: DataFrame, limit: int | None = 36, fill_gaps: bool = True) -> DataFrame:
    """monthly revenue with empty months between the first and last month
    emitted as 0; NULL dates dropped; label ``YYYY-MM``; the last ``limit`` months."""
    m = _month(df).where(F.col(M.DATE).isNotNull())
    return trend_of(m.groupBy(M.MONTH_START).agg(revenue().alias(M.AMOUNT)), limit, fill_gaps)


def trend_of(monthly: DataFrame, limit: int | None = 36, fill_gaps: bool = True) -> DataFrame:
    """F1 from monthly sums (``month_start``, AMOUNT)."""
    if fill_gaps:
        bounds = monthly.agg(F.min(M.MONTH_START).alias("lo"), F.max(M.MONTH_START).alias("hi"))
        cal = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias(M.MONTH_START))
        monthly = cal.join(monthly, M.MONTH_START, "left").na.fill(0.0, [M.AMOUNT])
    out = _last(monthly, limit, M.MONTH_START)
    return out.select(year_month(M.MONTH_START).alias(M.DATE), M.AMOUNT)


def trend_from_labels(df: DataFrame, limit: int | None = None) -> DataFrame:
    """the fallback trend from MONTH labels; unparsable labels dropped.
    Labels are parsed with an explicit two-digit-year pivot (see filters)."""
    by = df.where(F.col(M.MONTH).isNotNull()).groupBy(M.MONTH).agg(revenue().alias(M.AMOUNT))
    by = by.withColumn("__ms", month_label_start(F.col(M.MONTH))).where(F.col("__ms").isNotNull())
    # labels that parse to one month ("APR-24", "Apr-24") stay separate rows, as in the reference
    out = _last(by, limit, "__ms")
    return out.select(year_month("__ms").alias(M.DATE), M.AMOUNT)


def monthly(df: DataFrame) -> DataFrame:
    """revenue, orders, customers per calendar month (no gap fill)."""
    m = _month(df).where(F.col(M.DATE).isNotNull())
    return (m.groupBy(M.MONTH_START)
             .agg(revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"),
                  F.count_distinct(M.CUSTOMER).alias("Customers"))
             .select(year_month(M.MONTH_START).alias(M.MONTH), "Revenue", "Orders", "Customers"))


def daily(df: DataFrame, days: int = 30) -> DataFrame:
    """revenue and orders of the last ``days`` days that have sales."""
    d = df.where(F.col(M.DATE).isNotNull()).withColumn("DAY", F.date_format(M.DATE, "yyyy-MM-dd"))
    g = d.groupBy("DAY").agg(revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"))
    return _last(g, days, "DAY")


def growth(df: DataFrame) -> DataFrame:
    """MoM growth of the last two months that have sales (1 dp, 0 when the
    previous month is <= 0; a single month gives previous 0)."""
    m = _month(df).where(F.col(M.DATE).isNotNull()).groupBy(M.MONTH_START).agg(revenue().alias("rev"))
    last2 = m.orderBy(F.col(M.MONTH_START).desc()).limit(2)
    a = last2.agg(F.max_by("rev", M.MONTH_START).alias("cur"),
                  F.when(F.count(F.lit(1)) > 1, F.min_by("rev", M.MONTH_START)).otherwise(F.lit(0.0)).alias("prev"),
                  F.count(F.lit(1)).alias("n"))
    cur, prev = F.coalesce(F.col("cur"), F.lit(0.0)), F.col("prev")
    g = F.when((F.col("n") > 1) & (prev > 0), F.round((cur - prev) / prev * 100, 1)).otherwise(F.lit(0.0))
    return a.select(g.alias("mom_growth"), cur.alias("current_month_rev"), prev.cast("double").alias("prev_month_rev"))


def fy_summary(df: DataFrame) -> DataFrame:
    """revenue and orders per fiscal year with YoY growth vs the previous
    FY row in time order (``fy_start``; the reference orders labels, which
    breaks across centuries). NULL for the first year or a previous <= 0."""
    g = (df.groupBy(M.FY).agg(revenue().alias("Revenue"), F.count_distinct(M.INVOICE_NO).alias("Orders"),
                              F.min(M.FY_START).alias("__fy")))
    # one row per fiscal year: a global window over a table of a few dozen rows
    w = Window.orderBy(F.col("__fy").asc_nulls_last(), F.col(M.FY))
    prev = F.lag("Revenue").over(w)
    return g.select(M.FY, "Revenue", "Orders",
                    F.when(prev > 0, F.round((F.col("Revenue") - prev) / prev * 100, 1)).alias("yoy_pct"))


def fy_month_matrix(df: DataFrame) -> DataFrame:
    """FY x calendar month revenue (seasonality)."""
    d = df.where(F.col(M.DATE).isNotNull())
    return (d.groupBy(M.FY, F.month(M.DATE).alias("Month_Num"), F.date_format(M.DATE, "MMM").alias("Month_Name"))
             .agg(revenue().alias(M.AMOUNT)))


def fy_month_pivot(df: DataFrame) -> DataFrame:
    """F7 as a matrix: one column per calendar month, values listed literally
    (no driver pass to discover them)."""
    d = df.where(F.col(M.DATE).isNotNull()).withColumn("Month_Num", F.month(M.DATE))
    months = list(range(1, 13))
    p = d.groupBy(M.FY).pivot("Month_Num", months).agg(F.sum(M.AMOUNT).cast("double"))
    return p.na.fill(0.0, [str(m) for m in months])  # months with no sales in a year are 0


def fy_month_totals(df: DataFrame) -> DataFrame:
    """F8: FY x month (YYYY-MM) totals of TOTALAMOUNT and QTY."""
    d = _month(df).where(F.col(M.DATE).isNotNull())
    q = M.qty_col(d)
    return (d.groupBy(M.FY, M.MONTH_START)
             .agg(F.coalesce(F.sum("TOTALAMOUNT"), F.lit(0)).cast("double").alias("TOTAL_SALES"),
                  (F.coalesce(F.sum(q), F.lit(0.0)) if q else F.lit(0.0)).cast("double").alias("TOTAL_QTY"))
             .select(M.FY, year_month(M.MONTH_START).alias(M.MONTH), "TOTAL_SALES", "TOTAL_QTY"))


def month_trend(df: DataFrame, limit: int = 24) -> DataFrame:
    """revenue per MONTH label in time order, the last ``limit``."""
    g = df.where(F.col(M.MONTH).isNotNull()).groupBy(M.MONTH).agg(revenue().alias(M.AMOUNT))
    g = g.withColumn("__ms", month_label_start(F.col(M.MONTH)))
    return _last(g, limit, "__ms").select(F.date_format("__ms", "yyyy-MM-dd").alias(M.MONTH_START), M.MONTH, M.AMOUNT)


def volatility(df: DataFrame) -> DataFrame:
    """peak and floor month (by label; ties -> smallest label) and
    (max - min) / max * 100."""
    g = df.where(F.col(M.MONTH).isNotNull()).groupBy(M.MONTH).agg(revenue().alias("amt"))
    a = g.agg(F.max("amt").alias("max_amt"), F.min("amt").alias("min_amt"),
              F.min_by(M.MONTH, F.struct(-F.col("amt"), F.col(M.MONTH))).alias("max_month"),
              F.min_by(M.MONTH, F.struct(F.col("amt"), F.col(M.MONTH))).alias("min_month"))
    v = F.when(F.col("max_amt") != 0, F.round((F.col("max_amt") - F.col("min_amt")) / F.col("max_amt") * 100, 1))
    return a.select("max_month", "max_amt", "min_month", "min_amt", v.alias("volatility_pct"))


def forecast_next_month(df: DataFrame, min_months: int = 3) -> DataFrame:
    """OLS of monthly revenue on the 0-based index of the months present
    (in time order), predicting the next index; needs ``min_months`` months.

    The index is a row number over one row per month (a small result bounded
    by the calendar), not over the fact. The normal equations use exact sums
    (integers and decimals) and one closed-form double expression, so the
    answer does not depend on summation order.
    """
    m = _month(df).where(F.col(M.DATE).isNotNull()).groupBy(M.MONTH_START).agg(
        F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("y"))
    m = m.withColumn("x", F.row_number().over(Window.orderBy(M.MONTH_START)) - 1)
    a = m.agg(F.count(F.lit(1)).alias("months"), F.sum("x").cast("double").alias("sx"),
              F.sum(F.col("x") * F.col("x")).cast("double").alias("sxx"),
              F.sum("y").cast("double").alias("sy"), F.sum(F.col("y") * F.col("x")).cast("double").alias("sxy"))
    n = F.col("months").cast("double")
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / den
    intercept = (F.col("sy") - slope * F.col("sx")) / n
    ok = (F.col("months") >= min_months) & (den != 0)
    return a.select("months", F.when(ok, slope).alias("slope"), F.when(ok, intercept).alias("intercept"),
                    F.when(ok, intercept + slope * n).alias("forecast"))
