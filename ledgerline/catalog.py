"""Registered queries: one per operator of the inventory, each with its SQL twin.

Every query reads the driver's tables (through ``sources.tables``) and runs
the operator over the whole fact; parameters (dates, thresholds, n) are the
reference's defaults or fixed report settings. ``QUERIES[name](spark, sf_dir)``
returns a lazy DataFrame; ``SQL[name]`` is the DuckDB statement for the same
result, absent only for operators with no SQL form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from . import oracle as O
from .model import Filters
from .operators import filters as D
from .operators import kpi as E
from .operators import ranking as G
from .operators import timeseries as TS
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A targets table derived from the orders calendar: one row per month
    label, 5 000 000 + 250 000 x calendar month (FY, MONTH, TARGET_AMOUNT, ...)."""
    from .functions.scalars import fy_label, month_label

    o = T.table(spark, sf_dir, "orders").select("o_orderdate")
    d = F.col("o_orderdate")
    return o.select(fy_label(d).alias(M.FY), month_label(d).alias(M.MONTH),
                    (F.lit(5000000) + F.lit(250000) * F.month(d)).cast("bigint").alias("TARGET_AMOUNT"),
                    F.lit("All").alias(M.CUSTOMER), F.lit("All").alias("MATERIAL_GROUP")).distinct()


# ------------------------------------------------------------------ D: filters
FILTER_SPEC = Filters(states=["ASIA", "EUROPE", " "], fiscal_years=["97-98", "FY98-99"],
                      start_date="1997-06-01", end_date="1999-02-28")
FILTER_SQL_WHERE = ("DATE >= TIMESTAMP '1997-06-01' AND DATE < TIMESTAMP '1999-03-01' "
                    "AND STATE IN ('ASIA', 'EUROPE') AND trim(FINANCIAL_YEAR) IN ('97-98', 'FY97-98', 'FY98-99', '98-99')")

KPI_SQL = """CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS revenue,
       COUNT(DISTINCT INVOICE_NO) AS orders, COUNT(DISTINCT CUSTOMER_NAME) AS customers,
       CASE WHEN COUNT(DISTINCT INVOICE_NO) > 0
            THEN CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) / COUNT(DISTINCT INVOICE_NO) ELSE 0.0 END AS average_order_value"""


@query("d1_filtered_kpis", O.with_sales(f"SELECT {KPI_SQL} FROM sales WHERE {FILTER_SQL_WHERE}"))
def d1_filtered_kpis(spark, sf):
    return E.kpi_summary(D.apply_filters(T.sales(spark, sf), FILTER_SPEC))


@query("d1_filtered_rows", O.with_sales(
    "SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, INVOICE_NO, CUSTOMER_NAME, STATE, FINANCIAL_YEAR, "
    f"CAST(AMOUNT AS DOUBLE) AS AMOUNT FROM sales WHERE {FILTER_SQL_WHERE}"))
def d1_filtered_rows(spark, sf):
    d = D.apply_filters(T.sales(spark, sf), FILTER_SPEC)
    return _out(d.select(M.DATE, M.INVOICE_NO, M.CUSTOMER, M.STATE, M.FY, M.AMOUNT))


@query("d3_entity_filter", O.with_sales(
    "SELECT CAST(COALESCE(SUM(AMOUNT),0) AS DOUBLE) AS revenue, COUNT(*) AS lines FROM sales "
    "WHERE CITY = 'NATION_3' AND STATE = 'EUROPE' AND ITEM_NAME_GROUP = 'Brand#7'"))
def d3_entity_filter(spark, sf):
    d = D.entity_filter(T.sales(spark, sf), "city", "NATION_3", customer="All", state="EUROPE", group="Brand#7")
    return d.agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).cast("double").alias("revenue"), F.count(F.lit(1)).alias("lines"))


@query("d4_filter_options", O.with_sales(f"""
SELECT dim, value, CAST(CASE WHEN dim = 'months'
         THEN COALESCE(year(ms) * 100 + month(ms), 999999) ELSE 0 END AS INTEGER) AS ord
FROM (SELECT dim, value, {O.month_label_start_sql('value')} AS ms FROM (
  SELECT DISTINCT 'states' AS dim, STATE AS value FROM sales
    WHERE STATE IS NOT NULL AND trim(STATE) <> '' AND upper(STATE) NOT LIKE '%NOT FOUND%'
  UNION SELECT DISTINCT 'cities', CITY FROM sales
    WHERE CITY IS NOT NULL AND upper(CITY) NOT LIKE '%NOT FOUND%' AND upper(CITY) NOT LIKE '%UNKNOWN%'
  UNION SELECT DISTINCT 'customers', CUSTOMER_NAME FROM sales WHERE CUSTOMER_NAME IS NOT NULL
  UNION SELECT DISTINCT 'material_groups', ITEM_NAME_GROUP FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL
  UNION SELECT DISTINCT 'fiscal_years', FINANCIAL_YEAR FROM sales WHERE FINANCIAL_YEAR IS NOT NULL
  UNION SELECT DISTINCT 'months', MONTH FROM sales WHERE MONTH IS NOT NULL))"""))
def d4_filter_options(spark, sf):
    return D.filter_options(T.sales(spark, sf))


@query("d5_page", O.with_sales("""
SELECT CUSTOMER_NAME, Revenue FROM (
  SELECT CUSTOMER_NAME, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue FROM sales GROUP BY CUSTOMER_NAME)
WHERE contains(lower(CUSTOMER_NAME), '00001')
ORDER BY Revenue DESC, CUSTOMER_NAME LIMIT 10 OFFSET 10"""))
def d5_page(spark, sf):
    g = T.sales(spark, sf).groupBy(M.CUSTOMER).agg(F.sum(M.AMOUNT).cast("double").alias("Revenue"))
    return D.page(g, "00001", [M.CUSTOMER], "Revenue", ascending=False, page_no=1, size=10, tiebreak=[M.CUSTOMER])


@query("d6_preset_ytd", O.with_sales(
    f"SELECT {KPI_SQL} FROM sales WHERE DATE >= TIMESTAMP '2001-01-01' AND DATE < TIMESTAMP '2001-08-02'"))
def d6_preset_ytd(spark, sf):
    s, e = D.preset("ytd", "2001-08-01")
    return E.kpi_summary(D.date_range(T.sales(spark, sf), s, e))


@query("a4_rolling_years", O.with_sales(
    f"SELECT {KPI_SQL} FROM sales WHERE DATE >= TIMESTAMP '1999-08-01'"))
def a4_rolling_years(spark, sf):
    return E.kpi_summary(D.rolling_years(T.sales(spark, sf), 2, "2001-08-01"))


@query("a6_date_range_with_time", O.with_sales(
    f"SELECT {KPI_SQL} FROM sales WHERE DATE >= TIMESTAMP '1998-03-01' AND DATE <= TIMESTAMP '1998-03-31 00:00:00'"))
def a6_date_range_with_time(spark, sf):
    return E.kpi_summary(D.date_range(T.sales(spark, sf), "1998-03-01", "1998-03-31 00:00:00"))


@query("a3_tenant_scan", O.with_sales(f"SELECT {KPI_SQL} FROM sales WHERE tenant_id = 'BUILDING'"))
def a3_tenant_scan(spark, sf):
    return E.kpi_summary(D.tenant(T.sales(spark, sf), "BUILDING"))


# ------------------------------------------------------------------ E: KPIs
@query("e1_kpi_summary", O.with_sales(f"SELECT {KPI_SQL} FROM sales"))
def e1_kpi_summary(spark, sf):
    return E.kpi_summary(T.sales(spark, sf))


@query("e2_kpi_extended", O.with_sales(f"""
SELECT {KPI_SQL}, CAST(COALESCE(SUM(QTY), 0) AS DOUBLE) AS quantity,
       COUNT(DISTINCT ITEMNAME) AS items, COUNT(DISTINCT ITEM_NAME_GROUP) AS groups FROM sales"""))
def e2_kpi_extended(spark, sf):
    return E.kpi_extended(T.sales(spark, sf))


def _compare_sql(prev_start: str, cur_start: str, cur_end_excl: str) -> str:
    return O.with_sales(f"""
SELECT metric, current,
       CASE WHEN prows > 0 THEN previous END AS previous,
       CASE WHEN prows > 0 THEN ROUND(CASE WHEN previous > 0 THEN (current - previous) / previous * 100 ELSE 0.0 END, 1) END AS pct
FROM (
  SELECT prows, unnest([
    {{'metric': 'revenue', 'current': cr, 'previous': pr}},
    {{'metric': 'orders', 'current': CAST(co AS DOUBLE), 'previous': CAST(po AS DOUBLE)}},
    {{'metric': 'customers', 'current': CAST(cc AS DOUBLE), 'previous': CAST(pc AS DOUBLE)}},
    {{'metric': 'average_order_value', 'current': CASE WHEN co > 0 THEN cr / co ELSE 0.0 END,
      'previous': CASE WHEN po > 0 THEN pr / po ELSE 0.0 END}}], recursive := true)
  FROM (
    SELECT CAST(COALESCE(SUM(CASE WHEN cur THEN AMOUNT END), 0) AS DOUBLE) AS cr,
           COUNT(DISTINCT CASE WHEN cur THEN INVOICE_NO END) AS co,
           COUNT(DISTINCT CASE WHEN cur THEN CUSTOMER_NAME END) AS cc,
           CAST(COALESCE(SUM(CASE WHEN NOT cur THEN AMOUNT END), 0) AS DOUBLE) AS pr,
           COUNT(DISTINCT CASE WHEN NOT cur THEN INVOICE_NO END) AS po,
           COUNT(DISTINCT CASE WHEN NOT cur THEN CUSTOMER_NAME END) AS pc,
           COUNT(CASE WHEN NOT cur THEN 1 END) AS prows
    FROM (SELECT *, DATE >= TIMESTAMP '{cur_start}' AS cur FROM sales
          WHERE DATE >= TIMESTAMP '{prev_start}' AND DATE < TIMESTAMP '{cur_end_excl}')))""")


@query("e3_compare_previous", _compare_sql("1997-11-30", "1998-01-01", "1998-02-01"))
def e3_compare_previous(spark, sf):
    return E.compare_previous(T.sales(spark, sf), "1998-01-01", "1998-01-31")


@query("e3_compare_previous_aligned", _compare_sql("1997-12-01", "1998-01-01", "1998-02-01"))
def e3_compare_previous_aligned(spark, sf):
    return E.compare_previous(T.sales(spark, sf), "1998-01-01", "1998-01-31", aligned=True)


@query("e4_goals", O.with_sales("""
SELECT metric, target, achievement_pct FROM (
  SELECT 'revenue' AS metric, 500000000.0 AS target, ROUND(CAST(SUM(AMOUNT) AS DOUBLE) / 500000000.0 * 100, 1) AS achievement_pct FROM sales
  UNION ALL
  SELECT 'orders', 10000.0, ROUND(COUNT(DISTINCT INVOICE_NO) / 10000.0 * 100, 1) FROM sales)"""))
def e4_goals(spark, sf):
    return E.goals(E.kpi_summary(T.sales(spark, sf)), 500000000.0, 10000)


@query("e5_mtd_growth", O.with_sales("""
SELECT current_mtd, previous_mtd, growth_pct,
       CASE WHEN previous_mtd > 0 THEN printf('%+.1f%% (MTD)', growth_pct)
            WHEN current_mtd > 0 THEN '+100% (New)' ELSE '0% (MTD)' END AS label
FROM (SELECT current_mtd, previous_mtd,
             ROUND(CASE WHEN previous_mtd > 0 THEN (current_mtd - previous_mtd) / previous_mtd * 100 ELSE 0.0 END, 1) AS growth_pct
      FROM (SELECT CAST(COALESCE(SUM(CASE WHEN DATE >= date_trunc('month', mx) AND DATE <= mx THEN AMOUNT END), 0) AS DOUBLE) AS current_mtd,
                   CAST(COALESCE(SUM(CASE WHEN DATE >= date_trunc('month', mx - INTERVAL 1 MONTH)
                                           AND DATE <= mx - INTERVAL 1 MONTH THEN AMOUNT END), 0) AS DOUBLE) AS previous_mtd
            FROM sales, (SELECT max(DATE) AS mx FROM sales)))"""))
def e5_mtd_growth(spark, sf):
    return E.mtd_growth(T.sales(spark, sf))


E6_WHERE = "trim(FINANCIAL_YEAR) IN ('FY98-99', '98-99')"


@query("e6_target_achievement", O.with_sales(f"""
SELECT revenue, target, CASE WHEN target > 0 THEN ROUND(revenue / target * 100, 1) END AS pct
FROM (SELECT CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS revenue FROM sales WHERE {E6_WHERE}),
     (SELECT CAST(COALESCE(SUM(TARGET_AMOUNT), 0) AS DOUBLE) AS target FROM targets
      WHERE MONTH IN (SELECT MONTH FROM sales WHERE {E6_WHERE}))""", O.TARGETS))
def e6_target_achievement(spark, sf):
    d = D.apply_filters(T.sales(spark, sf), Filters(fiscal_years=["FY98-99"]))
    return E.target_achievement(d, targets(spark, sf))


@query("e7_monthly_vs_target", O.with_sales(f"""
SELECT strftime({O.month_label_start_sql('m.MONTH')}, '%Y-%m-%d') AS month_start, m.MONTH, m.AMOUNT,
       COALESCE(t.TARGET_AMOUNT, 0.0) AS TARGET_AMOUNT
FROM (SELECT MONTH, CAST(SUM(AMOUNT) AS DOUBLE) AS AMOUNT FROM sales WHERE MONTH IS NOT NULL GROUP BY MONTH) m
LEFT JOIN (SELECT MONTH, CAST(SUM(TARGET_AMOUNT) AS DOUBLE) AS TARGET_AMOUNT FROM targets GROUP BY MONTH) t
  ON m.MONTH = t.MONTH""", O.TARGETS))
def e7_monthly_vs_target(spark, sf):
    return E.monthly_vs_target(T.sales(spark, sf), targets(spark, sf))


# ------------------------------------------------------------------ F: time series
@query("f1_trend", O.with_sales("""
SELECT strftime(m, '%Y-%m') AS DATE, COALESCE(a, 0.0) AS AMOUNT FROM (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
  FROM (SELECT min(month_start) AS lo, max(month_start) AS hi FROM sales WHERE DATE IS NOT NULL)) cal
LEFT JOIN (SELECT month_start, CAST(SUM(AMOUNT) AS DOUBLE) AS a FROM sales WHERE DATE IS NOT NULL GROUP BY month_start) x
  ON cal.m = x.month_start
ORDER BY m DESC LIMIT 36"""))
def f1_trend(spark, sf):
    return TS.trend(T.sales(spark, sf), 36)


@query("f2_trend_from_labels", O.with_sales(f"""
SELECT strftime(ms, '%Y-%m') AS DATE, AMOUNT FROM (
  SELECT {O.month_label_start_sql('MONTH')} AS ms, CAST(SUM(AMOUNT) AS DOUBLE) AS AMOUNT
  FROM sales WHERE MONTH IS NOT NULL GROUP BY MONTH) WHERE ms IS NOT NULL"""))
def f2_trend_from_labels(spark, sf):
    return TS.trend_from_labels(T.sales(spark, sf))


@query("f3_monthly", O.with_sales("""
SELECT strftime(month_start, '%Y-%m') AS MONTH, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue,
       COUNT(DISTINCT INVOICE_NO) AS Orders, COUNT(DISTINCT CUSTOMER_NAME) AS Customers
FROM sales WHERE DATE IS NOT NULL GROUP BY month_start"""))
def f3_monthly(spark, sf):
    return TS.monthly(T.sales(spark, sf))


@query("f4_daily", O.with_sales("""
SELECT strftime(DATE, '%Y-%m-%d') AS DAY, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
FROM sales WHERE DATE IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 30"""))
def f4_daily(spark, sf):
    return TS.daily(T.sales(spark, sf), 30)


@query("f5_growth", O.with_sales("""
SELECT CASE WHEN n > 1 AND prev > 0 THEN ROUND((cur - prev) / prev * 100, 1) ELSE 0.0 END AS mom_growth,
       COALESCE(cur, 0.0) AS current_month_rev, prev AS prev_month_rev
FROM (SELECT arg_max(rev, month_start) AS cur, CASE WHEN count(*) > 1 THEN arg_min(rev, month_start) ELSE 0.0 END AS prev,
             count(*) AS n
      FROM (SELECT month_start, CAST(SUM(AMOUNT) AS DOUBLE) AS rev FROM sales WHERE DATE IS NOT NULL
            GROUP BY month_start ORDER BY month_start DESC LIMIT 2))"""))
def f5_growth(spark, sf):
    return TS.growth(T.sales(spark, sf))


@query("f6_fy_summary", O.with_sales("""
SELECT FINANCIAL_YEAR, Revenue, Orders,
       CASE WHEN lag(Revenue) OVER w > 0 THEN ROUND((Revenue - lag(Revenue) OVER w) / lag(Revenue) OVER w * 100, 1) END AS yoy_pct
FROM (SELECT FINANCIAL_YEAR, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders,
             min(fy_start) AS fy FROM sales GROUP BY FINANCIAL_YEAR)
WINDOW w AS (ORDER BY fy NULLS LAST, FINANCIAL_YEAR)"""))
def f6_fy_summary(spark, sf):
    return TS.fy_summary(T.sales(spark, sf))


@query("f7_fy_month_matrix", O.with_sales("""
SELECT FINANCIAL_YEAR, CAST(month(DATE) AS INTEGER) AS Month_Num, strftime(DATE, '%b') AS Month_Name, CAST(SUM(AMOUNT) AS DOUBLE) AS AMOUNT
FROM sales WHERE DATE IS NOT NULL GROUP BY 1, 2, 3"""))
def f7_fy_month_matrix(spark, sf):
    return TS.fy_month_matrix(T.sales(spark, sf))


@query("f8_fy_month_totals", O.with_sales("""
SELECT FINANCIAL_YEAR, strftime(month_start, '%Y-%m') AS MONTH,
       CAST(SUM(AMOUNT + AMOUNT * CAST(0.18 AS DECIMAL(3,2))) AS DOUBLE) AS TOTAL_SALES, CAST(SUM(QTY) AS DOUBLE) AS TOTAL_QTY
FROM sales WHERE DATE IS NOT NULL GROUP BY FINANCIAL_YEAR, month_start"""))
def f8_fy_month_totals(spark, sf):
    from .operators.ingest import add_taxes

    return TS.fy_month_totals(add_taxes(T.sales(spark, sf)))


@query("f9_month_trend", O.with_sales(f"""
SELECT strftime(ms, '%Y-%m-%d') AS month_start, MONTH, AMOUNT FROM (
  SELECT MONTH, {O.month_label_start_sql('MONTH')} AS ms, CAST(SUM(AMOUNT) AS DOUBLE) AS AMOUNT
  FROM sales WHERE MONTH IS NOT NULL GROUP BY MONTH) ORDER BY ms DESC LIMIT 24"""))
def f9_month_trend(spark, sf):
    return TS.month_trend(T.sales(spark, sf), 24)


@query("f10_volatility", O.with_sales("""
SELECT arg_min(MONTH, (-amt, MONTH)) AS max_month, max(amt) AS max_amt,
       arg_min(MONTH, (amt, MONTH)) AS min_month, min(amt) AS min_amt,
       CASE WHEN max(amt) <> 0 THEN ROUND((max(amt) - min(amt)) / max(amt) * 100, 1) END AS volatility_pct
FROM (SELECT MONTH, CAST(SUM(AMOUNT) AS DOUBLE) AS amt FROM sales WHERE MONTH IS NOT NULL GROUP BY MONTH)"""))
def f10_volatility(spark, sf):
    return TS.volatility(T.sales(spark, sf))


@query("f11_forecast", O.with_sales("""
SELECT months,
       CASE WHEN ok THEN slope END AS slope, CASE WHEN ok THEN intercept END AS intercept,
       CASE WHEN ok THEN intercept + slope * n END AS forecast
FROM (SELECT *, (sy - slope * sx) / n AS intercept FROM (
  SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, months >= 3 AND (n * sxx - sx * sx) <> 0 AS ok FROM (
    SELECT count(*) AS months, CAST(count(*) AS DOUBLE) AS n, CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(x * x) AS DOUBLE) AS sxx,
           CAST(SUM(y) AS DOUBLE) AS sy, CAST(SUM(y * x) AS DOUBLE) AS sxy
    FROM (SELECT y, row_number() OVER (ORDER BY month_start) - 1 AS x FROM (
      SELECT month_start, COALESCE(SUM(AMOUNT), 0) AS y FROM sales WHERE DATE IS NOT NULL GROUP BY month_start)))))"""))
def f11_forecast(spark, sf):
    return TS.forecast_next_month(T.sales(spark, sf))


# ------------------------------------------------------------------ G: ranking, share, Pareto
def _rev_by(dim: str, where: str = "") -> str:
    w = f"WHERE {dim} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"SELECT {dim}, COALESCE(SUM(AMOUNT), 0) AS v FROM sales {w} GROUP BY {dim}"


@query("g1_top_customers", O.with_sales(
    "SELECT CUSTOMER_NAME, CAST(v AS DOUBLE) AS AMOUNT FROM (" + _rev_by("CUSTOMER_NAME") + ") ORDER BY v DESC, CUSTOMER_NAME LIMIT 10"))
def g1_top_customers(spark, sf):
    return G.top_n(T.sales(spark, sf), M.CUSTOMER, 10)


@query("g1_top_groups", O.with_sales(
    "SELECT ITEM_NAME_GROUP, CAST(v AS DOUBLE) AS AMOUNT FROM (" + _rev_by("ITEM_NAME_GROUP") + ") ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 10"))
def g1_top_groups(spark, sf):
    return G.top_n(T.sales(spark, sf), M.ITEM_GROUP, 10)


@query("g2_top_others", O.with_sales(f"""
SELECT label, AMOUNT FROM (
  SELECT CUSTOMER_NAME AS label, CAST(v AS DOUBLE) AS AMOUNT FROM ({_rev_by('CUSTOMER_NAME')}) ORDER BY v DESC, CUSTOMER_NAME LIMIT 10)
UNION ALL
SELECT 'Others', CAST(alls - tops AS DOUBLE) FROM
  (SELECT count(*) AS n, SUM(v) AS alls FROM ({_rev_by('CUSTOMER_NAME')})),
  (SELECT SUM(v) AS tops FROM (SELECT v FROM ({_rev_by('CUSTOMER_NAME')}) ORDER BY v DESC, CUSTOMER_NAME LIMIT 10))
WHERE n > 10 AND alls - tops > 0"""))
def g2_top_others(spark, sf):
    return G.top_n_others(T.sales(spark, sf), M.CUSTOMER, 10)


@query("g3_state_scorecard", O.with_sales("""
SELECT STATE, CAST(rev AS DOUBLE) AS Revenue, Orders, Customers,
       CASE WHEN total > 0 THEN ROUND(CAST(rev AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1) ELSE 0.0 END AS MarketShare,
       CAST(ROUND(rev / CAST(10000000 AS DECIMAL(10,0)), 2) AS DOUBLE) AS Revenue_Cr
FROM (SELECT STATE, COALESCE(SUM(AMOUNT), 0) AS rev, COUNT(DISTINCT INVOICE_NO) AS Orders,
             COUNT(DISTINCT CUSTOMER_NAME) AS Customers
      FROM sales WHERE STATE IS NOT NULL AND upper(STATE) NOT LIKE '%NOT FOUND%' GROUP BY STATE),
     (SELECT SUM(AMOUNT) AS total FROM sales WHERE STATE IS NOT NULL AND upper(STATE) NOT LIKE '%NOT FOUND%')"""))
def g3_state_scorecard(spark, sf):
    return G.state_scorecard(T.sales(spark, sf))


@query("g4_city_scorecard", O.with_sales("""
SELECT CITY, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue, COUNT(DISTINCT CUSTOMER_NAME) AS Customers
FROM sales WHERE CITY IS NOT NULL GROUP BY CITY ORDER BY Revenue DESC, CITY LIMIT 20"""))
def g4_city_scorecard(spark, sf):
    return G.city_scorecard(T.sales(spark, sf), 20)


@query("g5_group_performance", O.with_sales("""
SELECT ITEM_NAME_GROUP, CAST(rev AS DOUBLE) AS Revenue, Orders, Customers, AvgPrice, Share,
       CAST(ROUND(SUM(CAST(Share AS DECIMAL(9,1))) OVER (ORDER BY rev DESC, ITEM_NAME_GROUP
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS DOUBLE) AS CumulativeShare
FROM (SELECT *, ROUND(CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER () AS DOUBLE) * 100, 1) AS Share FROM (
  SELECT ITEM_NAME_GROUP, COALESCE(SUM(AMOUNT), 0) AS rev, COUNT(DISTINCT INVOICE_NO) AS Orders,
         COUNT(DISTINCT CUSTOMER_NAME) AS Customers, CAST(SUM(AMOUNT) AS DOUBLE) / COUNT(AMOUNT) AS AvgPrice
  FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL GROUP BY ITEM_NAME_GROUP))"""))
def g5_group_performance(spark, sf):
    return G.group_performance(T.sales(spark, sf))


ABC_SQL = """
SELECT ITEM_NAME_GROUP, CAST(rev AS DOUBLE) AS AMOUNT, Percentage, Cumulative,
       CASE WHEN Cumulative <= 80 THEN 'A' WHEN Cumulative <= 95 THEN 'B' ELSE 'C' END AS Class
FROM (SELECT *, CAST(ROUND(SUM(CAST(Percentage AS DECIMAL(9,1))) OVER (ORDER BY rev DESC, ITEM_NAME_GROUP
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS DOUBLE) AS Cumulative
  FROM (SELECT *, ROUND(CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER () AS DOUBLE) * 100, 1) AS Percentage FROM (
    SELECT ITEM_NAME_GROUP, COALESCE(SUM(AMOUNT), 0) AS rev FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL GROUP BY ITEM_NAME_GROUP)))"""


@query("g6_abc_pareto", O.with_sales(ABC_SQL))
def g6_abc_pareto(spark, sf):
    return G.abc_pareto(T.sales(spark, sf))


@query("g7_class_counts", O.with_sales(f"SELECT Class, count(*) AS n FROM ({ABC_SQL}) GROUP BY Class"))
def g7_class_counts(spark, sf):
    return G.class_counts(G.abc_pareto(T.sales(spark, sf)))


@query("g8_pareto_customers", O.with_sales(f"""
SELECT CUSTOMER_NAME, CAST(v AS DOUBLE) AS AMOUNT,
       CAST(SUM(v) OVER (ORDER BY v DESC, CUSTOMER_NAME ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / CAST((SELECT SUM(AMOUNT) FROM sales WHERE CUSTOMER_NAME IS NOT NULL) AS DOUBLE) * 100 AS cum_percent
FROM ({_rev_by('CUSTOMER_NAME')}) ORDER BY v DESC, CUSTOMER_NAME LIMIT 50"""))
def g8_pareto_customers(spark, sf):
    return G.pareto(T.sales(spark, sf), M.CUSTOMER, 50)


@query("g8_top_share_items", O.with_sales(f"""
SELECT n AS entities, CAST(floor(n * 0.2) AS BIGINT) AS top_count, CAST(top AS DOUBLE) AS top_revenue,
       CASE WHEN total <> 0 THEN CAST(top AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS share_pct
FROM (SELECT count(*) AS n, COALESCE(SUM(v), 0) AS total,
             COALESCE(SUM(CASE WHEN rk <= floor(cnt * 0.2) THEN v END), 0) AS top
      FROM (SELECT v, row_number() OVER (ORDER BY v DESC, ITEMNAME) AS rk, count(*) OVER () AS cnt
            FROM ({_rev_by('ITEMNAME')})))"""))
def g8_top_share_items(spark, sf):
    return G.top_share(T.sales(spark, sf), M.ITEM, 0.2)


def _classes_sql(grp: str) -> str:
    return f"""
SELECT {grp}, CAST(rev AS DOUBLE) AS Revenue, Orders, CAST(rev AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS Share,
       CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS CumShare,
       CASE WHEN CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 <= 70 THEN 'High Value'
            WHEN CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 <= 90 THEN 'Medium Value' ELSE 'Low Value' END AS Classification
FROM (SELECT *, SUM(rev) OVER (ORDER BY rev DESC, {grp} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             SUM(rev) OVER () AS total
      FROM (SELECT {grp}, COALESCE(SUM(AMOUNT), 0) AS rev, COUNT(DISTINCT INVOICE_NO) AS Orders
            FROM sales WHERE {grp} IS NOT NULL GROUP BY {grp}))"""


@query("g9_classify_categories", O.with_sales(_classes_sql("ITEMNAME")))
def g9_classify_categories(spark, sf):
    return G.classify_categories(T.sales(spark, sf), M.ITEM)


@query("g10_consolidation_candidates", O.with_sales(f"""
SELECT *, Revenue / Orders AS Avg_Order_Value FROM ({_classes_sql('CUSTOMER_NAME')})
WHERE Classification IN ('Low Value', 'Medium Value')
  AND Orders > (SELECT CAST(SUM(o) AS DOUBLE) / count(*) FROM (
        SELECT COUNT(DISTINCT INVOICE_NO) AS o FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY CUSTOMER_NAME))"""))
def g10_consolidation_candidates(spark, sf):
    return G.consolidation_candidates(T.sales(spark, sf), M.CUSTOMER)


@query("g11_consolidation_zone", O.with_sales("""
SELECT ITEMNAME, Revenue, Orders, AOV FROM s, (SELECT CAST(SUM(Orders) AS DOUBLE) / count(*) AS ao, SUM(AOV) / count(*) AS av FROM s)
WHERE Orders > ao AND AOV < av ORDER BY Orders DESC, ITEMNAME LIMIT 10""", """s AS (SELECT ITEMNAME, Revenue, Orders, Revenue / Orders AS AOV FROM (
  SELECT ITEMNAME, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
  FROM sales WHERE ITEMNAME IS NOT NULL GROUP BY ITEMNAME) WHERE Revenue > 0)"""))
def g11_consolidation_zone(spark, sf):
    return G.consolidation_zone(T.sales(spark, sf), M.ITEM, 10)


@query("g12_core_tail", O.with_sales("""
SELECT CUSTOMER_NAME,
       count(CASE WHEN cum <= 90 THEN 1 END) AS core_count,
       CAST(COALESCE(SUM(CASE WHEN cum <= 90 THEN s END), 0) AS DOUBLE) AS core_spend,
       count(CASE WHEN NOT (cum <= 90) THEN 1 END) AS tail_count,
       CAST(COALESCE(SUM(CASE WHEN NOT (cum <= 90) THEN s END), 0) AS DOUBLE) AS tail_spend,
       count(CASE WHEN share < 2.0 AND share > 0 THEN 1 END) AS micro_count,
       CAST(COALESCE(SUM(CASE WHEN share < 2.0 AND share > 0 THEN s END), 0) AS DOUBLE) AS micro_spend,
       CAST(COALESCE(SUM(CASE WHEN share < 2.0 AND share > 0 THEN s END), 0) * CAST(0.12 AS DECIMAL(3,2)) AS DOUBLE) AS opportunity
FROM (SELECT CUSTOMER_NAME, s,
             CAST(s AS DOUBLE) / CAST(et AS DOUBLE) * 100 AS share,
             CAST(c AS DOUBLE) / CAST(et AS DOUBLE) * 100 AS cum
      FROM (SELECT *, SUM(s) OVER (PARTITION BY CUSTOMER_NAME ORDER BY s DESC, ITEMNAME
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
                   SUM(s) OVER (PARTITION BY CUSTOMER_NAME) AS et
            FROM (SELECT CUSTOMER_NAME, ITEMNAME, COALESCE(SUM(AMOUNT), 0) AS s FROM sales
                  WHERE CUSTOMER_NAME IS NOT NULL AND ITEMNAME IS NOT NULL GROUP BY CUSTOMER_NAME, ITEMNAME)))
GROUP BY CUSTOMER_NAME"""))
def g12_core_tail(spark, sf):
    return G.core_tail(T.sales(spark, sf), M.CUSTOMER, M.ITEM)


@query("g13_concentration", O.with_sales(f"""
SELECT 5 AS k, ROUND(pct, 2) AS top_pct, CASE WHEN pct > 60 THEN 'high' ELSE 'healthy' END AS verdict
FROM (SELECT CASE WHEN total <> 0 THEN CAST(top AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS pct FROM
  (SELECT SUM(v) AS top FROM (SELECT v FROM ({_rev_by('CUSTOMER_NAME')}) ORDER BY v DESC, CUSTOMER_NAME LIMIT 5)),
  (SELECT SUM(v) AS total FROM ({_rev_by('CUSTOMER_NAME')})))"""))
def g13_concentration(spark, sf):
    return G.concentration(T.sales(spark, sf), 5, 60.0)


@query("g14_contribution", O.with_sales(f"""
SELECT CUSTOMER_NAME, CAST(v AS DOUBLE) AS sales, ROUND(CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE) * 100, 2) AS pct
FROM ({_rev_by('CUSTOMER_NAME')})"""))
def g14_contribution(spark, sf):
    return G.contribution(T.sales(spark, sf))


ITEM_SQL = """SELECT ITEMNAME AS Item, ITEM_NAME_GROUP AS Category, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue,
       COUNT(DISTINCT INVOICE_NO) AS Orders, CAST(COALESCE(SUM(QTY), 0) AS DOUBLE) AS Quantity
FROM sales WHERE ITEMNAME IS NOT NULL AND ITEM_NAME_GROUP IS NOT NULL GROUP BY ITEMNAME, ITEM_NAME_GROUP"""


@query("g15_item_details", O.with_sales(ITEM_SQL))
def g15_item_details(spark, sf):
    return G.item_details(T.sales(spark, sf))


@query("g16_item_group_top25", O.with_sales(ITEM_SQL + " ORDER BY Revenue DESC, Item, Category LIMIT 25"))
def g16_item_group_top25(spark, sf):
    return G.item_details(T.sales(spark, sf), 25)


@query("g17_group_deep_dive", O.with_sales("""
SELECT g.ITEM_NAME_GROUP, CAST(v AS DOUBLE) AS Total_Revenue,
       CASE WHEN total > 0 THEN ROUND(CAST(v AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1) ELSE 0.0 END AS share_pct,
       COALESCE(m.modal_item, 'N/A') AS modal_item, Order_Count
FROM (SELECT ITEM_NAME_GROUP, COALESCE(SUM(AMOUNT), 0) AS v, COUNT(DISTINCT INVOICE_NO) AS Order_Count
      FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL GROUP BY ITEM_NAME_GROUP ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 8) g
LEFT JOIN (SELECT ITEM_NAME_GROUP, arg_min(ITEMNAME, (-c, ITEMNAME)) AS modal_item FROM (
    SELECT ITEM_NAME_GROUP, ITEMNAME, count(*) AS c FROM sales
    WHERE ITEM_NAME_GROUP IS NOT NULL AND ITEMNAME IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m
  ON g.ITEM_NAME_GROUP = m.ITEM_NAME_GROUP,
  (SELECT COALESCE(SUM(AMOUNT), 0) AS total FROM sales)"""))
def g17_group_deep_dive(spark, sf):
    return G.group_deep_dive(T.sales(spark, sf), 8)


@query("g18_pivot_top_long", O.with_sales(f"""
SELECT tp.STATE, ts.ITEM_NAME_GROUP, CAST(COALESCE(x.v, 0) AS DOUBLE) AS AMOUNT
FROM (SELECT STATE FROM ({_rev_by('STATE')}) ORDER BY v DESC, STATE LIMIT 8) tp
CROSS JOIN (SELECT ITEM_NAME_GROUP FROM ({_rev_by('ITEM_NAME_GROUP')}) ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 6) ts
LEFT JOIN (SELECT STATE, ITEM_NAME_GROUP, SUM(AMOUNT) AS v FROM sales GROUP BY 1, 2) x
  ON x.STATE = tp.STATE AND x.ITEM_NAME_GROUP = ts.ITEM_NAME_GROUP"""))
def g18_pivot_top_long(spark, sf):
    return G.pivot_top_long(T.sales(spark, sf), M.STATE, M.ITEM_GROUP, 8, 6)


@query("g19_leader_state", O.with_sales(f"""
SELECT 'STATE' AS dim, arg_min(STATE, (-v, STATE)) AS value, CAST(max(v) AS DOUBLE) AS AMOUNT,
       CASE WHEN SUM(v) > 0 THEN ROUND(CAST(max(v) AS DOUBLE) / CAST(SUM(v) AS DOUBLE) * 100, 1) ELSE 0.0 END AS share,
       count(*) AS active
FROM ({_rev_by('STATE')})"""))
def g19_leader_state(spark, sf):
    return G.leader(T.sales(spark, sf), M.STATE)


@query("g21_product_mix", O.with_sales("""
SELECT x.CUSTOMER_NAME, rank, ITEM_NAME_GROUP, CAST(v AS DOUBLE) AS Revenue,
       ROUND(CAST(v AS DOUBLE) / CAST(t.et AS DOUBLE) * 100, 1) AS share_pct
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY CUSTOMER_NAME ORDER BY v DESC, ITEM_NAME_GROUP) AS INTEGER) AS rank
      FROM (SELECT CUSTOMER_NAME, ITEM_NAME_GROUP, COALESCE(SUM(AMOUNT), 0) AS v FROM sales
            WHERE CUSTOMER_NAME IS NOT NULL AND ITEM_NAME_GROUP IS NOT NULL GROUP BY 1, 2)) x
JOIN (SELECT CUSTOMER_NAME, SUM(AMOUNT) AS et FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY 1) t
  ON x.CUSTOMER_NAME = t.CUSTOMER_NAME
WHERE rank <= 9 AND t.et > 0"""))
def g21_product_mix(spark, sf):
    return G.product_mix(T.sales(spark, sf), 9)


@query("g22_category_table", O.with_sales("""
SELECT ITEM_NAME_GROUP, Revenue, Orders, CASE WHEN Orders > 0 THEN Revenue / Orders ELSE 0.0 END AS AOV FROM (
  SELECT ITEM_NAME_GROUP, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
  FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL GROUP BY 1) ORDER BY Revenue DESC, ITEM_NAME_GROUP LIMIT 15"""))
def g22_category_table(spark, sf):
    return G.category_table(T.sales(spark, sf), 15)


@query("g23_dimension_table_fy", O.with_sales("""
SELECT FINANCIAL_YEAR AS label, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders,
       COUNT(DISTINCT CUSTOMER_NAME) AS Customers
FROM sales WHERE FINANCIAL_YEAR IS NOT NULL GROUP BY 1 ORDER BY Revenue DESC, label LIMIT 3"""))
def g23_dimension_table_fy(spark, sf):
    return G.dimension_table(T.sales(spark, sf), "fiscal_year", 2)


@query("g24_state_report_customers", O.with_sales("""
SELECT CUSTOMER_NAME, CAST(SUM(AMOUNT) AS DOUBLE) AS AMOUNT FROM sales WHERE STATE = 'AMERICA' AND CUSTOMER_NAME IS NOT NULL
GROUP BY 1 ORDER BY AMOUNT DESC, CUSTOMER_NAME LIMIT 30"""))
def g24_state_report_customers(spark, sf):
    return G.report(T.sales(spark, sf), "state", "AMERICA")["customers"]


@query("g24_month_report_items", O.with_sales(ITEM_SQL.replace("WHERE ITEMNAME", "WHERE MONTH = 'MAR-98' AND ITEMNAME")))
def g24_month_report_items(spark, sf):
    return G.report(T.sales(spark, sf), "month", "MAR-98")["items"]


# ------------------------------------------------------------------ H: customers
from .operators import customers as H  # noqa: E402

RFM_BASE_SQL = """rfm_base AS (
  SELECT CUSTOMER_NAME, CAST(floor((epoch(mx) - epoch(last)) / 86400) AS BIGINT) AS Recency, Frequency, money,
         CAST(floor((epoch(last) - epoch(first)) / 86400) AS BIGINT) AS Tenure, s, lines
  FROM (SELECT CUSTOMER_NAME, max(DATE) AS last, min(DATE) AS first, COUNT(DISTINCT INVOICE_NO) AS Frequency,
               COALESCE(SUM(AMOUNT), 0) AS money, SUM(AMOUNT) AS s, COUNT(AMOUNT) AS lines
        FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY CUSTOMER_NAME),
       (SELECT max(DATE) AS mx FROM sales)),
rfm_edges AS (
  SELECT *, quantile_cont(CAST(Recency AS DOUBLE), [0.25, 0.5, 0.75]) OVER () AS er,
            quantile_cont(CAST(Frequency AS DOUBLE), [0.25, 0.5, 0.75]) OVER () AS ef,
            quantile_cont(CAST(money AS DOUBLE), [0.25, 0.5, 0.75]) OVER () AS em,
            count(*) OVER () AS n,
            row_number() OVER (ORDER BY Frequency, CUSTOMER_NAME) AS rk
  FROM rfm_base)"""


def _bins(v: str, e: str) -> str:
    return f"(CAST({v} > {e}[1] AS INTEGER) + CAST({v} > {e}[2] AS INTEGER) + CAST({v} > {e}[3] AS INTEGER))"


@query("h1_customer_rollup", O.with_sales("""
SELECT CUSTOMER_NAME, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders,
       CAST(SUM(AMOUNT) AS DOUBLE) / COUNT(AMOUNT) AS AvgOrder, strftime(max(DATE), '%Y-%m-%d') AS LastOrder
FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY CUSTOMER_NAME"""))
def h1_customer_rollup(spark, sf):
    return H.customer_rollup(T.sales(spark, sf))


H2_SQL = O.with_sales(f"""
SELECT CUSTOMER_NAME, Recency, Frequency, CAST(money AS DOUBLE) AS Monetary,
       CASE WHEN score >= 10 THEN 'Champions' WHEN score >= 8 THEN 'Loyal' WHEN score >= 6 THEN 'Potential'
            WHEN score >= 4 THEN 'At Risk' ELSE 'Lost' END AS Segment
FROM (SELECT *, (4 - {_bins('Recency', 'er')}) + (1 + {_bins('Frequency', 'ef')}) + (1 + {_bins('CAST(money AS DOUBLE)', 'em')}) AS score
      FROM rfm_edges)""", RFM_BASE_SQL)


@query("h2_rfm_segments", H2_SQL)
def h2_rfm_segments(spark, sf):
    return H.rfm_segments(T.sales(spark, sf))


H3_SQL = O.with_sales(f"""
SELECT CUSTOMER_NAME, Recency, Frequency, CAST(money AS DOUBLE) AS Monetary, R_Score, F_Score, M_Score,
       CASE WHEN R_Score = 'Lost' THEN 'Inactive'
            WHEN R_Score = 'At Risk' AND F_Score IN ('Loyal', 'Frequent') THEN 'Retention Opportunities'
            WHEN R_Score = 'Active' AND F_Score = 'Frequent' THEN 'Consistent Buyers'
            WHEN R_Score = 'Active' AND F_Score = 'Loyal' THEN 'Strategic Accounts'
            ELSE 'Standard' END AS Segment
FROM (SELECT *,
        ['Active', 'At Risk', 'Churning', 'Lost'][{_bins('Recency', 'er')} + 1] AS R_Score,
        ['One-time', 'Rare', 'Frequent', 'Loyal'][CAST(4 * (rk - 1) > (n - 1) AS INTEGER) + CAST(4 * (rk - 1) > 2 * (n - 1) AS INTEGER)
                                                  + CAST(4 * (rk - 1) > 3 * (n - 1) AS INTEGER) + 1] AS F_Score,
        ['Low', 'Medium', 'High', 'VIP'][{_bins('CAST(money AS DOUBLE)', 'em')} + 1] AS M_Score
      FROM rfm_edges WHERE n >= 4)""", RFM_BASE_SQL)


@query("h3_rfm_labels", H3_SQL)
def h3_rfm_labels(spark, sf):
    return H.rfm_labels(T.sales(spark, sf))


@query("h4_segment_rollup", O.with_sales(
    f"SELECT Segment, count(*) AS Count, COALESCE(CAST(SUM(CAST(Monetary AS DECIMAL(26,4))) AS DOUBLE), 0.0) AS Revenue FROM ({H3_SQL[H3_SQL.index('SELECT CUSTOMER_NAME, Recency'):]}) GROUP BY Segment",
    RFM_BASE_SQL))
def h4_segment_rollup(spark, sf):
    return H.segment_rollup(H.rfm_labels(T.sales(spark, sf)))


@query("h5_churn_features", O.with_sales("""
SELECT CUSTOMER_NAME, Recency, Frequency, CAST(money AS DOUBLE) AS Monetary, Tenure,
       CAST(s AS DOUBLE) / lines AS Avg_Order_Value, CAST(Recency > 90 AS INTEGER) AS Is_Churned
FROM rfm_base""", RFM_BASE_SQL))
def h5_churn_features(spark, sf):
    return H.churn_features(T.sales(spark, sf))


@query("h6_churn_scores")
def h6_churn_scores(spark, sf):
    return H.churn_scores(H.churn_features(T.sales(spark, sf)))


@query("h6_churn_invariants", O.with_sales("""
SELECT count(*) AS customers, count(*) AS in_range, count(*) FILTER (WHERE Recency > 90) = 0 AS only_active
FROM rfm_base WHERE Recency <= 90""", RFM_BASE_SQL))
def h6_churn_invariants(spark, sf):
    """What SQL can say of the scores: the active customers, each with a probability in per cent."""
    p = h6_churn_scores(spark, sf)
    return p.agg(F.count_distinct(M.CUSTOMER).alias("customers"), F.count(F.when(F.col("Churn_Probability").between(0, 100), 1)).alias("in_range"),
                 (F.count(F.when(F.col("Recency") > 90, 1)) == 0).alias("only_active"))


@query("h7_customer_risk", O.with_sales("""
SELECT CUSTOMER_NAME, COUNT(DISTINCT INVOICE_NO) AS Orders, strftime(max(DATE), '%Y-%m-%d') AS LastOrder,
       COUNT(DISTINCT INVOICE_NO) <= 1 AS single_order,
       COALESCE((epoch(TIMESTAMP '2001-08-01') - epoch(CAST(CAST(max(DATE) AS DATE) AS TIMESTAMP))) / 86400 > 90, false) AS inactive_90
FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY CUSTOMER_NAME"""))
def h7_customer_risk(spark, sf):
    return H.customer_risk(T.sales(spark, sf), "2001-08-01")


@query("h8_revenue_drops", O.with_sales("""
SELECT CUSTOMER_NAME AS entity, 'customer' AS entity_type, cv AS current_revenue, pv AS previous_revenue,
       ROUND((cv - pv) / pv * 100, 1) AS change_pct
FROM (SELECT CUSTOMER_NAME,
             CAST(COALESCE(SUM(CASE WHEN cur THEN AMOUNT END), 0) AS DOUBLE) AS cv, count(CASE WHEN cur THEN 1 END) AS cn,
             CAST(COALESCE(SUM(CASE WHEN NOT cur THEN AMOUNT END), 0) AS DOUBLE) AS pv, count(CASE WHEN NOT cur THEN 1 END) AS pn
      FROM (SELECT *, DATE >= TIMESTAMP '1999-01-01' AS cur FROM sales
            WHERE DATE >= TIMESTAMP '1997-12-31' AND DATE < TIMESTAMP '2000-01-01' AND CUSTOMER_NAME IS NOT NULL)
      GROUP BY CUSTOMER_NAME)
WHERE cn > 0 AND pn > 0 AND pv > 0 AND cv < pv AND (cv - pv) / pv * 100 <= -20.0
ORDER BY change_pct, entity LIMIT 20"""))
def h8_revenue_drops(spark, sf):
    return H.revenue_drops(T.sales(spark, sf), "1999-01-01", "1999-12-31", 20.0, 20)


# ------------------------------------------------------------------ C: ingest transforms (on dirty_sales)
from .operators import ingest as C  # noqa: E402
from .operators import quality as K  # noqa: E402

DIRTY_COLS = ["DATE", "INVOICE_NO", "CUSTOMER_NAME", "ITEMNAME", "ITEM_NAME_GROUP", "MATERIALGROUP", "CITY", "STATE",
              "REGION", "QTY", "AMOUNT", "tenant_id"]


def _out(df: DataFrame) -> DataFrame:
    """Output edge of row-level queries: money as double, timestamps as ISO text
    (as the reference's JSON output renders them)."""
    from pyspark.sql import types as Ty

    def edge(f):
        if isinstance(f.dataType, Ty.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (Ty.TimestampType, Ty.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return F.col(f.name)

    return df.select(*[edge(f) for f in df.schema.fields])


TS_SQL = "strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE"


def _sql_cols(cols, overrides: dict[str, str] | None = None) -> str:
    overrides = overrides or {}
    out = []
    for c in cols:
        if c in overrides:
            out.append(f"{overrides[c]} AS {c}")
        elif c == "AMOUNT":
            out.append("CAST(AMOUNT AS DOUBLE) AS AMOUNT")
        elif c == "DATE":
            out.append(TS_SQL)
        else:
            out.append(c)
    return ", ".join(out)


RAW_HEADERS = {  # messy upload headers over dirty_sales columns (C1/C2 input)
    "DATE": " Date", "INVOICE_NO": "Invoice No.", "CUSTOMER_NAME": "Party Name", "ITEMNAME": "Item.Name",
    "ITEM_NAME_GROUP": "Item Name Group", "MATERIALGROUP": "Material Group", "CITY": "City/Town",
    "STATE": "State ", "REGION": "Region", "QTY": "Qty", "AMOUNT": "Amount", "tenant_id": "tenant_id",
}
STD_NAMES = {"DATE": "DATE", "INVOICE_NO": "INVOICE_NO", "CUSTOMER_NAME": "CUSTOMER_NAME", "ITEMNAME": "ITEMNAME",
             "ITEM_NAME_GROUP": "ITEM_NAME_GROUP", "MATERIALGROUP": "MATERIAL_GROUP", "CITY": "CITY", "STATE": "STATE",
             "REGION": "REGION", "QTY": "QTY", "AMOUNT": "AMOUNT", "tenant_id": "TENANT_ID"}


def raw_upload(spark, sf) -> DataFrame:
    d = T.dirty_sales(spark, sf)
    return d.select(*[F.col(c).alias(RAW_HEADERS[c]) for c in DIRTY_COLS])


def city_map(spark, sf) -> DataFrame:
    """A city -> state map derived from the nation/region tables."""
    n = T.table(spark, sf, "nation").alias("n")
    r = T.table(spark, sf, "region").alias("r")
    return (n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey"))
             .select(F.upper(F.col("n.n_name")).alias("CITY_KEY"), F.col("r.r_name").alias("MAPPED_STATE")))


CITY_MAP_SQL = """city_map AS (SELECT upper(n.n_name) AS CITY_KEY, r.r_name AS MAPPED_STATE
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""


@query("c1_c2_standardize_headers", O.with_dirty(
    "SELECT " + ", ".join(TS_SQL if c == "DATE" else f"{c} AS {STD_NAMES[c]}" if c != "AMOUNT"
                          else "CAST(AMOUNT AS DOUBLE) AS AMOUNT" for c in DIRTY_COLS) + " FROM dirty_sales"))
def c1_c2_standardize_headers(spark, sf):
    return _out(C.standardize_headers(raw_upload(spark, sf)))


@query("c3_upper_strings", O.with_dirty("SELECT " + _sql_cols(
    DIRTY_COLS, {c: f"upper({O.strip_sql(c)})" for c in DIRTY_COLS
                 if c not in ("DATE", "QTY", "AMOUNT")}) + " FROM dirty_sales"))
def c3_upper_strings(spark, sf):
    return _out(C.upper_strings(T.dirty_sales(spark, sf)))


COALESCE_STATE_SQL = f"""CASE WHEN s2 = '' THEN 'State Not Found' ELSE s2 END"""
C4_INNER = f"""SELECT *, {O.strip_sql("COALESCE(CASE WHEN COALESCE(" + O.strip_sql("STATE") + ", '') = '' OR COALESCE(upper(STATE) LIKE '%NOT FOUND%', false) THEN " + O.strip_sql("COALESCE(REGION, '')") + " ELSE STATE END, '')")} AS s2 FROM dirty_sales"""


@query("c4_coalesce_state", O.with_dirty("SELECT " + _sql_cols(
    [c for c in DIRTY_COLS if c != "REGION"], {"STATE": COALESCE_STATE_SQL}) + f" FROM ({C4_INNER})"))
def c4_coalesce_state(spark, sf):
    return _out(C.coalesce_state(T.dirty_sales(spark, sf)))


MASTER_DEDUP_SQL = """master_dedup AS (SELECT CUSTOMER_NAME, STATE, CITY FROM (
  SELECT *, row_number() OVER (PARTITION BY CUSTOMER_NAME ORDER BY STATE IS NULL, STATE, CITY IS NULL, CITY) AS rn
  FROM master) WHERE rn = 1)"""


@query("c5_enrich_customers", O.with_dirty("SELECT " + _sql_cols(
    DIRTY_COLS, {"STATE": "COALESCE(m.STATE, d.STATE)", "CITY": "COALESCE(m.CITY, d.CITY)",
                 "CUSTOMER_NAME": "d.CUSTOMER_NAME"})
    + " FROM dirty_sales d LEFT JOIN master_dedup m ON d.CUSTOMER_NAME IS NOT DISTINCT FROM m.CUSTOMER_NAME",
    O.MASTER, MASTER_DEDUP_SQL))
def c5_enrich_customers(spark, sf):
    d = C.enrich_customers(T.dirty_sales(spark, sf), T.customer_master(spark, sf))
    return _out(d.select(*DIRTY_COLS))


@query("c6_fill_state_from_city", O.with_dirty("SELECT " + _sql_cols(DIRTY_COLS, {
    "STATE": "CASE WHEN d.STATE IS NULL OR trim(d.STATE) = '' OR upper(d.STATE) LIKE '%NOT FOUND%' "
             "THEN COALESCE(cm.MAPPED_STATE, 'State Not Found') ELSE d.STATE END", "CITY": "d.CITY"})
    + f" FROM dirty_sales d LEFT JOIN city_map cm ON upper({O.strip_sql('d.CITY')}) = cm.CITY_KEY", CITY_MAP_SQL))
def c6_fill_state_from_city(spark, sf):
    d = C.fill_state_from_city(T.dirty_sales(spark, sf), city_map(spark, sf))
    return _out(d.select(*DIRTY_COLS))


@query("c7_c9_add_calendar", O.with_dirty("""
SELECT INVOICE_NO, strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE,
       CASE WHEN DATE IS NULL THEN 'UNKNOWN' ELSE
         'FY' || CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END) % 100 AS VARCHAR) || '-' ||
         CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR) END AS FINANCIAL_YEAR,
       upper(strftime(DATE, '%b-%y')) AS MONTH,
       CAST(year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END AS DOUBLE) AS fy_start,
       strftime(date_trunc('month', DATE), '%Y-%m-%d') AS month_start
FROM dirty_sales"""))
def c7_c9_add_calendar(spark, sf):
    d = C.add_calendar(T.dirty_sales(spark, sf))
    return d.select(M.INVOICE_NO, F.date_format(M.DATE, "yyyy-MM-dd HH:mm:ss").alias(M.DATE), M.FY, M.MONTH,
                    F.col(M.FY_START).cast("double").alias(M.FY_START),
                    F.date_format(M.MONTH_START, "yyyy-MM-dd").alias(M.MONTH_START))


@query("c11_map_groups", O.with_dirty(
    f"SELECT INVOICE_NO, ITEMNAME, {O.map_groups_sql('ITEM_NAME_GROUP')} AS ITEM_NAME_GROUP FROM dirty_sales"))
def c11_map_groups(spark, sf):
    return C.map_groups(T.dirty_sales(spark, sf)).select(M.INVOICE_NO, M.ITEM, M.ITEM_GROUP)


@query("c12_exclude_groups", O.with_dirty(
    f"SELECT INVOICE_NO, ITEMNAME, ITEM_NAME_GROUP FROM dirty_sales WHERE NOT {O.excluded_sql('ITEM_NAME_GROUP')}"))
def c12_exclude_groups(spark, sf):
    return C.exclude_groups(T.dirty_sales(spark, sf)).select(M.INVOICE_NO, M.ITEM, M.ITEM_GROUP)


def _tax_sql(home: str) -> str:
    intra = f"upper(trim(COALESCE(STATE, 'Unknown'))) IN ('{home}', 'UNKNOWN', 'STATE NOT FOUND')"
    return f"""SELECT INVOICE_NO, STATE, CAST(AMOUNT AS DOUBLE) AS AMOUNT,
       CAST(CASE WHEN {intra} THEN 0 ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS IGST,
       CAST(CASE WHEN {intra} THEN AMOUNT * CAST(0.09 AS DECIMAL(3,2)) ELSE 0 END AS DOUBLE) AS CGST,
       CAST(CASE WHEN {intra} THEN AMOUNT * CAST(0.09 AS DECIMAL(3,2)) ELSE 0 END AS DOUBLE) AS SGST,
       CAST(CASE WHEN {intra} THEN 2 * (AMOUNT * CAST(0.09 AS DECIMAL(3,2))) ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS TAX,
       CAST(AMOUNT + CASE WHEN {intra} THEN 2 * (AMOUNT * CAST(0.09 AS DECIMAL(3,2))) ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS TOTALAMOUNT
FROM dirty_sales"""


@query("c13_add_taxes", O.with_dirty(_tax_sql("ASIA")))
def c13_add_taxes(spark, sf):
    d = C.add_taxes(T.dirty_sales(spark, sf), home_state=" asia ")
    return _out(d.select(M.INVOICE_NO, M.STATE, M.AMOUNT, "IGST", "CGST", "SGST", "TAX", "TOTALAMOUNT"))


INGEST_SQL = O.with_dirty(f"""
SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, ITEM_NAME_GROUP,
       MATERIAL_GROUP, CITY, STATE, QTY, CAST(AMOUNT AS DOUBLE) AS AMOUNT, TENANT_ID, FINANCIAL_YEAR, MONTH,
       CAST(CASE WHEN {{intra}} THEN 0 ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS IGST,
       CAST(CASE WHEN {{intra}} THEN AMOUNT * CAST(0.09 AS DECIMAL(3,2)) ELSE 0 END AS DOUBLE) AS CGST,
       CAST(CASE WHEN {{intra}} THEN AMOUNT * CAST(0.09 AS DECIMAL(3,2)) ELSE 0 END AS DOUBLE) AS SGST,
       CAST(CASE WHEN {{intra}} THEN 2 * (AMOUNT * CAST(0.09 AS DECIMAL(3,2))) ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS TAX,
       CAST(AMOUNT + CASE WHEN {{intra}} THEN 2 * (AMOUNT * CAST(0.09 AS DECIMAL(3,2))) ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS DOUBLE) AS TOTALAMOUNT
FROM (
  SELECT *, {O.map_groups_sql('g0')} AS ITEM_NAME_GROUP FROM (
    SELECT DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, ITEM_NAME_GROUP AS g0, MATERIALGROUP AS MATERIAL_GROUP, QTY, AMOUNT,
           tenant_id AS TENANT_ID,
           CASE WHEN s1 IS NULL OR trim(s1) = '' OR upper(s1) LIKE '%NOT FOUND%' THEN COALESCE(cm.MAPPED_STATE, 'State Not Found') ELSE s1 END AS STATE,
           c1 AS CITY,
           CASE WHEN DATE IS NULL THEN 'UNKNOWN' ELSE
             'FY' || CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END) % 100 AS VARCHAR) || '-' ||
             CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR) END AS FINANCIAL_YEAR,
           upper(strftime(DATE, '%b-%y')) AS MONTH
    FROM (SELECT d.*, COALESCE(m.STATE, CASE WHEN d.s2 = '' THEN 'State Not Found' ELSE d.s2 END) AS s1,
                 COALESCE(m.CITY, d.CITY) AS c1
          FROM ({C4_INNER}) d LEFT JOIN master_dedup m ON d.CUSTOMER_NAME IS NOT DISTINCT FROM m.CUSTOMER_NAME) x
    LEFT JOIN city_map cm ON upper({O.strip_sql('x.c1')}) = cm.CITY_KEY))
WHERE NOT {O.excluded_sql('ITEM_NAME_GROUP')}""", O.MASTER, MASTER_DEDUP_SQL, CITY_MAP_SQL).replace(
    "{intra}", "upper(trim(COALESCE(STATE, 'Unknown'))) IN ('MAHARASHTRA', 'UNKNOWN', 'STATE NOT FOUND')")


@query("c18_ingest", INGEST_SQL)
def c18_ingest(spark, sf):
    d = C.ingest(raw_upload(spark, sf), T.customer_master(spark, sf), city_map=city_map(spark, sf))
    return _out(d.drop(M.FY_START, M.MONTH_START))


# ------------------------------------------------------------------ K: data quality (on dirty_sales)
@query("k1_health", O.with_dirty("""
SELECT total_rows, missing_dates, repeat_invoice_rows, negative_amounts, score,
       CASE WHEN total_rows = 0 THEN 'no_data' WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'warning' ELSE 'poor' END AS status
FROM (SELECT *, CASE WHEN total_rows > 0 THEN greatest(0.0, least(100.0, ROUND(
        100.0 - CAST(missing_dates AS DOUBLE) / CAST(total_rows AS DOUBLE) * 30
        - least(CAST(repeat_invoice_rows AS DOUBLE) / greatest(CAST(total_rows AS DOUBLE), 1.0) * 100, 40.0)
        - least(CAST(negative_amounts AS DOUBLE) / greatest(CAST(total_rows AS DOUBLE), 1.0) * 100, 30.0), 1))) ELSE 0.0 END AS score
  FROM (SELECT count(*) AS total_rows, count(*) FILTER (WHERE DATE IS NULL) AS missing_dates,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT INVOICE_NO, DATE FROM dirty_sales)) AS repeat_invoice_rows,
               count(*) FILTER (WHERE AMOUNT < 0) AS negative_amounts FROM dirty_sales))"""))
def k1_health(spark, sf):
    return K.health(T.dirty_sales(spark, sf))


FLAG_SQL = """CASE WHEN COALESCE(AMOUNT <= 0, false) THEN 'Zero/Negative Amount'
     WHEN COALESCE(upper(STATE) LIKE '%UNKNOWN%' OR upper(STATE) LIKE '%NOT FOUND%', false)
       OR COALESCE(upper(CITY) LIKE '%UNKNOWN%' OR upper(CITY) LIKE '%NOT FOUND%', false) THEN 'Missing Location Data'
     ELSE 'Clean' END"""


@query("k2_anomaly_flags", O.with_dirty(
    f"SELECT INVOICE_NO, STATE, CITY, CAST(AMOUNT AS DOUBLE) AS AMOUNT, {FLAG_SQL} AS Anomaly_Flag FROM dirty_sales"))
def k2_anomaly_flags(spark, sf):
    d = K.with_anomaly_flag(T.dirty_sales(spark, sf))
    return _out(d.select(M.INVOICE_NO, M.STATE, M.CITY, M.AMOUNT, "Anomaly_Flag"))


@query("k3_anomaly_counts", O.with_dirty(f"SELECT {FLAG_SQL} AS Anomaly_Flag, count(*) AS n FROM dirty_sales GROUP BY 1"))
def k3_anomaly_counts(spark, sf):
    return K.anomaly_counts(T.dirty_sales(spark, sf))


@query("k3_anomaly_summary", O.with_dirty(f"""
SELECT total_rows, anomalies, CASE WHEN total_rows > 0 THEN (total_rows - anomalies) / total_rows * 100 ELSE 0.0 END AS health_pct
FROM (SELECT count(*) AS total_rows, count(*) FILTER (WHERE {FLAG_SQL} <> 'Clean') AS anomalies FROM dirty_sales)"""))
def k3_anomaly_summary(spark, sf):
    return K.anomaly_summary(T.dirty_sales(spark, sf))


@query("k3_anomaly_rows", O.with_dirty(
    f"SELECT {TS_SQL}, CUSTOMER_NAME, INVOICE_NO, CITY, STATE, CAST(AMOUNT AS DOUBLE) AS AMOUNT, {FLAG_SQL} AS Anomaly_Flag "
    f"FROM dirty_sales WHERE {FLAG_SQL} <> 'Clean'"))
def k3_anomaly_rows(spark, sf):
    return _out(K.anomaly_rows(T.dirty_sales(spark, sf)))


@query("k4_null_counts", O.with_dirty(
    "SELECT \"column\", missing FROM (SELECT unnest([" + ", ".join(
        f"{{'column': '{c}', 'missing': count(*) FILTER (WHERE {c} IS NULL)}}" for c in DIRTY_COLS)
    + "], recursive := true) FROM dirty_sales) WHERE missing > 0"))
def k4_null_counts(spark, sf):
    return K.null_counts(T.dirty_sales(spark, sf))


@query("k5_missing_location", O.with_dirty("""
SELECT INVOICE_NO, CUSTOMER_NAME, CITY, STATE, CAST(AMOUNT AS DOUBLE) AS AMOUNT FROM dirty_sales
WHERE COALESCE(upper(CITY) LIKE '%NOT FOUND%' OR upper(CITY) LIKE '%UNKNOWN%', false)
   OR COALESCE(upper(STATE) LIKE '%NOT FOUND%' OR upper(STATE) LIKE '%UNKNOWN%', false)
   OR COALESCE(upper(STATE) = 'AFRICA', false)"""))
def k5_missing_location(spark, sf):
    return _out(K.missing_location(T.dirty_sales(spark, sf), home_state="Africa"))


@query("k6_reconciliation", O.with_dirty(f"""
SELECT raw_rows, out_rows, raw_rows - out_rows AS diff, raw_amount, out_amount, out_amount - raw_amount AS amount_diff,
       CASE WHEN raw_rows - out_rows > 0 THEN 'LOST' WHEN raw_rows - out_rows < 0 THEN 'GAINED' ELSE 'MATCH' END AS verdict
FROM (SELECT count(*) AS raw_rows, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS raw_amount FROM dirty_sales),
     (SELECT count(*) AS out_rows, CAST(COALESCE(SUM(TOTALAMOUNT), 0) AS DOUBLE) AS out_amount FROM (
        SELECT AMOUNT + CASE WHEN upper(trim(COALESCE(STATE, 'Unknown'))) IN ('MAHARASHTRA', 'UNKNOWN', 'STATE NOT FOUND')
                             THEN 2 * (AMOUNT * CAST(0.09 AS DECIMAL(3,2))) ELSE AMOUNT * CAST(0.18 AS DECIMAL(3,2)) END AS TOTALAMOUNT
        FROM dirty_sales WHERE NOT {O.excluded_sql(O.map_groups_sql('ITEM_NAME_GROUP'))}))"""))
def k6_reconciliation(spark, sf):
    raw = T.dirty_sales(spark, sf)
    processed = C.add_taxes(C.exclude_groups(C.map_groups(raw)))
    return K.reconciliation(raw, processed)


@query("k8_value_distribution", O.with_dirty(
    "SELECT STATE, count(*) AS n FROM dirty_sales WHERE STATE IS NOT NULL GROUP BY STATE"))
def k8_value_distribution(spark, sf):
    return K.value_distribution(T.dirty_sales(spark, sf), M.STATE)


# ------------------------------------------------------------------ G20, M1: insight rows, currency text
def inr_sql(expr: str, prefix: str = "Rs.") -> str:
    v = f"CAST({expr} AS DECIMAL(20,4))"
    sym = f"{prefix} " if prefix else ""

    def unit(factor: str, suffix: str) -> str:
        return (f"'{sym}' || CAST(CAST(ROUND({v} * CAST({factor} AS DECIMAL(9,8)), 2) AS DECIMAL(38,2)) AS VARCHAR)"
                f" || ' {suffix}'")

    return (f"CASE WHEN {v} >= 10000000 THEN {unit('0.0000001', 'Cr')} WHEN {v} >= 100000 THEN {unit('0.00001', 'L')} "
            f"WHEN {v} >= 1000 THEN {unit('0.001', 'K')} ELSE '{sym}' || format('{{:,}}', CAST(ROUND({v}, 0) AS BIGINT)) END")


@query("m1_inr_format", O.with_sales(f"""
SELECT CUSTOMER_NAME, strftime(month_start, '%Y-%m') AS month, CAST(v AS DOUBLE) AS AMOUNT, {inr_sql('v', '₹')} AS AMOUNT_TEXT
FROM (SELECT CUSTOMER_NAME, month_start, SUM(AMOUNT) AS v FROM sales GROUP BY 1, 2)"""))
def m1_inr_format(spark, sf):
    from .functions.scalars import inr

    g = T.sales(spark, sf).groupBy(M.CUSTOMER, M.MONTH_START).agg(F.sum(M.AMOUNT).alias("v"))
    return g.select(M.CUSTOMER, F.date_format(M.MONTH_START, "yyyy-MM").alias("month"),
                    F.col("v").cast("double").alias(M.AMOUNT), inr(F.col("v"), "₹").alias("AMOUNT_TEXT"))


@query("g20_insights", O.with_sales(f"""
SELECT kind, value, text FROM (
  SELECT 'concentration' AS kind, pct AS value,
         printf('The 3 largest customers bring %.1f%% of revenue (%s).', pct, CASE WHEN pct > 60.0 THEN 'concentrated' ELSE 'spread' END) AS text
  FROM (SELECT ROUND(CAST(top AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1) AS pct, total FROM
          (SELECT SUM(v) AS top FROM (SELECT v FROM ({_rev_by('CUSTOMER_NAME')}) ORDER BY v DESC, CUSTOMER_NAME LIMIT 3)),
          (SELECT SUM(v) AS total FROM ({_rev_by('CUSTOMER_NAME')}))) WHERE total > 0
  UNION ALL
  SELECT 'portfolio', share, printf('%d product groups sold; largest: %s with %.1f%% of revenue.', active, value, share)
  FROM (SELECT arg_min(ITEM_NAME_GROUP, (-v, ITEM_NAME_GROUP)) AS value, count(*) AS active,
               CASE WHEN SUM(v) > 0 THEN ROUND(CAST(max(v) AS DOUBLE) / CAST(SUM(v) AS DOUBLE) * 100, 1) ELSE 0.0 END AS share
        FROM ({_rev_by('ITEM_NAME_GROUP')}))
  UNION ALL
  SELECT 'order_size', aov, 'Mean order value ' || {inr_sql('aov')} ||
         CASE WHEN aov < 50000.0 THEN ' (below the threshold).' ELSE ' (at or above the threshold).' END
  FROM (SELECT CASE WHEN COUNT(DISTINCT INVOICE_NO) > 0 THEN CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) / COUNT(DISTINCT INVOICE_NO) ELSE 0.0 END AS aov
        FROM sales) WHERE aov > 0
  UNION ALL
  SELECT 'geography', CAST(count(*) AS DOUBLE), printf('Sales in %d states; largest: %s.', count(*), arg_min(STATE, (-v, STATE)))
  FROM ({_rev_by('STATE')}))"""))
def g20_insights(spark, sf):
    return G.insights(T.sales(spark, sf))


# ------------------------------------------------------------------ I: pricing
from .operators import geo as J  # noqa: E402
from .operators import pricing as I  # noqa: E402

UNIT_SQL = "SELECT *, CAST(AMOUNT AS DOUBLE) / CAST(QTY AS DOUBLE) AS UNIT_PRICE FROM sales WHERE QTY > 0 AND AMOUNT > 0"
TOP_PRODUCTS_SQL = f"""top_products AS (SELECT MATERIALGROUP, ITEM_NAME_GROUP FROM (
  SELECT MATERIALGROUP, ITEM_NAME_GROUP, row_number() OVER (PARTITION BY MATERIALGROUP ORDER BY SUM(AMOUNT) DESC, ITEM_NAME_GROUP) AS r
  FROM ({UNIT_SQL}) WHERE MATERIALGROUP IS NOT NULL AND ITEM_NAME_GROUP IS NOT NULL GROUP BY 1, 2) WHERE r <= 50)"""


@query("i1_unit_prices", O.with_sales(f"SELECT INVOICE_NO, ITEM_NAME_GROUP, QTY, CAST(AMOUNT AS DOUBLE) AS AMOUNT, UNIT_PRICE FROM ({UNIT_SQL})"))
def i1_unit_prices(spark, sf):
    return _out(I.unit_prices(T.sales(spark, sf)).select(M.INVOICE_NO, M.ITEM_GROUP, M.QTY, M.AMOUNT, "UNIT_PRICE"))


@query("i2_demand_curve", O.with_sales(f"""
SELECT u.MATERIALGROUP, u.ITEM_NAME_GROUP, ROUND(UNIT_PRICE, 0) AS PRICE_BIN, CAST(SUM(QTY) AS DOUBLE) AS TOTAL_QTY, count(QTY) AS TXN_COUNT
FROM ({UNIT_SQL}) u SEMI JOIN top_products t ON u.MATERIALGROUP = t.MATERIALGROUP AND u.ITEM_NAME_GROUP = t.ITEM_NAME_GROUP
GROUP BY 1, 2, 3""", TOP_PRODUCTS_SQL))
def i2_demand_curve(spark, sf):
    return I.demand_curve(T.sales(spark, sf), 50)


@query("i3_price_stats", O.with_sales(f"""
SELECT u.MATERIALGROUP, u.ITEM_NAME_GROUP, ROUND(avg(UNIT_PRICE), 6) AS avg_price, ROUND(stddev_samp(UNIT_PRICE), 6) AS price_stddev
FROM ({UNIT_SQL}) u SEMI JOIN top_products t ON u.MATERIALGROUP = t.MATERIALGROUP AND u.ITEM_NAME_GROUP = t.ITEM_NAME_GROUP
GROUP BY 1, 2""", TOP_PRODUCTS_SQL))
def i3_price_stats(spark, sf):
    return I.price_stats(T.sales(spark, sf), 50)


@query("i4_lowess_trend")
def i4_lowess_trend(spark, sf):
    return I.smooth(I.demand_curve(T.sales(spark, sf), 50))


@query("i4_lowess_invariants", O.with_sales(f"""
SELECT MATERIALGROUP, ITEM_NAME_GROUP, count(*) AS points, CAST(SUM(TOTAL_QTY) AS DOUBLE) AS qty, true AS fitted FROM (
  SELECT u.MATERIALGROUP, u.ITEM_NAME_GROUP, ROUND(UNIT_PRICE, 0) AS PRICE_BIN, CAST(SUM(QTY) AS DOUBLE) AS TOTAL_QTY
  FROM ({UNIT_SQL}) u SEMI JOIN top_products t ON u.MATERIALGROUP = t.MATERIALGROUP AND u.ITEM_NAME_GROUP = t.ITEM_NAME_GROUP
  GROUP BY 1, 2, 3) GROUP BY 1, 2""", TOP_PRODUCTS_SQL))
def i4_lowess_invariants(spark, sf):
    """What SQL can say of the trend: every point of every curve kept, and fitted."""
    return i4_lowess_trend(spark, sf).groupBy(M.MATERIAL, M.ITEM_GROUP).agg(
        F.count("*").alias("points"), F.sum("TOTAL_QTY").alias("qty"), (F.count("trend") == F.count("*")).alias("fitted"))


# ------------------------------------------------------------------ J: geography
def region_coords(spark, sf) -> DataFrame:
    """State coordinates derived from the region table."""
    r = T.table(spark, sf, "region")
    return r.select(
        F.initcap(F.col("r_name")).alias("name"), (F.col("r_regionkey") * 10.5 + 5.25).alias("lat"),
        (F.col("r_regionkey") * -20.25 + 70.5).alias("lon"))


def nation_coords(spark, sf) -> DataFrame:
    """City coordinates derived from the nation table."""
    n = T.table(spark, sf, "nation")
    return n.select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_regionkey") * 12.0).alias("lon"))


@query("j1_state_coords", O.with_sales("""
SELECT s.STATE, s.Revenue, COALESCE(c.lat, 20.5937) AS lat, COALESCE(c.lon, 78.9629) AS lon
FROM (SELECT STATE, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue FROM sales WHERE STATE IS NOT NULL GROUP BY STATE) s
LEFT JOIN (SELECT upper(r_name) AS k, r_regionkey * 10.5 + 5.25 AS lat, r_regionkey * -20.25 + 70.5 AS lon
           FROM region) c ON upper(trim(s.STATE)) = c.k"""))
def j1_state_coords(spark, sf):
    g = T.sales(spark, sf).groupBy(M.STATE).agg(F.sum(M.AMOUNT).cast("double").alias("Revenue"))
    return J.add_state_coords(g, region_coords(spark, sf))


@query("j2_city_coords", O.with_sales("""
SELECT s.CITY, s.Revenue, c.lat, c.lon
FROM (SELECT CITY, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue FROM sales WHERE CITY IS NOT NULL GROUP BY CITY) s
JOIN (SELECT upper(n_name) AS k, n_nationkey * 1.5 AS lat, n_regionkey * 12.0 AS lon FROM nation) c
  ON upper(s.CITY) = c.k"""))
def j2_city_coords(spark, sf):
    g = T.sales(spark, sf).groupBy(M.CITY).agg(F.sum(M.AMOUNT).cast("double").alias("Revenue"))
    return J.add_city_coords(g, nation_coords(spark, sf))


@query("j3_city_drill", O.with_sales("""
SELECT CITY AS city, CAST(SUM(AMOUNT) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Invoices,
       CAST(ROUND(SUM(AMOUNT) / CAST(100000 AS DECIMAL(10,0)), 1) AS DOUBLE) AS Revenue_L
FROM sales WHERE STATE = 'EUROPE' AND CITY IS NOT NULL GROUP BY CITY ORDER BY Revenue DESC, city LIMIT 15"""))
def j3_city_drill(spark, sf):
    return J.city_drill(T.sales(spark, sf), "EUROPE")


@query("j4_geo_summary", O.with_sales(f"""
SELECT top_state, active_states, CAST(ROUND(t / active_states / CAST(10000000 AS DECIMAL(10,0)), 2) AS DOUBLE) AS avg_revenue_cr, top_city
FROM (SELECT arg_min(STATE, (-v, STATE)) AS top_state, count(*) AS active_states, SUM(v) AS t FROM ({_rev_by('STATE')})),
     (SELECT arg_min(CITY, (-v, CITY)) AS top_city FROM ({_rev_by('CITY')}))"""))
def j4_geo_summary(spark, sf):
    return J.geo_summary(T.sales(spark, sf))


# ------------------------------------------------------------------ B: sinks (DataFrame parts)
from .sinks import writers as B  # noqa: E402

B_COLS = [M.DATE, M.INVOICE_NO, M.CUSTOMER, M.ITEM, M.QTY, M.AMOUNT, M.TENANT]


@query("b1_append_new", O.with_sales("""
SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY,
       CAST(AMOUNT AS DOUBLE) AS AMOUNT, tenant_id FROM sales n
WHERE DATE >= TIMESTAMP '1998-07-01'
  AND NOT EXISTS (SELECT 1 FROM sales e WHERE e.DATE < TIMESTAMP '1999-01-01'
                  AND e.INVOICE_NO IS NOT DISTINCT FROM n.INVOICE_NO AND e.tenant_id IS NOT DISTINCT FROM n.tenant_id)"""))
def b1_append_new(spark, sf):
    s = T.sales(spark, sf).select(*B_COLS)
    new = s.where(F.col(M.DATE) >= F.lit("1998-07-01").cast("timestamp"))
    existing = s.where(F.col(M.DATE) < F.lit("1999-01-01").cast("timestamp"))
    return _out(B.append_new(new, existing))


@query("b6_merge_snapshot", O.with_sales("""
SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY,
       CAST(AMOUNT AS DOUBLE) AS AMOUNT, tenant_id FROM (
  SELECT *, row_number() OVER (PARTITION BY INVOICE_NO ORDER BY src, DATE NULLS FIRST, INVOICE_NO NULLS FIRST,
           CUSTOMER_NAME NULLS FIRST, ITEMNAME NULLS FIRST, QTY NULLS FIRST, AMOUNT NULLS FIRST, tenant_id NULLS FIRST) AS r
  FROM (SELECT DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY, AMOUNT, tenant_id, 0 AS src FROM sales
        WHERE DATE < TIMESTAMP '1999-01-01'
        UNION ALL
        SELECT DATE, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY, AMOUNT * 2, tenant_id, 1 FROM sales
        WHERE DATE >= TIMESTAMP '1998-07-01'))
WHERE r = 1"""))
def b6_merge_snapshot(spark, sf):
    s = T.sales(spark, sf).select(*B_COLS)
    old = s.where(F.col(M.DATE) < F.lit("1999-01-01").cast("timestamp"))
    new = s.where(F.col(M.DATE) >= F.lit("1998-07-01").cast("timestamp")).withColumn(M.AMOUNT, F.col(M.AMOUNT) * 2)
    return _out(B.merge_snapshot(old, new))


# ------------------------------------------------------------------ N: streaming folder ingest
@query("n1_n4_stream_ingest", INGEST_SQL)
def n1_n4_stream_ingest(spark, sf):
    """The raw upload (messy headers) written as packed CSV files in two column orders
    (4 files, more for larger tables; invoices never span files), ingested by
    the folder stream in 4 micro-batches, read back. Scratch folders live under the shared
    checkpoint directory."""
    import uuid

    from .session import shared_dir, shuffles_go
    from .sources.files import CSV_OPTIONS
    from .streaming.ingest_stream import start_ingest

    base = shared_dir(spark, f"stream-{uuid.uuid4().hex}")
    src, stage, dst, ck = (f"{base}/{x}" for x in ("src", "stage", "table", "ckpt"))
    raw = raw_upload(spark, sf)
    key = RAW_HEADERS[M.INVOICE_NO]
    layouts = [raw.columns, list(reversed(raw.columns))]
    files = T.files_for(spark, sf)  # of a layout; each is packed, and written and read by one task
    opts = {**CSV_OPTIONS, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
    for i, cols in enumerate(layouts):
        part = (raw.where(F.abs(F.hash(F.col(f"`{key}`"))) % 2 == i).select(*[F.col(f"`{c}`") for c in cols])
                .repartition(files, F.col(f"`{key}`")))
        with shuffles_go(spark):
            part.write.mode("overwrite").options(**opts, compression="gzip").csv(f"{stage}/{i}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    srcp = jvm.org.apache.hadoop.fs.Path(src)
    fs = srcp.getFileSystem(conf)
    fs.mkdirs(srcp)
    for i in range(len(layouts)):
        for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{stage}/{i}")):
            name = st.getPath().getName()
            if name.endswith(".csv.gz"):
                fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(f"{src}/{i}-{name}"))
    q = start_ingest(spark, src, dst, ck, T.customer_master(spark, sf), city_map=city_map(spark, sf),
                     trigger={"availableNow": True}, files_per_trigger=files // 2, glob="*.csv.gz")
    q.awaitTermination()
    out = B.read_table(spark, dst).drop("batch_id", M.FY_START, M.MONTH_START).withColumnRenamed(M.TENANT, M.TENANT.upper())
    return _out(out)


# ------------------------------------------------------------------ L: questions as batch jobs
from .operators import questions as L  # noqa: E402


def questions(spark, sf) -> DataFrame:
    """Questions built from templates over every customer, region and part type."""
    c = T.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = T.table(spark, sf, "region").select("r_regionkey", "r_name")
    cr = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    q1 = cr.select(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("-1")).alias("q_id"),
                   F.concat(F.lit("Top 3 products for "), F.col("c_name"), F.lit(" in 2000?")).alias("text"))
    q2 = cr.select(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("-2")).alias("q_id"),
                   F.concat(F.lit("how many orders did "), F.col("c_name"), F.lit(" place in "),
                            F.lower(F.col("r_name")), F.lit(",")).alias("text"))
    q3 = r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("q_id"),
                  F.concat(F.lit("best 2 customers in "), F.col("r_name"), F.lit(" by units: top 2")).alias("text"))
    t = T.table(spark, sf, "part").select("p_type").distinct()
    q4 = t.select(F.concat(F.lit("t-"), F.col("p_type")).alias("q_id"),
                  F.concat(F.lit("total revenue for "), F.lower(F.col("p_type")), F.lit(" items in 2001")).alias("text"))
    q5 = r.select(F.concat(F.lit("s"), F.col("r_regionkey")).alias("q_id"),
                  F.concat(F.lit("Which state is best by invoices?")).alias("text"))
    # more than there are of the dimension, and a number beyond 64 bits
    q6 = r.select(F.concat(F.lit("k"), F.col("r_regionkey")).alias("q_id"),
                  F.concat(F.lit("Top 99999999999 products in "), F.col("r_name"), F.lit("!")).alias("text"))
    q7 = r.select(F.concat(F.lit("x"), F.col("r_regionkey")).alias("q_id"),
                  F.concat(F.lit("top 999999999999999999999999 states in 2001 by volume")).alias("text"))
    return q1.unionByName(q2).unionByName(q3).unionByName(q4).unionByName(q5).unionByName(q6).unionByName(q7)




# SQL twins of the question-answering queries (questions, dictionary, n-grams, links, intents, specs)
L_CTES = [r"""questions AS (
  SELECT 'c' || c.c_custkey || '-1' AS q_id, 'Top 3 products for ' || c.c_name || ' in 2000?' AS text
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT 'c' || c.c_custkey || '-2', 'how many orders did ' || c.c_name || ' place in ' || lower(r.r_name) || ','
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT 'r' || r_regionkey, 'best 2 customers in ' || r_name || ' by units: top 2' FROM region
  UNION ALL
  SELECT 't-' || p_type, 'total revenue for ' || lower(p_type) || ' items in 2001' FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL
  SELECT 's' || r_regionkey, 'Which state is best by invoices?' FROM region
  UNION ALL
  SELECT 'k' || r_regionkey, 'Top 99999999999 products in ' || r_name || '!' FROM region
  UNION ALL
  SELECT 'x' || r_regionkey, 'top 999999999999999999999999 states in 2001 by volume' FROM region)""",
r"""dict_all AS (
  SELECT DISTINCT lower(STATE) AS key, 'STATE' AS col, STATE AS value, 0 AS prio FROM sales WHERE STATE IS NOT NULL
  UNION ALL SELECT DISTINCT lower(CUSTOMER_NAME), 'CUSTOMER_NAME', CUSTOMER_NAME, 1 FROM sales WHERE CUSTOMER_NAME IS NOT NULL
  UNION ALL SELECT DISTINCT lower(MATERIALGROUP), 'PRODUCT', MATERIALGROUP, 2 FROM sales WHERE MATERIALGROUP IS NOT NULL)""",
r"""dict AS (SELECT key, arg_min(col, (-prio, value)) AS col, arg_min(value, (-prio, value)) AS value FROM dict_all GROUP BY key)""",
r"""words AS (SELECT q_id, list_filter(regexp_split_to_array(trim(lower(text)), '[\s\x{00A0}]+'), lambda w: w <> '') AS words FROM questions)""",
r"""poss AS (SELECT q_id, words, unnest(range(len(words))) AS pos FROM words)""",
r"""grams AS (SELECT q_id, pos, len, regexp_replace(array_to_string(words[pos + 1 : pos + len], ' '), '^[?,.!:]+|[?,.!:]+$', '', 'g') AS chunk
  FROM poss, (SELECT unnest(range(1, 5)) AS len) WHERE pos + len <= len(words))""",
r"""links AS (
  SELECT q_id, col AS "column", value FROM (
    SELECT g.q_id, d.col, d.value, row_number() OVER (PARTITION BY g.q_id, d.col ORDER BY g.len DESC, g.pos) AS r
    FROM grams g JOIN dict d ON g.chunk = d.key) WHERE r = 1
  UNION ALL
  SELECT q_id, 'YEAR', regexp_extract(lower(text), '\b(20\d{2})\b', 1) FROM questions
  WHERE regexp_extract(lower(text), '\b(20\d{2})\b', 1) <> '')""",
r"""intents AS (SELECT q_id, metric, shape, CASE WHEN shape = 'top' THEN k END AS k, CASE WHEN shape = 'top' THEN dim END AS dim FROM (
  SELECT q_id,
    CASE WHEN contains(t, 'quantity') OR contains(t, 'qty') OR contains(t, 'volume') OR contains(t, 'units') THEN 'QTY'
         WHEN contains(t, 'count') OR contains(t, 'orders') OR contains(t, 'invoices') THEN 'INVOICE_NO' ELSE 'AMOUNT' END AS metric,
    CASE WHEN contains(t, 'top') OR contains(t, 'best') THEN 'top' ELSE 'total' END AS shape,
    CASE WHEN regexp_extract(t, 'top (\d+)', 1) <> '' THEN coalesce(TRY_CAST(regexp_extract(t, 'top (\d+)', 1) AS BIGINT), 9223372036854775807) ELSE 5 END AS k,
    CASE WHEN contains(t, 'customer') THEN 'CUSTOMER_NAME' WHEN contains(t, 'product') OR contains(t, 'item') THEN 'MATERIALGROUP'
         WHEN contains(t, 'state') OR contains(t, 'region') THEN 'STATE' ELSE 'CUSTOMER_NAME' END AS dim
  FROM (SELECT q_id, lower(trim(text)) AS t FROM questions)))""",
r"""spec AS (SELECT i.*, f.f_state, f.f_cust, f.f_prod, f.f_year FROM intents i LEFT JOIN (
  SELECT q_id, max(CASE WHEN "column" = 'STATE' THEN value END) AS f_state, max(CASE WHEN "column" = 'CUSTOMER_NAME' THEN value END) AS f_cust,
         max(CASE WHEN "column" = 'PRODUCT' THEN value END) AS f_prod, max(CASE WHEN "column" = 'YEAR' THEN value END) AS f_year
  FROM links GROUP BY q_id) f ON i.q_id = f.q_id)""",
]

L1_SQL = 'SELECT q_id, "column", value FROM links'
L2_SQL = "SELECT q_id, metric, shape, CAST(k AS DOUBLE) AS k, dim FROM intents"
L3_SQL_CTES = [r"""m AS (SELECT sp.q_id, sp.metric, sp.shape, sp.k, sp.dim, s.STATE, s.CUSTOMER_NAME, s.MATERIALGROUP, s.INVOICE_NO, s.QTY, s.AMOUNT
  FROM spec sp JOIN sales s
    ON (sp.f_state IS NULL OR s.STATE = sp.f_state) AND (sp.f_cust IS NULL OR s.CUSTOMER_NAME = sp.f_cust)
   AND (sp.f_prod IS NULL OR s.MATERIALGROUP = sp.f_prod) AND (sp.f_year IS NULL OR CAST(year(s.DATE) AS VARCHAR) = sp.f_year))""",
r"""tops AS (SELECT q_id, k, name, value, row_number() OVER (PARTITION BY q_id ORDER BY value DESC, name) AS rank FROM (
  SELECT q_id, k, CASE dim WHEN 'CUSTOMER_NAME' THEN CUSTOMER_NAME WHEN 'MATERIALGROUP' THEN MATERIALGROUP ELSE STATE END AS name,
         CASE WHEN any_value(metric) = 'INVOICE_NO' THEN CAST(count(DISTINCT INVOICE_NO) AS DOUBLE)
              WHEN any_value(metric) = 'QTY' THEN CAST(COALESCE(SUM(QTY), 0) AS DOUBLE)
              ELSE CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) END AS value
  FROM m WHERE shape = 'top' GROUP BY q_id, k, dim, name) WHERE name IS NOT NULL)"""]
L3_SQL = r"""SELECT q_id, CAST(rank AS INTEGER) AS rank, name, value FROM tops WHERE rank <= k
UNION ALL
SELECT q_id, 1, 'Total', CASE WHEN any_value(metric) = 'INVOICE_NO' THEN CAST(count(DISTINCT INVOICE_NO) AS DOUBLE)
                              WHEN any_value(metric) = 'QTY' THEN CAST(COALESCE(SUM(QTY), 0) AS DOUBLE)
                              ELSE CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) END
FROM m WHERE shape = 'total' GROUP BY q_id
UNION ALL
SELECT q_id, 0, 'NO DATA', CAST(NULL AS DOUBLE) FROM spec WHERE q_id NOT IN (SELECT q_id FROM m)"""



@query("l1_link_entities", O.with_sales(L1_SQL, *L_CTES))
def l1_link_entities(spark, sf):
    return L.link_entities(questions(spark, sf), L.dictionary(T.sales(spark, sf)))


@query("l2_parse_intent", O.with_sales(L2_SQL, *L_CTES))
def l2_parse_intent(spark, sf):
    return L.parse_intent(questions(spark, sf)).withColumn("k", F.col("k").cast("double"))


@query("l3_answer", O.with_sales(L3_SQL, *L_CTES, *L3_SQL_CTES))
def l3_answer(spark, sf):
    return L.answer(questions(spark, sf), T.sales(spark, sf))


# ------------------------------------------------------------------ composites: E8, F7 pivot, G2 mode, G23, G24
@query("e8_dashboard_trend", O.with_sales("""
SELECT strftime(m, '%Y-%m') AS DATE, COALESCE(a, 0.0) AS AMOUNT FROM (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
  FROM (SELECT min(month_start) AS lo, max(month_start) AS hi FROM f WHERE DATE IS NOT NULL)) cal
LEFT JOIN (SELECT month_start, CAST(SUM(AMOUNT) AS DOUBLE) AS a FROM f WHERE DATE IS NOT NULL GROUP BY month_start) x
  ON cal.m = x.month_start
ORDER BY m DESC LIMIT 36""", "f AS (SELECT * FROM sales WHERE DATE >= TIMESTAMP '1997-04-01' AND DATE < TIMESTAMP '2000-04-01' "
                           "AND STATE IN ('ASIA', 'EUROPE'))"))
def e8_dashboard_trend(spark, sf):
    return E.dashboard(D.apply_filters(T.sales(spark, sf), Filters(states=["ASIA", "EUROPE"])), "1997-04-01", "2000-03-31")["trend"]


@query("e8_dashboard_comparison", _compare_sql("1997-11-30", "1998-01-01", "1998-02-01").replace(
    "FROM sales\n          WHERE DATE", "FROM sales\n          WHERE STATE IN ('ASIA', 'EUROPE') AND DATE"))
def e8_dashboard_comparison(spark, sf):
    return E.dashboard(D.apply_filters(T.sales(spark, sf), Filters(states=["ASIA", "EUROPE"])), "1998-01-01", "1998-01-31")["comparison"]


DASHBOARD_SQL = ("f AS (SELECT * FROM sales WHERE DATE >= TIMESTAMP '1997-04-01' AND DATE < TIMESTAMP '2000-04-01' AND STATE IN ('ASIA', 'EUROPE'))")


def _dashboard(spark, sf) -> dict[str, DataFrame]:
    df = D.apply_filters(T.sales(spark, sf), Filters(states=["ASIA", "EUROPE"]))
    return E.dashboard(df, "1997-04-01", "2000-03-31", goal_revenue=250000000.0, goal_orders=5000)


@query("e8_dashboard_summary", O.with_sales(f"SELECT {KPI_SQL} FROM f", DASHBOARD_SQL))
def e8_dashboard_summary(spark, sf):
    return _dashboard(spark, sf)["summary"]


@query("e8_dashboard_goals", O.with_sales("""
SELECT 'revenue' AS metric, 250000000.0 AS target, ROUND(CAST(SUM(AMOUNT) AS DOUBLE) / 250000000.0 * 100, 1) AS achievement_pct FROM f
UNION ALL SELECT 'orders', 5000.0, ROUND(COUNT(DISTINCT INVOICE_NO) / 5000.0 * 100, 1) FROM f""", DASHBOARD_SQL))
def e8_dashboard_goals(spark, sf):
    return _dashboard(spark, sf)["goals"]


@query("e8_dashboard_groups", O.with_sales(
    "SELECT ITEM_NAME_GROUP, CAST(v AS DOUBLE) AS AMOUNT FROM (" + _rev_by("ITEM_NAME_GROUP").replace("FROM sales", "FROM f")
    + ") ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 10", DASHBOARD_SQL))
def e8_dashboard_groups(spark, sf):
    return _dashboard(spark, sf)["material_groups"]


@query("e8_dashboard_customers", O.with_sales(
    "SELECT CUSTOMER_NAME, CAST(v AS DOUBLE) AS AMOUNT FROM (" + _rev_by("CUSTOMER_NAME").replace("FROM sales", "FROM f")
    + ") ORDER BY v DESC, CUSTOMER_NAME LIMIT 10", DASHBOARD_SQL))
def e8_dashboard_customers(spark, sf):
    return _dashboard(spark, sf)["top_customers"]


@query("g23_dynamic_report_kpis", O.with_sales(f"""
SELECT {KPI_SQL}, CAST(COALESCE(SUM(QTY), 0) AS DOUBLE) AS quantity,
       COUNT(DISTINCT ITEMNAME) AS items, COUNT(DISTINCT ITEM_NAME_GROUP) AS groups FROM f""", DASHBOARD_SQL))
def g23_dynamic_report_kpis(spark, sf):
    df = D.apply_filters(T.sales(spark, sf), Filters(states=["ASIA", "EUROPE"], start_date="1997-04-01", end_date="2000-03-31"))
    return G.dynamic_report(df, "state", "customer")["kpis"]


@query("g23_dynamic_report_trend", O.with_sales("""
SELECT strftime(m, '%Y-%m') AS DATE, COALESCE(a, 0.0) AS AMOUNT FROM (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
  FROM (SELECT min(month_start) AS lo, max(month_start) AS hi FROM f WHERE DATE IS NOT NULL)) cal
LEFT JOIN (SELECT month_start, CAST(SUM(AMOUNT) AS DOUBLE) AS a FROM f WHERE DATE IS NOT NULL GROUP BY month_start) x
  ON cal.m = x.month_start
ORDER BY m DESC LIMIT 24""", DASHBOARD_SQL))
def g23_dynamic_report_trend(spark, sf):
    df = D.apply_filters(T.sales(spark, sf), Filters(states=["ASIA", "EUROPE"], start_date="1997-04-01", end_date="2000-03-31"))
    return G.dynamic_report(df, "state", "customer")["trend"]


@query("f7_fy_month_pivot", O.with_sales(
    "SELECT FINANCIAL_YEAR, " + ", ".join(
        f"CAST(COALESCE(SUM(CASE WHEN month(DATE) = {m} THEN AMOUNT END), 0) AS DOUBLE) AS \"{m}\"" for m in range(1, 13))
    + " FROM sales WHERE DATE IS NOT NULL GROUP BY FINANCIAL_YEAR"))
def f7_fy_month_pivot(spark, sf):
    return TS.fy_month_pivot(T.sales(spark, sf))


@query("g2_top_others_always", O.with_sales(f"""
SELECT label, AMOUNT FROM (
  SELECT ITEM_NAME_GROUP AS label, CAST(v AS DOUBLE) AS AMOUNT FROM ({_rev_by('ITEM_NAME_GROUP')}) ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 10)
UNION ALL
SELECT 'Others', CAST(alls - tops AS DOUBLE) FROM
  (SELECT count(*) AS n, SUM(v) AS alls FROM ({_rev_by('ITEM_NAME_GROUP')})),
  (SELECT SUM(v) AS tops FROM (SELECT v FROM ({_rev_by('ITEM_NAME_GROUP')}) ORDER BY v DESC, ITEM_NAME_GROUP LIMIT 10))
WHERE n > 10"""))
def g2_top_others_always(spark, sf):
    return G.top_n_others(T.sales(spark, sf), M.ITEM_GROUP, 10, mode="always")


@query("g23_dynamic_report_share", O.with_sales(f"""
SELECT label, AMOUNT FROM (
  SELECT STATE AS label, CAST(v AS DOUBLE) AS AMOUNT FROM ({_rev_by('STATE')}) ORDER BY v DESC, STATE LIMIT 3)
UNION ALL
SELECT 'Others', CAST(alls - tops AS DOUBLE) FROM
  (SELECT count(*) AS n, SUM(v) AS alls FROM ({_rev_by('STATE')})),
  (SELECT SUM(v) AS tops FROM (SELECT v FROM ({_rev_by('STATE')}) ORDER BY v DESC, STATE LIMIT 3))
WHERE n > 3 AND alls - tops > 0"""))
def g23_dynamic_report_share(spark, sf):
    return G.dynamic_report(T.sales(spark, sf), "state", secondary=None, n=1, include_pivot=False)["share"]


@query("g24_city_report_groups", O.with_sales("""
SELECT ITEM_NAME_GROUP, Revenue, Orders, CASE WHEN Orders > 0 THEN Revenue / Orders ELSE 0.0 END AS AOV FROM (
  SELECT ITEM_NAME_GROUP, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
  FROM sales WHERE CITY = 'NATION_3' AND ITEM_NAME_GROUP IS NOT NULL GROUP BY 1)"""))
def g24_city_report_groups(spark, sf):
    return G.report(T.sales(spark, sf), "city", "NATION_3")["groups"]


from . import catalog_io  # noqa: E402, F401  (registers the read-back queries)
