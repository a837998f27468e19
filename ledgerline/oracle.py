"""Independent ANSI-SQL (DuckDB) statements for the correctness gate.

Each statement restates, in plain SQL over the driver's tables, what the
matching ``catalog`` query computes, with the same output column names.
The ``sales`` / ``dirty_sales`` CTEs are the SQL twins of
``ledgerline.sources.tables``.
"""

from __future__ import annotations

AMOUNT_SQL = "CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))"

CAL_COLS = """,
    'FY' || CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END) % 100 AS VARCHAR) || '-' ||
      CAST((year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR) AS FINANCIAL_YEAR,
    upper(strftime(DATE, '%b-%y')) AS MONTH,
    year(DATE) - CASE WHEN month(DATE) < 4 THEN 1 ELSE 0 END AS fy_start,
    CAST(date_trunc('month', DATE) AS DATE) AS month_start"""

BASE_JOIN = """lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    JOIN part p ON l.l_partkey = p.p_partkey"""

SALES_RAW = f"""sales_raw AS (
  SELECT o.o_orderdate AS DATE, CAST(o.o_orderkey AS VARCHAR) AS INVOICE_NO, c.c_name AS CUSTOMER_NAME,
         p.p_name AS ITEMNAME, p.p_brand AS ITEM_NAME_GROUP, p.p_type AS MATERIALGROUP,
         n.n_name AS CITY, r.r_name AS STATE, l.l_quantity AS QTY, {AMOUNT_SQL} AS AMOUNT,
         c.c_mktsegment AS tenant_id
  FROM {BASE_JOIN})"""

SALES = SALES_RAW + f""",
sales AS (SELECT *{CAL_COLS} FROM sales_raw)"""

DIRTY = f"""dirty_sales AS (
  SELECT CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE o.o_orderdate END AS DATE,
         CAST(o.o_orderkey AS VARCHAR) AS INVOICE_NO, c.c_name AS CUSTOMER_NAME, p.p_name AS ITEMNAME,
         CASE WHEN p.p_partkey % 11 = 0 THEN 'raw ' || p.p_brand
              WHEN p.p_partkey % 13 = 0 THEN 'conduit  ' || p.p_brand || ' gland'
              WHEN p.p_partkey % 17 = 0 THEN NULL
              WHEN p.p_partkey % 19 = 0 THEN chr(160) || 'REVERSE  FORWORD ' || p.p_brand
              ELSE p.p_brand END AS ITEM_NAME_GROUP,
         p.p_type AS MATERIALGROUP,
         CASE WHEN c.c_nationkey = 24 THEN 'UNKNOWN'
              WHEN c.c_nationkey = 3 THEN chr(160) || lower(n.n_name) || chr(9)
              ELSE n.n_name END AS CITY,
         CASE WHEN c.c_nationkey % 7 = 0 THEN ''
              WHEN c.c_nationkey = 13 THEN NULL
              WHEN c.c_nationkey = 11 THEN 'State Not Found'
              ELSE r.r_name END AS STATE,
         r.r_name AS REGION, l.l_quantity AS QTY,
         CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 7 THEN -({AMOUNT_SQL})
                   WHEN o.o_orderkey % 89 = 0 THEN 0
                   ELSE {AMOUNT_SQL} END AS DECIMAL(26,4)) AS AMOUNT,
         c.c_mktsegment AS tenant_id
  FROM {BASE_JOIN})"""

MASTER = """master AS (
  SELECT c.c_name AS CUSTOMER_NAME,
         CASE WHEN c.c_nationkey = 2 THEN NULL ELSE 'M_' || r.r_name END AS STATE,
         'M_' || n.n_name AS CITY
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT c.c_name, 'M_' || r.r_name, 'A_' || n.n_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE c.c_nationkey = 4)"""

# targets derived from the orders calendar (see catalog.targets)
TARGETS = """targets AS (
  SELECT DISTINCT
    'FY' || CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END) % 100 AS VARCHAR) || '-' ||
      CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR) AS FINANCIAL_YEAR,
    upper(strftime(o_orderdate, '%b-%y')) AS MONTH,
    CAST(5000000 + 250000 * month(o_orderdate) AS BIGINT) AS TARGET_AMOUNT,
    'All' AS CUSTOMER_NAME, 'All' AS MATERIAL_GROUP
  FROM orders)"""


def with_sales(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SALES, *ctes]) + "\n" + body


def with_dirty(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([DIRTY, *ctes]) + "\n" + body


def month_label_start_sql(expr: str) -> str:
    """SQL twin of ``filters.month_label_start``."""
    lab = f"upper(trim({expr}))"
    pos = f"instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', substr({lab}, 1, 3))"
    tail = f"substr({lab}, length({lab}) - 1, 2)"
    yy = f"CASE WHEN regexp_full_match({tail}, '[0-9]{{2}}') THEN CAST({tail} AS INTEGER) END"
    mon = f"CASE WHEN length({lab}) >= 3 AND {pos} > 0 AND {pos} % 3 = 1 THEN ({pos} - 1) // 3 + 1 END"
    year = f"CASE WHEN ({yy}) >= 69 THEN ({yy}) + 1900 ELSE ({yy}) + 2000 END"
    return f"CASE WHEN ({mon}) IS NOT NULL AND ({yy}) IS NOT NULL THEN make_date({year}, {mon}, 1) END"


def strip_sql(expr: str) -> str:
    """SQL twin of ``scalars.strip`` (edge whitespace incl. NBSP)."""
    return f"regexp_replace({expr}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def map_groups_sql(expr: str) -> str:
    """SQL twin of ``ingest.map_groups`` with the default rules (ordered)."""
    from .fixed_values import MATERIAL_GROUP_MAPPINGS

    out = expr
    for pattern, repl in MATERIAL_GROUP_MAPPINGS:
        out = f"CASE WHEN COALESCE(regexp_matches({out}, '(?i){pattern}'), false) THEN '{repl}' ELSE {out} END"
    return out


def excluded_sql(expr: str) -> str:
    """SQL twin of the C12 keyword test (TRUE = drop)."""
    from .fixed_values import EXCLUDE_KEYWORDS
    from .functions.scalars import regex_any

    norm = f"upper(trim(regexp_replace(replace({expr}, chr(160), ' '), '\\s+', ' ', 'g')))"
    pat = "(?i)(" + regex_any(EXCLUDE_KEYWORDS) + ")"
    return f"COALESCE(regexp_matches({norm}, '{pat}'), false)"
