"""Registered read-back queries of the load layer: what files and stored tables give back.

Each query writes the given tables (as several tenants, uploads or formats)
under the shared checkpoint folder, runs the operator, and reads the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from . import oracle as O
from .catalog import KPI_SQL, TS_SQL, _out, query
from .functions.scalars import inr_compact, inr_signed, json_text
from .operators import ingest as C
from .plans.common import tasks_for
from .session import drop_folder, shared_dir
from .sinks import writers as B
from .sources import files as A
from .sources import tables as T

COLS = [M.DATE, M.INVOICE_NO, M.CUSTOMER, M.ITEM, M.QTY, M.AMOUNT]
FIRST = "1998-07-01"  # parts the two batches: lines before it, and all lines
ROWS_SQL = f"{TS_SQL}, INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY, CAST(AMOUNT AS DOUBLE) AS AMOUNT"
LINES_CTE = "x AS (SELECT DATE, CASE WHEN QTY = 1 THEN NULL ELSE INVOICE_NO END AS INVOICE_NO, CUSTOMER_NAME, ITEMNAME, QTY, AMOUNT FROM sales)"


def _folder(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def _lines(spark, sf, tenant: str, before: str | None = None) -> DataFrame:
    """All sales lines (or those before a date) as one tenant's; lines of quantity 1 have no invoice number."""
    s = T.sales(spark, sf).select(*COLS)
    if before:
        s = s.where(F.col(M.DATE) < F.lit(before).cast("timestamp"))
    number = F.when(F.col(M.QTY) != 1, F.col(M.INVOICE_NO))
    return s.withColumn(M.INVOICE_NO, number).withColumn(M.TENANT, F.lit(tenant))


def _three_tenants(spark, sf) -> str:
    """Tenants 007, 7 and ACME:IN with the same invoice numbers: some lines of 007 first, then all lines of all three; returns the table's path."""
    path = _folder(spark, "tenants")
    B.load(_lines(spark, sf, "007", FIRST), path)
    B.load(_lines(spark, sf, "007").unionByName(_lines(spark, sf, "7")).unionByName(_lines(spark, sf, "ACME:IN")), path)
    return path


# 007: the first batch, then the new invoices of the second (a stored NULL number makes later NULL numbers known)
TENANTS_SQL = f"""
SELECT {ROWS_SQL}, '007' AS tenant_id FROM x WHERE DATE < TIMESTAMP '{FIRST}'
UNION ALL SELECT {ROWS_SQL}, '007' FROM x WHERE DATE >= TIMESTAMP '{FIRST}'
  AND (INVOICE_NO IS NOT NULL OR NOT EXISTS (SELECT 1 FROM x WHERE INVOICE_NO IS NULL AND DATE < TIMESTAMP '{FIRST}'))
UNION ALL SELECT {ROWS_SQL}, t FROM x, (VALUES ('7'), ('ACME:IN')) v(t)"""


@query("b1_load_two_tenants", O.with_sales(TENANTS_SQL, LINES_CTE))
def b1_load_two_tenants(spark, sf):
    return _out(B.read_table(spark, _three_tenants(spark, sf)))


@query("b3_clear_tenant", O.with_sales(f"SELECT * FROM ({TENANTS_SQL}) WHERE tenant_id <> 'ACME:IN'", LINES_CTE))
def b3_clear_tenant(spark, sf):
    path = _three_tenants(spark, sf)
    B.clear_tenant(spark, path, "ACME:IN")
    return _out(B.read_table(spark, path))


@query("b2_replace_all", O.with_sales(f"SELECT {ROWS_SQL}, '7' AS tenant_id FROM x", LINES_CTE))
def b2_replace_all(spark, sf):
    path = _folder(spark, "replaced")
    B.replace_all(_lines(spark, sf, "007"), path)
    B.replace_all(_lines(spark, sf, "7"), path)
    return _out(B.read_table(spark, path))


PACKED = ".csv.gz"
FILE_ROWS = 500_000  # lines of a packed file, where lines may be dealt to files at will


def _write_uploads(frames: list[DataFrame], folder: str, prefix: str = "", most_rows: int = 0) -> None:
    """Each frame as packed CSV files of its own layout, put side by side in ``folder``; a file is read by one task."""
    spark = frames[0].sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for i, df in enumerate(frames):
        B.export_csv(df, f"{folder}-{prefix}{i}", compression="gzip", maxRecordsPerFile=most_rows)
        for st in fs.listStatus(path(f"{folder}-{prefix}{i}")):
            name = st.getPath().getName()
            if name.endswith(PACKED):
                fs.rename(st.getPath(), path(f"{folder}/{prefix}{i}-{name}"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == M.DATE else F.col(c).cast("string").alias(c) for c in df.columns])


# values that need quoting: a quote, a comma and a line break
ODD = ['12" PIPE, ', "\nLINE "]


@query("a2_read_folder", O.with_sales(f"""
SELECT {TS_SQL}, INVOICE_NO, CUSTOMER_NAME, '12" PIPE, ' || ITEMNAME || chr(10) || 'LINE ' AS ITEMNAME, QTY,
       CAST(AMOUNT AS DOUBLE) AS AMOUNT, CASE WHEN QTY > 25 THEN 'a "note", ' || QTY::INTEGER END AS REMARK, 0 AS rejected FROM sales"""))
def a2_read_folder(spark, sf):
    """Two layouts with swapped and extra columns, quotes, commas and line breaks in values; no line is rejected."""
    s = T.sales(spark, sf).select(*COLS).withColumn(M.ITEM, F.concat(F.lit(ODD[0]), F.col(M.ITEM), F.lit(ODD[1])))
    folder = _folder(spark, "uploads")
    noted = s.where(F.col(M.QTY) > 25).withColumn("REMARK", F.concat(F.lit('a "note", '), F.col(M.QTY).cast("int").cast("string")))
    _write_uploads([_texts(s.where(F.col(M.QTY) <= 25)), _texts(noted.select(*reversed(noted.columns)))], folder, most_rows=FILE_ROWS)
    rows, rejects = A.read_folder_with_rejects(spark, A.list_files(spark, folder, (PACKED,)))
    return _out(A.coerce_types(rows).select(*COLS, "REMARK", F.lit(rejects.count()).cast("int").alias("rejected")))


ODD_HEADER = "INVOICE_NO,QTY,AMOUNT"


def _odd_lines(spark, sf) -> DataFrame:
    """A column of text lines under a header of three fields: lines of two, three and four fields, the fields of three with a quoted comma and line break."""
    q = F.col(M.QTY)
    number = F.when(q <= 30, F.concat(F.lit('"no, \n""'), F.col(M.INVOICE_NO), F.lit('"""'))).otherwise(F.col(M.INVOICE_NO))
    return T.sales(spark, sf).select(F.concat_ws(",", number, q.cast("string"), F.when(q > 10, F.lit("5")), F.when(q > 40, F.lit("surplus"))).alias(ODD_HEADER))


def _kinds(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    fields = F.size(F.split(F.regexp_replace("record", r'(?s)^"no, \n""\d+"""', "no"), ","))
    bad = rejects.select(F.when(fields == 2, "short").otherwise("long").alias("kind"))
    kept = rows.where(F.col(M.INVOICE_NO).rlike(r'^(no, \n"\d+"|\d+)$') & (F.col(M.AMOUNT) == "5")).select(F.lit("kept").alias("kind"))
    return kept.unionByName(bad).groupBy("kind").agg(F.count("*").alias("n"))


KINDS_SQL = """
SELECT 'short' AS kind, count(*) AS n FROM sales WHERE QTY <= 10
UNION ALL SELECT 'long', count(*) FROM sales WHERE QTY > 40 UNION ALL SELECT 'kept', count(*) FROM sales WHERE QTY > 10 AND QTY <= 40"""


@query("a2_rejects", O.with_sales(KINDS_SQL))
def a2_rejects(spark, sf):
    """Uploads with lines of two, three and four fields under a header of three: the odd ones are rejects, none is lost."""
    folder, files = _folder(spark, "odd"), T.buckets_for(spark, sf)  # each is written by one task
    heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(0).alias("at"), F.lit(ODD_HEADER).alias("value"))
    lines = _odd_lines(spark, sf).select(F.pmod(F.xxhash64(ODD_HEADER), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("at"), F.col(ODD_HEADER).alias("value"))
    whole = heads.unionByName(lines).repartition(files, "file").sortWithinPartitions("file", "at").drop("at")
    whole.write.partitionBy("file").text(folder)
    return _kinds(*A.read_folder_with_rejects(spark, A.list_files(spark, folder, (".txt",), deep=True)))


@query("a1_read_upload", O.with_sales(KINDS_SQL))
def a1_read_upload(spark, sf):
    """The same lines as one uploaded file, read by as many tasks as its size asks for (only writing one file takes one task)."""
    folder = _folder(spark, "upload")
    head = spark.range(1, numPartitions=1).select(F.lit(ODD_HEADER).alias("value"))
    head.unionByName(_odd_lines(spark, sf).toDF("value")).coalesce(1).write.text(folder)
    return _kinds(*A.read_upload_with_rejects(spark, A.list_files(spark, folder, (".txt",))[0]))


def _tenant_stream(spark, sf) -> str:
    """Uploads of three tenants with the same invoice numbers through the stream, with archive, audit and rejects; returns the folder.

    Each tenant's lines lie in some files, more of them for larger tables, an invoice whole in one of them; then one tenant's
    files come again under other names. A batch takes half of all files of the three tenants.
    """
    from .streaming.ingest_stream import start_ingest

    base = _folder(spark, "tenant-stream")
    s = T.sales(spark, sf).select(*COLS)
    files = max(4, T.files_for(spark, sf))
    frames = [_texts(s.withColumn("Tenant_Id", F.lit(t))).repartition(files, M.INVOICE_NO) for t in ("007", "7", "ACME:IN")]
    for i, own in enumerate((frames, frames[:1])):
        _write_uploads(own, f"{base}/src", f"{i}-")
        q = start_ingest(spark, f"{base}/src", f"{base}/table", f"{base}/ckpt", trigger={"availableNow": True}, files_per_trigger=files * 3 // 2, glob=f"*{PACKED}",
                         archive_dir=f"{base}/archive", audit_path=f"{base}/audit", rejects_path=f"{base}/rejects")
        q.awaitTermination()
    return base


@query("n2_stream_two_tenants", O.with_sales(f"SELECT {ROWS_SQL}, t AS tenant_id FROM sales, (VALUES ('007'), ('7'), ('ACME:IN')) v(t)"))
def n2_stream_two_tenants(spark, sf):
    """Invoices sent again are known, those of other tenants are not: every line of each tenant once."""
    return _out(B.read_table(spark, f"{_tenant_stream(spark, sf)}/table").select(*COLS, M.TENANT))


@query("n3_n4_stream_audit", O.with_sales("""
SELECT 3 * count(*) AS added, 3 * count(*) AS total, CAST(0 AS BIGINT) AS rejected, true AS running, 4 * count(*) AS archived_or_waiting FROM sales"""))
def n3_n4_stream_audit(spark, sf):
    """The audit rows of that stream, and the lines of all uploads, which lie in the archive or still in the watched folder (the clean-up runs beside the stream)."""
    base = _tenant_stream(spark, sf)
    audit = spark.read.parquet(f"{base}/audit")
    steps = F.array_sort(F.collect_list(F.struct(F.col("batch_id"), F.col("NEW_RECORDS_ADDED").alias("n"), F.col("TOTAL_RECORDS_AFTER_RUN").alias("t"))))  # a row per batch
    running = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("ok")),
                          lambda a, r: F.struct((a["sum"] + r["n"]).alias("sum"), (a["ok"] & (r["t"] == a["sum"] + r["n"])).alias("ok")), lambda a: a["ok"])
    sums = audit.agg(F.sum("NEW_RECORDS_ADDED").alias("added"), F.max("TOTAL_RECORDS_AFTER_RUN").alias("total"), F.sum("REJECTED_RECORDS").alias("rejected"), running.alias("running"))
    at_once = 4 * spark.sparkContext.defaultParallelism  # files whose lines are stored together
    left = [f for folder in (f"{base}/src", f"{base}/archive") for f in A.list_files(spark, folder, (PACKED,), deep=True)]
    lines = 0
    for i in range(0, len(left), at_once):
        scratch = _folder(spark, "left")
        lines += A.read_folder_with_rejects(spark, left[i:i + at_once], scratch=scratch)[0].count()
        drop_folder(spark, scratch)
    return sums.select("*", F.lit(lines).cast("long").alias("archived_or_waiting"))


@query("b4_export_csv", O.with_sales(f"SELECT {ROWS_SQL} FROM sales"))
def b4_export_csv(spark, sf):
    path = _folder(spark, "csv")
    B.export_csv(_texts(T.sales(spark, sf).select(*COLS)), path, bom=True)
    return _out(A.coerce_types(A.read_folder(spark, path)).select(*COLS))


@query("b5_a7_json", O.with_sales(f"SELECT {ROWS_SQL} FROM x", LINES_CTE))
def b5_a7_json(spark, sf):
    path = _folder(spark, "json")
    B.export_json(_lines(spark, sf, "t").drop(M.TENANT), path)
    s = "DATE timestamp_ntz, INVOICE_NO string, CUSTOMER_NAME string, ITEMNAME string, QTY double, AMOUNT decimal(26,4)"
    return _out(A.read_json(spark, path, s))


@query("b7_audit", O.with_sales(f"""
SELECT 1 AS run, count(*) FILTER (WHERE DATE < TIMESTAMP '{FIRST}') AS added, count(*) FILTER (WHERE DATE < TIMESTAMP '{FIRST}') AS total FROM sales
UNION ALL SELECT 2, count(*) FILTER (WHERE DATE >= TIMESTAMP '{FIRST}'), count(*) FROM sales"""))
def b7_audit(spark, sf):
    path, audit = _folder(spark, "audited"), _folder(spark, "audit")
    s = T.sales(spark, sf).select(*COLS, M.TENANT)
    for batch in (s.where(F.col(M.DATE) < F.lit(FIRST).cast("timestamp")), s):
        B.append_audit(spark, audit, B.load(batch, path))
    a = spark.read.parquet(audit)
    return a.select(F.when(F.col("TOTAL_RECORDS_AFTER_RUN") == F.col("NEW_RECORDS_ADDED"), 1).otherwise(2).alias("run"),
                    F.col("NEW_RECORDS_ADDED").alias("added"), F.col("TOTAL_RECORDS_AFTER_RUN").alias("total"))


@query("a5_read_time_coercion", O.with_sales(
    "SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, CAST(CASE WHEN QTY = 1 THEN 0 ELSE AMOUNT END AS DOUBLE) AS AMOUNT, "
    "FINANCIAL_YEAR, MONTH FROM sales"))
def a5_read_time_coercion(spark, sf):
    s = T.sales(spark, sf).select(F.date_format(M.DATE, "yyyy-MM-dd").alias(M.DATE),
                                  F.when(F.col(M.QTY) == 1, F.lit("n/a")).otherwise(F.col(M.AMOUNT).cast("string")).alias(M.AMOUNT))
    return _out(A.read_time_coercion(s).select(M.DATE, M.AMOUNT, M.FY, M.MONTH))


@query("c7_text_dates", O.with_sales(
    "SELECT strftime(DATE, '%Y-%m-%d %H:%M:%S') AS DATE, CASE WHEN QTY % 5 = 4 THEN NULL ELSE strftime(DATE, '%Y-%m-%d') END AS parsed FROM sales"))
def c7_text_dates(spark, sf):
    """Dates in five spellings, months before days where only figures tell."""
    q = F.col(M.QTY).cast("int") % 5
    d = F.col(M.DATE)
    text = (F.when(q == 0, F.date_format(d, "M/d/yyyy")).when(q == 1, F.date_format(d, "d-MMM-yyyy"))
             .when(q == 2, F.date_format(d, "yyyy/MM/dd")).when(q == 3, F.date_format(d, "MMM d, yyyy")).otherwise(F.lit("soon")))
    s = T.sales(spark, sf).select(M.DATE, text.alias("text"))
    return _out(s.select(M.DATE, F.date_format(C.parse_date("text"), "yyyy-MM-dd").alias("parsed")))


@query("c15_surrogate_invoice", O.with_sales(f"SELECT {ROWS_SQL.replace('INVOICE_NO, ', '')}, 1 AS lines FROM sales"))
def c15_surrogate_invoice(spark, sf):
    """Every line gets its own number: grouping by it gives each line once, identical lines too."""
    sales = T.sales(spark, sf).select(*[c for c in COLS if c != M.INVOICE_NO])
    s = C.surrogate_invoice(sales).repartition(tasks_for(spark, sales.count()), M.INVOICE_NO)
    cols = [c for c in s.columns if c != M.INVOICE_NO]
    return _out(s.groupBy(M.INVOICE_NO, *cols).agg(F.count("*").cast("int").alias("lines")).drop(M.INVOICE_NO))


@query("c10_c14_c16_c17_shape", O.with_sales(f"""
SELECT {TS_SQL}, INVOICE_NO, CUSTOMER_NAME, QTY, CAST(AMOUNT AS DOUBLE) AS AMOUNT, 'City Not Found' AS CITY, 'State Not Found' AS STATE,
       't-1' AS tenant_id FROM sales"""))
def c10_c14_c16_c17_shape(spark, sf):
    """Absent places get their defaults, stale tax columns go, the upload's tenant is replaced, columns get their order."""
    s = T.sales(spark, sf).select(M.AMOUNT, M.QTY, M.CUSTOMER, M.INVOICE_NO, M.DATE, M.TENANT).withColumn("IGST", F.lit(1))
    taxed = C.add_taxes(s, rate="0.18").drop("IGST", "CGST", "SGST", "TAX", "TOTALAMOUNT")
    return _out(C.order_columns(C.tag_tenant(C.default_columns(taxed), "t-1")))


def _scaled(v: str, scale: int, dp: int, suffix: str) -> str:
    return f"CAST(CAST(ROUND({v} / {scale}, {dp}) AS DECIMAL(38,{dp})) AS VARCHAR) || ' {suffix}'"


@query("m1_inr_signed", O.with_sales(f"""
SELECT CUSTOMER_NAME, CAST(v AS DOUBLE) AS AMOUNT,
  'Rs. ' || CASE WHEN abs(v) >= 10000000 THEN {_scaled('v', 10000000, 2, 'Cr')} WHEN abs(v) >= 100000 THEN {_scaled('v', 100000, 2, 'L')}
       WHEN abs(v) >= 1000 THEN {_scaled('v', 1000, 1, 'K')} ELSE format('{{:,}}', CAST(ROUND(v, 0) AS BIGINT)) END AS signed,
  CASE WHEN abs(v) >= 10000000 THEN {_scaled('abs(v)', 10000000, 1, 'Cr')} WHEN abs(v) >= 100000 THEN {_scaled('abs(v)', 100000, 1, 'L')}
       WHEN abs(v) >= 1000 THEN {_scaled('abs(v)', 1000, 0, 'K')} ELSE format('{{:,}}', CAST(ROUND(abs(v), 0) AS BIGINT)) END AS compact
FROM (SELECT CUSTOMER_NAME, CAST(SUM(AMOUNT * CASE WHEN QTY > 20 THEN -1 ELSE 1 END) AS DECIMAL(20,4)) AS v FROM sales GROUP BY 1)"""))
def m1_inr_signed(spark, sf):
    s = T.sales(spark, sf).groupBy(M.CUSTOMER).agg(F.sum(F.when(F.col(M.QTY) > 20, -F.col(M.AMOUNT)).otherwise(F.col(M.AMOUNT))).alias("v"))
    return s.select(M.CUSTOMER, F.col("v").cast("double").alias(M.AMOUNT), inr_signed("v").alias("signed"), inr_compact("v").alias("compact"))


@query("b8_daily_archive", O.with_sales("""
SELECT CUSTOMER_NAME, Revenue, Orders, CASE WHEN Orders > 0 THEN Revenue / Orders ELSE 0.0 END AS AOV, '2024-04-01' AS run_date FROM (
  SELECT CUSTOMER_NAME, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
  FROM sales WHERE CUSTOMER_NAME IS NOT NULL GROUP BY 1)"""))
def b8_daily_archive(spark, sf):
    base = _folder(spark, "archive")
    B.archive(B.daily_reports(T.sales(spark, sf)), base, "2024-04-01")
    out = spark.read.parquet(f"{base}/customer_overview")
    return out.withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))


@query("b8_daily_summary_kpis", O.with_sales(f"""
SELECT {KPI_SQL}, CAST(COALESCE(SUM(QTY), 0) AS DOUBLE) AS quantity, COUNT(DISTINCT ITEMNAME) AS items, COUNT(DISTINCT ITEM_NAME_GROUP) AS groups,
       '2024-04-01' AS run_date FROM sales"""))
def b8_daily_summary_kpis(spark, sf):
    base = _folder(spark, "archive")
    B.archive(B.daily_reports(T.sales(spark, sf)), base, "2024-04-01")
    return spark.read.parquet(f"{base}/executive_summary_kpis").withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))


@query("b8_daily_summary_groups", O.with_sales("""
SELECT ITEM_NAME_GROUP, Revenue, Orders, CASE WHEN Orders > 0 THEN Revenue / Orders ELSE 0.0 END AS AOV, '2024-04-01' AS run_date FROM (
  SELECT ITEM_NAME_GROUP, CAST(COALESCE(SUM(AMOUNT), 0) AS DOUBLE) AS Revenue, COUNT(DISTINCT INVOICE_NO) AS Orders
  FROM sales WHERE ITEM_NAME_GROUP IS NOT NULL GROUP BY 1)"""))
def b8_daily_summary_groups(spark, sf):
    base = _folder(spark, "archive")
    B.archive(B.daily_reports(T.sales(spark, sf)), base, "2024-04-01")
    return spark.read.parquet(f"{base}/executive_summary_groups").withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))


@query("m5_json_text", O.with_sales("""
SELECT to_json({'CUSTOMER_NAME': CUSTOMER_NAME, 'Orders': Orders, 'LastOrder': LastOrder, 'Note': NULL}) AS record FROM (
  SELECT CUSTOMER_NAME, COUNT(DISTINCT INVOICE_NO) AS Orders, strftime(max(DATE), '%Y-%m-%dT%H:%M:%S') AS LastOrder FROM sales GROUP BY 1)"""))
def m5_json_text(spark, sf):
    s = T.sales(spark, sf).groupBy(M.CUSTOMER).agg(F.count_distinct(M.INVOICE_NO).alias("Orders"), F.max(M.DATE).alias("LastOrder"))
    return s.withColumn("Note", F.lit(None).cast("string")).select(json_text(M.CUSTOMER, "Orders", "LastOrder", "Note").cast("string").alias("record"))
