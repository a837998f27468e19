"""The sales fact over the driver's TPC-H-like tables.

``sales`` maps line items onto invoice lines (one row per line):

  DATE=o_orderdate, INVOICE_NO=o_orderkey, CUSTOMER_NAME=c_name, ITEMNAME=p_name,
  ITEM_NAME_GROUP=p_brand, MATERIALGROUP=p_type, CITY=n_name, STATE=r_name,
  QTY=l_quantity, AMOUNT=extendedprice*(1-discount) as exact decimal,
  tenant_id=c_mktsegment.

Scale notes: lineitem ⋈ orders is the one big-big join. Both tables are kept
once per input as tables bucketed on the order key (``bucketed``), orders with
their customer's columns and lines with their part's, so every join of them, for this fact and the dirty
one, is co-located and shuffles nothing. customer and part are joined by key, before
rows get wide: broadcast only if under the threshold; nation and region are fixed 25/5-row tables and are
broadcast explicitly. Every scan selects only the columns it needs, so Parquet
reads are pruned. Buckets and ranges are numbered by the size of the lines, so
what a task reads and sorts stays the same as the tables grow.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import fy_label, fy_start, month_label, month_start
from ..plans.common import materialize, with_total

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def amount_expr(price: str = "l_extendedprice", discount: str = "l_discount"):
    return F.col(price).cast("decimal(12,2)") * (F.lit(1) - F.col(discount).cast("decimal(4,2)"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = bucketed(spark, sf_dir, "lineitem", "l_orderkey", lambda: _lines(spark, sf_dir))
    od = _bucketed_orders(spark, sf_dir)
    return li.join(od, li.l_orderkey == od.o_orderkey)


def _bucketed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir, "orders", "o_orderkey", lambda: _orders(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str, many: DataFrame, key: str, dim: str, columns: DataFrame, dim_key: str) -> DataFrame:
    """``many`` with the columns of a dimension: broadcast if its files are under the threshold, else both dealt by the
    key to as many tasks as the input asks for (the session's number of partitions knows nothing of its size)."""
    if _length(spark, f"{sf_dir.rstrip('/')}/{dim}.parquet") > _broadcast_bytes(spark):
        n = max(buckets_for(spark, sf_dir), _partitions(spark))
        many, columns = many.repartition(n, key), columns.repartition(n, dim_key)
    return many.join(columns, F.col(key) == F.col(dim_key))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part: joined here, before the rows get wide, once for both facts."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return _joined(spark, sf_dir, li, "l_partkey", "part", pa, "p_partkey").drop("l_partkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and place: joined here, where there is a row per order and not one per line."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    rg = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    geo = na.join(rg, na.n_regionkey == rg.r_regionkey).drop("n_regionkey", "r_regionkey")
    cust = cu.join(F.broadcast(geo), cu.c_nationkey == geo.n_nationkey).drop("n_nationkey")
    return _joined(spark, sf_dir, od, "o_custkey", "customer", cust, "c_custkey").drop("o_custkey", "c_custkey")


BUCKET_BYTES = 32 << 20  # stored bytes of lines a bucket aims at
RANGE_BYTES = 12 << 20  # stored bytes of lines a range of the fact aims at: its rows are some 16 times as large while sorted
BROADCAST_DAYS = 500_000


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def _broadcast_bytes(spark: SparkSession) -> int:
    """The session's threshold of a broadcast join, in bytes; below 0: never."""
    said = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower())
    return int(said[1]) << 10 * " kmgt".index(said[2] or " ")


def buckets_for(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of both sides, from the size of the larger one: a power of two, at least 8."""
    n = 8
    while n * BUCKET_BYTES < _length(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet"):
        n *= 2
    return n


def files_for(spark: SparkSession, sf_dir: str) -> int:
    """Files that all lines are dealt to as text, each read by one task: an even number."""
    return 2 * -(-_length(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet") // BUCKET_BYTES)


def _length(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bucketed(spark: SparkSession, sf_dir: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build`` bucketed and sorted on their order key, made once per input under the shared folder.

    The one shuffle of the rows happens here, at ingestion; a file is a bucket. The files are found again by other
    sessions, which declare the table over them.
    """
    import uuid

    from ..session import shared_dir, shuffles_go

    n = buckets_for(spark, sf_dir)
    mark = _fingerprint(spark, sf_dir)
    target = shared_dir(spark, f"fact/{name}-by-{key}-{LAYOUT}-{n}-{mark}")
    declared = f"ledgerline_{name}_{LAYOUT.replace('-', '_')}_{n}_{mark}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    columns = build()
    if not fs.exists(path(f"{target}/_SUCCESS")):
        beside, made = f"{target}-tmp-{uuid.uuid4().hex}", f"ledgerline_making_{uuid.uuid4().hex}"
        with shuffles_go(spark):
            columns.repartition(n, key).write.bucketBy(n, key).sortBy(key).options(path=beside, compression="zstd").format("parquet").saveAsTable(made)
        spark.sql(f"DROP TABLE {made}")  # the files stay: their folder was named
        if not fs.exists(path(f"{target}/_SUCCESS")):
            if fs.exists(path(target)):
                fs.delete(path(target), True)
            if not fs.rename(path(beside), path(target)):
                raise OSError(f"could not put the bucketed table in place: {target}")
        else:  # another builder won the race
            fs.delete(path(beside), True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {declared} ({kinds}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{target}'")
    return spark.table(declared)


def with_calendar(df: DataFrame) -> DataFrame:
    """FINANCIAL_YEAR, MONTH labels plus sortable fy_start / month_start."""
    d = F.col(M.DATE)
    return (df.withColumn(M.FY, fy_label(d))
              .withColumn(M.MONTH, month_label(d))
              .withColumn(M.FY_START, fy_start(d))
              .withColumn(M.MONTH_START, month_start(d)))


def build_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean sales fact with calendar columns, as a plan over the tables."""
    b = _base(spark, sf_dir)
    fact = b.select(
        F.col("o_orderdate").alias(M.DATE),
        F.col("o_orderkey").cast("string").alias(M.INVOICE_NO),
        F.col("c_name").alias(M.CUSTOMER),
        F.col("p_name").alias(M.ITEM),
        F.col("p_brand").alias(M.ITEM_GROUP),
        F.col("p_type").alias(M.MATERIAL),
        F.col("n_name").alias(M.CITY),
        F.col("r_name").alias(M.STATE),
        F.col("l_quantity").alias(M.QTY),
        amount_expr().alias(M.AMOUNT),
        F.col("c_mktsegment").alias(M.TENANT),
    )
    return with_calendar(fact)


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored raw-looking lines (see ``build_dirty_sales``)."""
    return stored(spark, sf_dir, "dirty_sales", build_dirty_sales)


def build_dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-looking lines with deterministic defects for cleansing and DQ operators.

    Every defect is a pure function of the row's keys, so the oracle SQL builds
    the identical table. Columns are the *raw* ones (no calendar, no taxes), and
    a REGION column carries the region name for STATE coalescing.
    """
    b = _base(spark, sf_dir)
    ok, nk, pk = F.col("o_orderkey"), F.col("c_nationkey"), F.col("p_partkey")
    amount = amount_expr()
    return b.select(
        F.when(ok % 97 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias(M.DATE),
        ok.cast("string").alias(M.INVOICE_NO),
        F.col("c_name").alias(M.CUSTOMER),
        F.col("p_name").alias(M.ITEM),
        (F.when(pk % 11 == 0, F.concat(F.lit("raw "), F.col("p_brand")))
          .when(pk % 13 == 0, F.concat(F.lit("conduit  "), F.col("p_brand"), F.lit(" gland")))
          .when(pk % 17 == 0, F.lit(None))
          .when(pk % 19 == 0, F.concat(F.lit("\u00a0REVERSE  FORWORD "), F.col("p_brand")))
          .otherwise(F.col("p_brand"))).alias(M.ITEM_GROUP),
        F.col("p_type").alias(M.MATERIAL),
        (F.when(nk == 24, F.lit("UNKNOWN"))
          .when(nk == 3, F.concat(F.lit("\u00a0"), F.lower(F.col("n_name")), F.lit("\t")))
          .otherwise(F.col("n_name"))).alias(M.CITY),
        (F.when(nk % 7 == 0, F.lit(""))
          .when(nk == 13, F.lit(None))
          .when(nk == 11, F.lit("State Not Found"))
          .otherwise(F.col("r_name"))).alias(M.STATE),
        F.col("r_name").alias("REGION"),
        F.col("l_quantity").alias(M.QTY),
        (F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), -amount)
          .when(ok % 89 == 0, F.lit(0))
          .otherwise(amount)).cast(M.MONEY).alias(M.AMOUNT),
        F.col("c_mktsegment").alias(M.TENANT),
    )


def customer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer master derived from ``customer`` (CUSTOMER_NAME, STATE, CITY).

    All customers are in it (the dirty sales hold some that no master knows);
    nation 2 has a NULL master STATE, and customers of nation 4 appear twice
    with different cities (the duplicate the dedupe rule must resolve).
    """
    cu = table(spark, sf_dir, "customer").select("c_name", "c_nationkey")
    na = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    rg = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = cu.join(na, cu.c_nationkey == na.n_nationkey).join(rg, F.col("n_regionkey") == F.col("r_regionkey"))
    base = j.select(
        F.col("c_name").alias(M.CUSTOMER),
        F.when(F.col("c_nationkey") == 2, F.lit(None)).otherwise(F.concat(F.lit("M_"), F.col("r_name"))).alias(M.STATE),
        F.concat(F.lit("M_"), F.col("n_name")).alias(M.CITY),
    )
    dup = j.where(F.col("c_nationkey") == 4).select(
        F.col("c_name").alias(M.CUSTOMER),
        F.concat(F.lit("M_"), F.col("r_name")).alias(M.STATE),
        F.concat(F.lit("A_"), F.col("n_name")).alias(M.CITY),
    )
    return base.unionByName(dup)


SALES_INPUTS = ["lineitem", "orders", "customer", "nation", "region", "part"]
LAYOUT = "r4"  # bump when the stored layout changes
_STORED_SCHEMAS: dict[str, tuple] = {}  # target path -> (schema, columns): skips re-analysing the build plan


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the inputs: path, size and modification time of each table."""
    import hashlib

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1(sf_dir.rstrip("/").encode())
    for t in SALES_INPUTS:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = p.getFileSystem(conf)
        st = fs.getFileStatus(p)
        summary = fs.getContentSummary(p)
        h.update(f"{t}:{summary.getLength()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(tenant, day, range) and the number of ranges: contiguous days of about equal numbers of orders, as many as the lines ask for."""
    n = max(8, _partitions(spark), -(-_length(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet") // RANGE_BYTES))
    od = _bucketed_orders(spark, sf_dir).select(F.col("o_orderdate").cast("date").alias("__day"), F.col("c_mktsegment").alias("__tenant"))
    days = od.groupBy("__tenant", "__day").agg(F.count("*").alias("__orders"))
    order = Window.orderBy("__tenant", "__day")  # a row per tenant and day, however many lines
    days = days.withColumn("__upto", F.sum("__orders").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = days.agg(F.sum("__orders").alias("__all"))
    return with_total(days, total).select("__tenant", "__day", F.least(F.floor((F.col("__upto") - F.col("__orders")) * n / F.col("__all")), F.lit(n - 1)).cast("int").alias("__range")), n


def write_fact(plan: DataFrame, path: str, sf_dir: str | None = None) -> None:
    """The plan's rows by contiguous ranges of (tenant, DATE), one range a task, sorted, partitioned by tenant.

    With ``sf_dir`` the ranges are taken from the orders' days, so the plan runs once; without, Spark samples the plan
    for them, which runs it twice. Lines without a date, or of a day that no order has, are dealt by invoice.
    """
    from ..session import shuffles_go

    spark = plan.sparkSession
    if sf_dir is None:
        dealt = plan.repartitionByRange(M.TENANT, M.DATE)
    else:
        days, n = _days(spark, sf_dir)
        days = materialize(days)
        days = F.broadcast(days) if days.count() <= BROADCAST_DAYS else days
        day = F.to_date(F.col(M.DATE))
        dealt = plan.join(days, (F.col(M.TENANT) == F.col("__tenant")) & (day == F.col("__day")), "left")
        at = F.coalesce(F.col("__range"), F.pmod(F.xxhash64(M.INVOICE_NO), F.lit(n)).cast("int"))
        dealt = dealt.withColumn("__at", at).repartitionById(n, F.col("__at")).select(*plan.columns)
    with shuffles_go(spark):
        dealt.sortWithinPartitions(M.TENANT, M.DATE).write.mode("overwrite").option("compression", "zstd").partitionBy(M.TENANT).parquet(path)


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table derived from the inputs, built once per input fingerprint and
    written under the shared checkpoint folder.

    The write is range-partitioned on (tenant, DATE), by bounds from the orders
    alone: tasks get balanced contiguous ranges — a tenant holding a third of all rows is split by date
    across many tasks, not written by one — each file holds one date range, and
    the output is partitioned by tenant, so reports get partition pruning on
    tenant and row-group skipping on DATE. It goes to a temporary path first
    and is renamed into place, so a concurrent or failed build never leaves a
    partial table.
    """
    import uuid

    from ..session import shared_dir

    target = shared_dir(spark, f"fact/{name}-{LAYOUT}-{_fingerprint(spark, sf_dir)}")
    known = _STORED_SCHEMAS.get(target)
    if known is not None:  # built and analysed earlier in this process
        return spark.read.schema(known[0]).parquet(target).select(*known[1])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    tp = jvm.org.apache.hadoop.fs.Path(target)
    fs = tp.getFileSystem(conf)
    plan = build(spark, sf_dir)
    path = jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(f"{target}/_SUCCESS")):
        tmp = f"{target}-tmp-{uuid.uuid4().hex}"
        write_fact(plan, tmp, sf_dir)
        if fs.exists(path(f"{target}/_SUCCESS")):  # another builder won the race
            fs.delete(path(tmp), True)
        else:
            if fs.exists(tp):  # left by a broken rename: not a table
                fs.delete(tp, True)
            if not fs.rename(path(tmp), tp):
                raise OSError(f"could not put the built table in place: {target}")
    _STORED_SCHEMAS[target] = (plan.schema, plan.columns)
    return spark.read.schema(plan.schema).parquet(target).select(*plan.columns)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sales fact (the reference's one wide ``sales_master`` table):
    ``build_sales`` — the one big join, lineitem x orders, of two tables bucketed
    on the order key; dimensions are broadcast — written once by ``stored`` and scanned by
    every report with partition pruning, pushed filters and column pruning."""
    return stored(spark, sf_dir, "sales", build_sales)
