"""Sinks B1–B8: incremental append, full replace, tenant delete, exports,
snapshot merge, audit log, report archive.

Writes are distributed (``DataFrame.write``); nothing is collected. Paths are
caller-given and, on a cluster, shared storage.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..fixed_values import PREFERRED_ORDER
from ..session import shuffles_go


def append_new(new: DataFrame, existing: DataFrame | None, key: str = M.INVOICE_NO,
               tenant_col: str | None = M.TENANT) -> DataFrame:
    """B1: the rows of ``new`` whose invoice is not stored yet (per tenant).

    All lines of a new invoice are kept, and duplicates inside the batch are
    kept; no key column -> everything. The stored keys are first cut down to
    those present in the batch and de-duplicated, then a NULL-safe left-anti
    join removes known invoices; a skewed key costs one row on the build side.
    """
    if existing is None or key not in new.columns:
        return new
    keys = [c for c in (tenant_col, key) if c and c in new.columns and c in existing.columns]

    def null_safe(left: DataFrame, right: DataFrame):
        cond = None
        for c in keys:
            x = left[c].eqNullSafe(right[c])
            cond = x if cond is None else cond & x
        return cond

    # Only stored keys that occur in this batch matter. The batch's key set is
    # usually small next to the history, so AQE broadcasts it and the history
    # scan is filtered map-side instead of shuffling every stored key.
    batch_keys = new.select(*keys).distinct()
    stored = existing.select(*keys)
    hits = stored.join(batch_keys, null_safe(stored, batch_keys), "left_semi").distinct()
    return new.join(hits, null_safe(new, hits), "left_anti")


FEW_KEYS = 10_000  # (tenant, key) pairs of a batch that are pushed to the scan as lists


def may_hold_keys(existing: DataFrame, new: DataFrame, key: str = M.INVOICE_NO, tenant_col: str = M.TENANT) -> DataFrame:
    """The stored rows whose row group can hold a key of the batch, by literal filters that reach the Parquet reader.

    A batch of at most ``FEW_KEYS`` pairs gives lists of its tenants (partitions) and keys (statistics, dictionaries and
    Bloom filters of row groups); a larger one gives the range of its keys (statistics). Rows that are left out have no
    key of the batch; of those left in, ``append_new`` tells which do. Reads the keys of ``new`` once, or twice if many.
    """
    if any(c not in df.columns for df in (existing, new) for c in (key, tenant_col)) or existing.schema[key].dataType != new.schema[key].dataType:
        return existing

    def or_null(rows: Column | None, empty: bool) -> DataFrame:
        # NULL keys by a scan of their own: in one condition they would keep Bloom filters from ruling anything out
        parts = [existing.where(c) for c, wanted in ((rows, rows is not None), (F.col(key).isNull(), empty)) if wanted]
        return reduce(DataFrame.unionByName, parts) if parts else existing.where(F.lit(False))

    pairs = new.select(tenant_col, key).distinct().limit(FEW_KEYS + 1).collect()  # one more tells that there are more
    if len(pairs) <= FEW_KEYS:
        tenants, values = ({r[i] for r in pairs} for i in (0, 1))
        own = F.col(tenant_col).isin(sorted(tenants - {None}))
        existing = existing.where(own | F.col(tenant_col).isNull() if None in tenants else own)
        return or_null(F.col(key).isin(sorted(values - {None})) if values - {None} else None, None in values)
    low, high, empty = new.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
    return or_null(F.col(key).between(F.lit(low), F.lit(high)) if low is not None else None, empty > 0)


def _writer(df: DataFrame, key: str = M.INVOICE_NO):
    """A writer that gives each row group a Bloom filter of its invoices, as large as they need."""
    w = df.write.option("compression", "zstd")
    if key in df.columns:
        w = w.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true")
    return w


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at ``path``; a failure to look is an error, not an absent table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


SCHEMA_FILE = "_schema.json"  # readers pass over names with an underscore


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema kept beside the table's files, null if there is none."""
    p, fs = _path(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def keep_schema(spark: SparkSession, path: str, new: T.StructType) -> None:
    """Keep the columns of ``new`` beside the table: those known already, then the others.

    A load whose write then fails has announced columns that no file holds; they read as NULL.
    """
    have = kept_schema(spark, path)
    if have is None and table_exists(spark, path):
        have = _merged_schema(spark, path)
    names = {f.name for f in have.fields} if have else set()
    fields = [*(have.fields if have else []), *(T.StructField(f.name, f.dataType) for f in new.fields if f.name not in names)]
    if have is not None and len(fields) == len(names) and kept_schema(spark, path) is not None:
        return
    p, fs = _path(spark, f"{path.rstrip('/')}/{SCHEMA_FILE}")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(T.StructType(fields).json().encode()))
    finally:
        stream.close()


def _merged_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.option("mergeSchema", True).parquet(path).schema


def read_table(spark: SparkSession, path: str, text_partitions: tuple[str, ...] = (M.TENANT,)) -> DataFrame:
    """A stored table with the columns of all its files; tenants stay text.

    The schema is the one kept beside the files by the writers here; only a
    table without it has its file footers merged. Spark infers partition values
    (``007`` would become 7), so the tenant column is declared a string.
    """
    schema = kept_schema(spark, path) or _merged_schema(spark, path)
    fields = [T.StructField(f.name, T.StringType()) if f.name in text_partitions else f for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def aligned(df: DataFrame, schema: T.StructType = M.SALES_SCHEMA) -> DataFrame:
    """Columns of the declared sales schema cast to its types; others as they are."""
    declared = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(c).cast(declared[c]).alias(c) if c in declared else F.col(c) for c in df.columns])


def with_tenant(df: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """The tenant column under its canonical name: ``tenant_id`` if given, else the column of that name in any case.

    Raises when there is neither: without a tenant, equal invoice numbers of
    two tenants could not be told apart.
    """
    found = M.col_ci(df, M.TENANT)
    if tenant_id is not None:
        return (df.drop(found) if found else df).withColumn(M.TENANT, F.lit(tenant_id))
    if found is None:
        raise ValueError(f"rows to load need the column {M.TENANT!r} or a tenant id")
    return df.withColumnRenamed(found, M.TENANT)


def load(new: DataFrame, path: str, key: str = M.INVOICE_NO, partition_by: str = M.TENANT) -> int:
    """B1 + write: append the new invoices under ``path`` (partitioned by tenant)
    and return the number of rows added (counted while writing)."""
    spark = new.sparkSession
    new = aligned(with_tenant(new) if partition_by == M.TENANT else new)
    if partition_by not in new.columns:
        raise ValueError(f"rows to load need the column {partition_by!r}")
    existing = read_table(spark, path, (partition_by,)) if table_exists(spark, path) else None
    with shuffles_go(spark):
        rows = new if existing is None else _unknown(new, existing, _stored_tenants(spark, path, partition_by), key, partition_by)
        obs = Observation("appended")
        rows = rows.observe(obs, F.count(F.lit(1)).alias("n"))
        keep_schema(spark, path, rows.schema)
        _writer(rows, key).mode("append").partitionBy(partition_by).parquet(path)
    return int(obs.get.get("n", 0))


def _stored_tenants(spark: SparkSession, path: str, partition_by: str) -> set[str | None]:
    """The tenants that have a folder in the table, null for the rows without one."""
    p, fs = _path(spark, path)
    names = (st.getPath().getName() for st in fs.listStatus(p))
    values = [unquote(n.removeprefix(f"{partition_by}=")) for n in names if n.startswith(f"{partition_by}=")]
    return {None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values}


def _unknown(new: DataFrame, existing: DataFrame, tenants: set[str | None], key: str, tenant_col: str) -> DataFrame:
    """The rows that ``append_new`` keeps; those of tenants that have nothing stored take no part in its joins."""
    if len(tenants) > FEW_KEYS or not isinstance(new.schema[tenant_col].dataType, T.StringType):
        return append_new(new, may_hold_keys(existing, new, key, tenant_col), key, tenant_col)
    own = F.coalesce(F.col(tenant_col).isin(sorted(tenants - {None})), F.lit(None in tenants))
    rest = new.where(own)
    return new.where(~own).unionByName(append_new(rest, may_hold_keys(existing, rest, key, tenant_col), key, tenant_col))


def replace_all(df: DataFrame, path: str, partition_by: str = M.TENANT) -> None:
    """B2: first load / full replace.

    The new table is written beside the old one, which is moved away only when
    the write has ended: a failed write leaves the old table as it was.
    """
    spark = df.sparkSession
    place, mark = path.rstrip("/"), uuid.uuid4().hex
    fresh, old = f"{place}-new-{mark}", f"{place}-old-{mark}"
    w = _writer(df)
    target, fs = _path(spark, place)
    try:
        with shuffles_go(spark):
            (w.partitionBy(partition_by) if partition_by in df.columns else w).parquet(fresh)
        keep_schema(spark, fresh, df.schema)
    except BaseException:
        fs.delete(_path(spark, fresh)[0], True)
        raise
    moved = fs.exists(target)
    if moved and not fs.rename(target, _path(spark, old)[0]):
        raise OSError(f"could not move the old table away: {place}")
    if not fs.rename(_path(spark, fresh)[0], target):
        if moved:
            fs.rename(_path(spark, old)[0], target)
        raise OSError(f"could not put the new table in place: {place}")
    if moved:
        fs.delete(_path(spark, old)[0], True)


def clear_tenant(spark: SparkSession, path: str, tenant: str, partition_by: str = M.TENANT) -> int:
    """Delete one tenant's partition, others untouched; returns rows deleted.

    The folder is taken from the files of the pruned read, not built from the
    tenant's text, so escaped names are found and no other path can be reached.
    """
    if not table_exists(spark, path):
        return 0
    own = read_table(spark, path, (partition_by,)).where(F.col(partition_by) == tenant)
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"^(.*/{partition_by}=[^/]*)/", 1)
    found = own.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).collect()  # one folder per tenant
    jvm = spark.sparkContext._jvm
    deleted = 0
    for row in found:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.folder))
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True):
            raise OSError(f"could not delete {row.folder}")
        deleted += row.n
    return deleted


def export_csv(df: DataFrame, path: str, bom: bool = False, **options) -> None:
    """CSV with header, written by the executors (one file per partition).

    Quotes are doubled, as the reader and spreadsheets expect; with ``bom`` the
    header starts with the UTF-8 mark. No rows give one file with the header.
    ``options`` are the writer's, such as ``compression``.
    """
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # the writer trims by default
    with shuffles_go(df.sparkSession):
        df.write.mode("overwrite").options(header=True, escape='"', **blanks, **options).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON records, NULLs kept as null, ISO timestamps."""
    (df.write.mode("overwrite").option("ignoreNullFields", False)
       .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
       .json(path))


def merge_snapshot(old: DataFrame, new: DataFrame, key: str = M.INVOICE_NO,
                   preferred=PREFERRED_ORDER) -> DataFrame:
    """Old ∪ new, one row per invoice, the first kept (old before new; within
    a side, the smallest row by its columns — a deterministic stand-in for file
    order), preferred columns first; ``write_snapshot`` sorts by DATE.

    Struct ordering puts NULL fields first, matching ``NULLS FIRST``.
    """
    u = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in u.columns if c != "__src"]
    # arg-min per invoice as an aggregate: partial (map-side) aggregation keeps a
    # hot invoice from landing whole in one task, unlike a per-key window.
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(F.col("__src"), *[F.col(c) for c in cols])
    one = u.groupBy(key).agg(F.min_by(row, rank).alias("__r")).select(*[F.col(f"__r.{c}").alias(c) for c in cols])
    first = [c for c in preferred if c in one.columns]
    return one.select(*first, *[c for c in one.columns if c not in first])


def write_snapshot(df: DataFrame, path: str) -> None:
    """The snapshot sorted by DATE, latest first, across its files (a range sort)."""
    df.orderBy(F.col(M.DATE).desc_nulls_last()).write.mode("overwrite").parquet(path)


def audit_row(spark: SparkSession, rows_added: int, total_rows: int, run_ts: _dt.datetime | None = None) -> DataFrame:
    """One audit record (RUN_TIMESTAMP, NEW_RECORDS_ADDED, TOTAL_RECORDS_AFTER_RUN)."""
    ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(ts, int(rows_added), int(total_rows))],
                                 "RUN_TIMESTAMP timestamp_ntz, NEW_RECORDS_ADDED long, TOTAL_RECORDS_AFTER_RUN long")


def append_audit(spark: SparkSession, path: str, rows_added: int, total_rows: int | None = None) -> None:
    """Append a record; the total is the last record's plus the rows added unless given, so the table is not counted."""
    if total_rows is None:
        last = spark.read.parquet(path).agg(F.max_by("TOTAL_RECORDS_AFTER_RUN", "RUN_TIMESTAMP")).first()[0] if table_exists(spark, path) else 0
        total_rows = (last or 0) + rows_added
    audit_row(spark, rows_added, total_rows).write.mode("append").parquet(path)


def archive(reports: dict[str, DataFrame], path: str, run_date: str) -> list[str]:
    """Write each report frame under ``{path}/{name}/run_date=YYYY-MM-DD``."""
    out = []
    for name, df in reports.items():
        p = f"{path.rstrip('/')}/{name}/run_date={run_date}"
        df.write.mode("overwrite").parquet(p)
        out.append(p)
    return out


def daily_reports(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of the two daily reports — the executive summary (KPIs and all
    product groups) and the customer overview (each customer's revenue and orders)."""
    from ..operators.kpi import kpi_extended
    from ..operators.ranking import category_table

    return {
        "executive_summary_kpis": kpi_extended(df),
        "executive_summary_groups": category_table(df, None),
        "customer_overview": category_table(df, None, M.CUSTOMER),
    }
