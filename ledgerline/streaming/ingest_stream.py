"""Streaming ingest N1–N4: a folder watched by Structured Streaming.

N1  ``readStream.format("binaryFile")`` lists new files (only ``path`` is
    selected, so file contents are not read by the stream itself);
    ``pathGlobFilter`` keeps data files, temp ``~$`` files never match.
N2  ``foreachBatch``: the batch's files are cut in records in parallel (A2) and
    run through the ingest pipeline (C18). Which invoices are new is decided by
    keyed state: the batch's distinct (tenant, invoice) pairs are staged, and a
    second stream over staged pairs drops every pair that an earlier batch had
    (``dropDuplicates``, kept in RocksDB), so the history is never read. Rows of
    the pairs that are left, told by these or by the known ones if fewer, go to the ``batch_id=`` partition by dynamic
    overwrite. All steps of a replayed batch give the same rows again.
N3  ``cleanSource=archive`` moves processed files to an archive folder.
N4  Each batch writes an audit row: rows added and rejected as counted while
    writing, and a running total, the last audit row's plus the rows added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..operators.ingest import IngestConfig, ingest
from ..session import drop_folder, shuffles_go
from ..sinks.writers import audit_row, keep_schema, table_exists, with_tenant
from ..sources.files import coerce_types, read_folder_with_rejects

BATCH = "batch_id"
# the binaryFile source's fixed schema (a stream must declare it)
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# what the state remembers: the tenant and the number; rows of an upload without numbers count as new
KEY = [M.TENANT, "__numbered", "__number"]
KEY_SCHEMA = f"`{M.TENANT}` string, __numbered boolean, __number string"


def _renamed(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"could not put the staged batch in place: {target}")


def _dynamic(df: DataFrame, *parts: str):
    return df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy(*parts)


def with_key(rows: DataFrame, batch_id: int) -> DataFrame:
    """``rows`` with the key that the state remembers."""
    numbered = M.INVOICE_NO in rows.columns
    number = F.col(M.INVOICE_NO).cast("string") if numbered else F.lit(str(batch_id))
    return rows.withColumns({"__numbered": F.lit(numbered), "__number": number})


def stage_keys(spark: SparkSession, rows: DataFrame, batch_id: int, state: str) -> None:
    """The batch's distinct keys under ``state``/staged, put in place whole; a batch that lies there already is left."""
    target = f"{state}/staged/{BATCH}={batch_id}"
    if table_exists(spark, target):
        return
    beside = f"{state}/staging/{uuid.uuid4().hex}"
    rows.select(*KEY).distinct().write.option("compression", "zstd").parquet(beside)
    _renamed(spark, beside, target)


def new_keys(spark: SparkSession, state: str) -> DataFrame:
    """(key, batch_id) of every key's first batch, brought up to the staged batches by a stream with keyed state.

    The stream reads the key columns of newly staged files only; its sink lists each micro-batch exactly once.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = f"{KEY_SCHEMA}, {BATCH} long"
    keys = session.readStream.schema(schema).parquet(f"{state}/staged").select(*KEY, BATCH).dropDuplicates(KEY)
    sink = keys.writeStream.format("parquet").options(checkpointLocation=f"{state}/checkpoint", path=f"{state}/keys", compression="zstd")
    sink.partitionBy(BATCH).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{state}/keys")


def _of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = keys.select(*[F.col(k).alias(f"{k}_") for k in KEY])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in KEY]
    return rows.join(keys, same[0] & same[1] & same[2], how)


def rows_of_new_keys(rows: DataFrame, staged: DataFrame, first: DataFrame, known_path: str) -> DataFrame:
    """The rows whose key is in ``first``, the new ones among the batch's distinct keys (``staged``).

    If all are new, every row stays and none is shuffled; else rows are told by the fewer keys, the new or the known ones.
    """
    new, every = first.count(), staged.count()
    if new == every:
        return rows
    if 2 * new <= every:
        return _of(rows, first, "left_semi")
    _of(staged, first, "left_anti").write.option("compression", "zstd").parquet(known_path)
    return _of(rows, rows.sparkSession.read.schema(KEY_SCHEMA).parquet(known_path), "left_anti")


def process_batch(spark: SparkSession, paths: list[str], batch_id: int, dst: str, master: DataFrame | None,
                  cfg: IngestConfig, city_map: DataFrame | None, audit_path: str | None,
                  tenant_id: str | None = None, rejects_path: str | None = None, state: str | None = None) -> int:
    """N2 + N4 for one micro-batch; returns rows added.

    A file that cannot be read fails the batch, so that it is tried again;
    malformed lines and empty files go to ``rejects_path`` and are counted in the audit row.
    Staged pairs and known invoices lie under ``state`` (beside ``dst`` unless given), and while
    the batch runs its lines, which are removed with its shuffle files when each is done.
    """
    state = state or f"{dst.rstrip('/')}-state"
    scratch = f"{state}/records/{uuid.uuid4().hex}"
    try:
        with shuffles_go(spark):
            return _processed(spark, paths, batch_id, dst, master, cfg, city_map, audit_path, tenant_id, rejects_path, state, scratch)
    finally:
        drop_folder(spark, scratch)


def _processed(spark: SparkSession, paths: list[str], batch_id: int, dst: str, master: DataFrame | None,
               cfg: IngestConfig, city_map: DataFrame | None, audit_path: str | None,
               tenant_id: str | None, rejects_path: str | None, state: str, scratch: str) -> int:
    raw, rejects = read_folder_with_rejects(spark, paths, scratch=scratch)  # headers normalised per file group, then unioned by name
    rejected = 0
    if rejects_path:
        seen = Observation(f"rejects_{batch_id}")
        rejects = rejects.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(BATCH, F.lit(batch_id).cast("long"))
        _dynamic(rejects, BATCH).parquet(rejects_path)
        rejected = int(seen.get.get("n", 0))
    elif not rejects.isEmpty():
        raise ValueError(f"batch {batch_id} holds malformed lines or empty files; name a rejects_path to set them aside")
    added = 0
    if raw is not None:
        rows = with_key(with_tenant(ingest(raw, master, cfg, city_map, coerce=coerce_types), tenant_id), batch_id)
        stage_keys(spark, rows, batch_id, state)
        first = new_keys(spark, state).where(F.col(BATCH) == batch_id).select(*KEY)
        staged = spark.read.schema(KEY_SCHEMA).parquet(f"{state}/staged/{BATCH}={batch_id}")
        new = rows_of_new_keys(rows, staged, first, f"{scratch}/known").drop(*KEY[1:]).withColumn(BATCH, F.lit(batch_id).cast("long"))
        obs = Observation(f"batch_{batch_id}")
        keep_schema(spark, dst, new.schema)
        _dynamic(new.observe(obs, F.count(F.lit(1)).alias("added")), M.TENANT, BATCH).parquet(dst)
        added = int(obs.get.get("added", 0))
    if audit_path:
        before = 0
        if table_exists(spark, audit_path):
            earlier = spark.read.parquet(audit_path).where(F.col(BATCH) < batch_id)
            before = earlier.agg(F.max_by("TOTAL_RECORDS_AFTER_RUN", BATCH)).first()[0] or 0
        audit = audit_row(spark, added, before + added).withColumns({"REJECTED_RECORDS": F.lit(rejected).cast("long"), BATCH: F.lit(batch_id).cast("long")})
        _dynamic(audit, BATCH).parquet(audit_path)
    return added


def start_ingest(spark: SparkSession, src: str, dst: str, checkpoint: str, master: DataFrame | None = None,
                 cfg: IngestConfig = IngestConfig(), city_map: DataFrame | None = None,
                 trigger: dict | None = None, files_per_trigger: int | None = None,
                 archive_dir: str | None = None, audit_path: str | None = None, glob: str = "*.csv",
                 tenant_id: str | None = None, rejects_path: str | None = None):
    """Start the folder stream; returns the ``StreamingQuery``.

    ``trigger`` is a ``DataStreamWriter.trigger`` keyword dict, e.g.
    ``{"availableNow": True}`` or ``{"processingTime": "1 minute"}``.
    ``files_per_trigger=1`` reproduces the one-upload-per-run path.
    ``tenant_id`` tags every row; without it the files must have that column.
    Known invoices are kept under ``checkpoint``/invoices.
    """
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    stream = r.load(src).select("path")

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.collect()]  # this batch's file list (bounded by files per trigger)
        if paths:
            process_batch(spark, sorted(paths), batch_id, dst, master, cfg, city_map, audit_path, tenant_id, rejects_path, f"{checkpoint}/invoices")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
