"""File sources A1–A7: CSV / JSON / Parquet reads, multi-file ingest with
per-file headers, the tenant/date scan and read-time coercion.

Multi-file CSV (A2): a plain ``read.csv(dir, header=True)`` matches columns by
*position* and silently mixes columns when files order them differently. So
all files are cut in records at once, any number of tasks to a file
(``records``), which also finds the header of each; records of one header are
parsed together and the headers unioned by name. Values stay strings until
``coerce_types``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import fy_label, month_label
from ..operators.filters import date_range, rolling_years, tenant

# FIXED VALUES: temporary-file prefix ignored by the folder reader.
TEMP_PREFIX = "~$"
# Quotes are doubled inside quoted values, which may hold line breaks (Spark's own reader then makes a file one split).
CSV_OPTIONS = {"header": "true", "enforceSchema": "false", "mode": "PERMISSIVE", "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CORRUPT = "_corrupt_record"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, folder: str, suffixes=(".csv",), deep: bool = False) -> list[str]:
    """Data files directly under ``folder``, or with ``deep`` in folders below it too (temp ``~$`` files skipped)."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if deep and st.isDirectory():
            out += list_files(spark, st.getPath().toString(), suffixes, deep)
        if st.isFile() and not name.startswith(TEMP_PREFIX) and not name.startswith((".", "_")) \
                and name.lower().endswith(tuple(suffixes)):
            out.append(st.getPath().toString())
    return sorted(out)


def read_csv(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """A1: CSV with a header, every column a string (``schema`` only for
    folders with a contract header; matching is then by name, checked)."""
    r = spark.read.options(**CSV_OPTIONS)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_upload_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1 for one uploaded file, however large: every column a string, and the rejects (path, reason, record),
    lines whose number of fields differs from the header's. A file without a header line raises."""
    rows, rejects, empty = _read_uploads(spark, [path], standardize=False)
    if empty:
        raise ValueError(f"uploaded file is empty: {path}")
    return rows, rejects


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A1 for one uploaded file whose lines must all be well formed: a line of too many or too few fields raises."""
    rows, rejects = read_upload_with_rejects(spark, path)
    bad = rejects.limit(3).collect()
    if bad:
        raise ValueError(f"{path} holds lines whose number of fields differs from the header's (read_upload_with_rejects sets them aside): {[r.record for r in bad]}")
    return rows


def _header_names(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]))


def _parsed(records: DataFrame, header: str, sample: str) -> DataFrame:
    """Records of one header as strings, with ``path``, ``record`` and ``_corrupt_record`` (set for those of too many or too few fields)."""
    from pyspark.sql import types as T

    names = _header_names(header)
    if len(set(names)) < len(names) or not all(names):  # Spark numbers such columns itself
        names = records.sparkSession.read.options(**CSV_OPTIONS).csv(sample).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "enforceSchema", "multiLine")} | {"columnNameOfCorruptRecord": CORRUPT}
    return records.where(F.col("header") == header).select("path", "record", F.from_csv("record", schema.toDDL(), options).alias("__r"))


def _read_uploads(spark: SparkSession, files: list[str], standardize: bool, scratch: str | None = None) -> tuple[DataFrame | None, DataFrame, bool]:
    """(well-formed rows, null without any header; rejects; whether some file has no header)."""
    from ..operators.ingest import standardize_headers
    from .records import read_records

    rejects = spark.createDataFrame([], "path string, reason string, record string")
    if not files:
        return None, rejects, False
    records, named = read_records(spark, files, scratch)
    layouts = named.groupBy("header").agg(F.min("path").alias("sample")).collect()  # a row per distinct header
    empty = any(r["header"] is None for r in layouts)
    rejects = rejects.unionByName(named.where("header IS NULL").select("path", F.lit("empty file").alias("reason"), F.lit(None).cast("string").alias("record")))
    out = None
    for layout in sorted((r for r in layouts if r["header"] is not None), key=lambda r: r["header"]):
        rows = _parsed(records, layout["header"], layout["sample"])
        bad = F.col("__r")[CORRUPT].isNotNull()
        rejects = rejects.unionByName(rows.where(bad).select("path", F.lit("number of fields").alias("reason"), "record"))
        df = rows.where(~bad).select("__r.*").drop(CORRUPT)
        if standardize:
            df = standardize_headers(df)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, rejects, empty


def read_folder_with_rejects(spark: SparkSession, paths: str | list[str], standardize: bool = True,
                             scratch: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """A2: read many CSV files whose headers may differ; files are split in records together and in parallel
    (``records``), headers normalised (C1/C2), outer union by name; ``~$`` temp files ignored.

    Also returns the rejects (path, reason, record): lines whose number of
    fields differs from their header's, and files without a header line. A file
    that cannot be read raises: skipping it would lose its rows unseen. Both
    rest on tables in ``scratch``, if given, for the caller to remove.
    """
    files = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    files = [f for f in files if not f.rsplit("/", 1)[-1].startswith(TEMP_PREFIX)]
    out, rejects, _ = _read_uploads(spark, files, standardize, scratch)
    return out, rejects


def read_folder(spark: SparkSession, paths: str | list[str], standardize: bool = True) -> DataFrame | None:
    """The well-formed rows of ``read_folder_with_rejects``."""
    return read_folder_with_rejects(spark, paths, standardize)[0]


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON records (one object per line, or a JSON array with multiLine)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def coerce_types(df: DataFrame) -> DataFrame:
    """Text uploads -> typed columns: AMOUNT exact decimal and QTY/QUANTITY/RATE
    double via ``try_cast`` (unparsable -> NULL, never an error)."""
    from ..operators.ingest import parse_date
    from pyspark.sql import types as T

    out = df
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            continue
        if f.name == M.AMOUNT:
            out = out.withColumn(f.name, F.expr(f"try_cast(`{f.name}` AS decimal(26,4))"))
        elif f.name in ("QTY", "QUANTITY", "RATE"):
            out = out.withColumn(f.name, F.expr(f"try_cast(`{f.name}` AS double)"))
        elif f.name == M.DATE:
            out = out.withColumn(f.name, parse_date(F.col(f.name)).cast("timestamp_ntz"))
    return out


def read_time_coercion(df: DataFrame) -> DataFrame:
    """A5: AMOUNT bad -> NULL -> 0; DATE bad -> NULL, time zone dropped;
    FINANCIAL_YEAR / MONTH derived when missing."""
    amt = M.col_ci(df, M.AMOUNT)
    if amt is not None:
        df = df.withColumn(amt, F.coalesce(F.expr(f"try_cast(`{amt}` AS decimal(26,4))"), F.lit(0).cast("decimal(26,4)")))
    d = M.col_ci(df, M.DATE)
    if d is not None:
        from pyspark.sql import types as T

        if isinstance(df.schema[d].dataType, T.StringType):
            from ..operators.ingest import parse_date

            df = df.withColumn(d, parse_date(F.col(d)))
        df = df.withColumn(d, F.col(d).cast("timestamp_ntz"))
        if M.FY not in df.columns:
            df = df.withColumn(M.FY, fy_label(F.col(d)))
        if M.MONTH not in df.columns:
            df = df.withColumn(M.MONTH, month_label(F.col(d)))
    return df


def scan(spark: SparkSession, path: str, tenant_id: str | None = None, start: str | None = None,
         end: str | None = None, max_years: int = 0, asof: str | None = None) -> DataFrame:
    """The stored fact for one tenant (partition filter), optionally a
    rolling N-year window and a date range; all filters reach the Parquet scan."""
    from ..sinks.writers import read_table

    df = read_table(spark, path)
    df = tenant(df, tenant_id)
    if max_years and asof:
        df = rolling_years(df, max_years, asof)
    df = read_time_coercion(df)
    return date_range(df, start, end)
