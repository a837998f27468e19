"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


BROADCAST_FILES = 200_000
ADDRESS = "^([A-Za-z][A-Za-z0-9+.-]*):/+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the table, not of the
    work that made it, and every later use sees the same rows in the same place.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain_path(path: str) -> str:
    """A file address with one slash after its scheme (Spark writes both ``file:/x`` and ``file:///x``)."""
    return re.sub(ADDRESS, r"\1:/", path)


def keyed_rows(docs: DataFrame, name: str = "__row") -> DataFrame:
    """Add a row key that tells apart rows with equal, repeated or null ids.

    The key is the row's place in the input: the number of its file in the order
    of paths, and its position in that file. It rests on the files alone, so
    every scan gives a row the same key, however the files are split and
    however many executors there are. ``docs`` must be read from Parquet files
    (or be a ``stored`` table), with no more than projections and filters after.

    The file numbers are broadcast up to ``BROADCAST_FILES`` files.
    """
    paths = sorted({_plain_path(f) for f in docs.inputFiles()})
    if not paths:  # no files, no rows
        return docs.select("*", F.lit(None).cast("long").alias(name))
    place = docs.metadataColumn("_metadata")
    files = docs.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias("__file", "__path"))
    rows = docs.select("*", F.regexp_replace(place["file_path"], ADDRESS, "$1:/").alias("__path"), place["row_index"].alias("__at"))
    rows = rows.join(F.broadcast(files) if len(paths) <= BROADCAST_FILES else files, "__path", "left")
    number = F.coalesce(F.col("__file"), F.raise_error(F.concat(F.lit("no such input file: "), F.col("__path"))).cast("int"))
    return rows.withColumn(name, F.shiftleft(number.cast("long"), 33) + F.col("__at")).drop("__path", "__file", "__at")


def text_of(col: str | Column = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batch, text_col: str, chars: int = 1_000_000) -> Iterator:
    """An Arrow batch in parts of about ``chars`` bytes of text, so that a task's memory follows the longest text only."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + chars, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def released(run: Callable) -> Callable:
    """``run`` over a partition's batches, giving freed memory back to the system at its end.

    Python workers stay for later tasks; without this, an idle worker keeps the
    largest task's memory from the executor.
    """

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return wrapped
