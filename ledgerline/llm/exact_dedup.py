"""Exact dedup (2): tree merge of sorted digest runs. DataFrame functions only.

Every input partition is a run: its distinct (digest, length, check hash) keys
sorted by digest, each with the smallest identifier and the count of its rows.
Runs then merge in rounds, ``fan_in`` neighbours at a time (run r goes to run
r // fan_in): equal keys of the merging runs meet in one exchange by (run,
key), the smallest identifier survives and counts add up. One run is left after
log_fan_in(runs) rounds. Equality of keys is verified at each level by the text
length and an independent 64-bit hash beside the SHA-256 digest.

The verdict walks back down the same tree: a run's key gets its verdict from
the one entry above it, so a key that owns a third of all rows is met by at
most ``fan_in`` entries per join group, and at the leaves by the copies inside
one input partition. No step gathers a group of copies in one task.

Rows: null text counts as empty; a null id sorts after every other id; of rows
that repeat the smallest id, the first in the input stays. An empty table gives
an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, stored, text_of

KEY = ["text_sha256", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Each run of the six blank characters becomes one space.

    A single space needs no change, so only longer runs and other blanks match.
    """
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def leaf_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One digest row per document: (run, __row, id, key)."""
    text = keyed_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")))
    text = text.select("id", "__row", normalised(F.col("t")).alias("t"))
    return text.select(
        F.spark_partition_id().alias("run"), "__row", "id",  # stored with the digests, so a run keeps its number
        F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"))


def _merged(entries: DataFrame, run: Column) -> DataFrame:
    """One sorted run per value of ``run``: the smallest identifier and the count of each key."""
    return (entries.groupBy(run.alias("run"), *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            .sortWithinPartitions("run", *KEY))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: (__row, id, text_sha256, keep_id, group_size, kept)."""
    leaves = stored(leaf_rows(docs, id_col, text_col), "digests")
    best = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("__row"))
    entries = leaves.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [stored(_merged(entries, F.col("run")), "run0")]
    top = levels[0].agg(F.max("run")).first()[0] or 0
    while top > 0:
        levels.append(stored(_merged(levels[-1], F.floor(F.col("run") / fan_in)), f"run{len(levels)}"))
        top //= fan_in
    verdict = levels[-1].select("run", *KEY, "best", "n")
    for lower in reversed(levels[:-1]):
        above = verdict.withColumnRenamed("run", "up")
        verdict = (lower.select("run", F.floor(F.col("run") / fan_in).alias("up"), *KEY)
                   .join(above, ["up", *KEY]).select("run", *KEY, "best", "n"))
    rows = leaves.join(verdict, ["run", *KEY])
    return rows.select(
        "__row", "id", "text_sha256", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best.__row") == F.col("__row")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("__row").alias("k"))
    rows = keyed_rows(docs.select(F.struct("*").alias("row")), "k")
    return rows.join(gone, "k", "left_anti").select("row.*")
