"""Plan building blocks shared by the report operators.

Everything here is lazy except ``materialize`` (and ``running_sum``, which
uses it): a written intermediate in the shared checkpoint folder.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M

def revenue(col: str = M.AMOUNT) -> Column:
    """Sum of money that is 0 (not NULL) over no rows, as pandas ``sum`` gives."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("double")


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """pandas ``groupby`` drops NULL keys; so do we, before grouping."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the columns of a 1-row aggregate to every row.

    The aggregate becomes one scalar subquery (``DataFrame.scalar()``) holding
    a struct of its columns: it runs once, its single value is substituted
    into the projection, and no join — broadcast or otherwise — is planned.
    """
    cols = total.columns
    packed = total.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__s")).scalar()
    return df.select(*[F.col(f"`{c}`") for c in df.columns], packed.alias("__s")).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("__s")[c].alias(c) for c in cols])


def top_k(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """Top-k: ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (per-partition
    heaps of n rows, then one merge of n x partitions rows)."""
    out = df.orderBy(*order)
    return out.limit(n) if n is not None else out


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used for entity-level tables that a plan needs more than once (edge
    estimation plus the main pass): the fact is aggregated once instead of
    once per use, and the lineage is cut, so a lost executor re-reads the
    written table rather than recomputing the fact aggregation.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TASK_ROWS = 500_000  # rows a task aims at


def tasks_for(spark: SparkSession, rows: int, per_task: int | None = None) -> int:
    """Tasks that so many rows ask for: the session's number of partitions, or more (it knows nothing of the input's size)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-rows // (per_task or TASK_ROWS)))


def running_sum(
    df: DataFrame,
    order_col: str,
    key_col: str,
    sum_col: str | None,
    out_col: str,
    descending: bool = True,
    partition_cols: tuple[str, ...] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Cumulative sum of ``sum_col`` (a running count if None) in the order
    (``order_col`` desc/asc, ``key_col`` asc), optionally restarting per
    ``partition_cols``, without a single-partition window.

    1. ``repartitionByRange`` on the full sort key (partition columns, value,
       key) cuts the rows into ``ranges`` contiguous ranges. The key is part of
       the range key, so a value shared by a third of the rows is still split
       across ranges — ties never pile up in one task.
    2. The ranged rows are written once (``materialize``): range i is file i
       from then on, so ``spark_partition_id()`` is a stable range number
       even if a stage is recomputed.
    3. Per (partition group, range) totals — at most groups + ranges rows —
       give each range its offset (the sum of earlier ranges of its group).
    4. A window per (group, range) adds the in-range running sum.
    """
    spark = df.sparkSession
    n = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    parts = list(partition_cols)
    v = F.col(order_col)
    ordv = v.desc_nulls_last() if descending else v.asc_nulls_last()
    order = [*(F.col(p).asc_nulls_first() for p in parts), ordv, F.col(key_col).asc_nulls_first()]
    amount = F.col(sum_col) if sum_col is not None else F.lit(1)
    ranged = materialize(df.withColumn("__amt", amount).repartitionByRange(n, *order).sortWithinPartitions(*order))
    b = ranged.withColumn("__rid", F.spark_partition_id())
    totals = b.groupBy(*parts, "__rid").agg(F.sum("__amt").alias("__rt"))
    wo = Window.partitionBy(*parts).orderBy("__rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__rt").over(wo), F.lit(0))).drop("__rt")
    if not parts:
        offsets = F.broadcast(offsets)  # at most ``n`` rows
    w = Window.partitionBy(*parts, "__rid").orderBy(*order[len(parts):]).rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(offsets, [*parts, "__rid"])
             .withColumn(out_col, F.sum("__amt").over(w) + F.col("__offset"))
             .drop("__rid", "__amt", "__offset"))


BINS = 1024  # histogram bins of a round of counting


def _integers(df: DataFrame, col: str) -> tuple[Column, int]:
    """An exact numeric column as whole numbers, and the decimal places moved."""
    kind = df.schema[col].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    if not isinstance(kind, (T.DecimalType, T.IntegralType)):
        raise TypeError(f"{col}: counting needs whole numbers or decimals, not {kind.simpleString()}")
    return (F.col(col) * F.lit(10**scale)).cast("decimal(38,0)"), scale


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[str, dict[int, tuple[Decimal, int]]]:
    """Exact order statistics by counting: for each column and each 0-based position among its non-null values, in rising
    order, the value there and how many values are smaller.

    Nothing is sorted and no column gathered. Each round counts, in one aggregation for all columns, the rows in
    ``BINS`` even bins of every interval that a wanted position still lies in; the bin that holds the position is the
    next interval, cut to its least and greatest value, until these are equal. Rounds grow with the logarithm of the
    values' range; the driver sees at most positions x BINS counts a round. ``df`` should be a written table.
    """
    columns = {c: _integers(df, c) for c in wanted}
    span = df.agg(*[f(v).alias(f"{c}{i}") for i, f in enumerate((F.min, F.max)) for c, (v, _) in columns.items()]).first()
    # (column, position) -> (low, high, number of values below low)
    left = {(c, p): (int(span[f"{c}0"]), int(span[f"{c}1"]), 0) for c, at in wanted.items() for p in at if span[f"{c}0"] is not None}
    found: dict[str, dict[int, tuple[Decimal, int]]] = {c: {} for c in wanted}
    while left:
        for (c, p), (low, high, below) in list(left.items()):
            if low == high:
                found[c][p] = (Decimal(low).scaleb(-columns[c][1]), below)
                del left[c, p]
        intervals = sorted({(c, low, high) for (c, _), (low, high, _) in left.items()})
        if not intervals:
            break
        cells = []
        for i, (c, low, high) in enumerate(intervals):
            v = columns[c][0]
            first, width = F.lit(Decimal(low)).cast("decimal(38,0)"), F.lit(Decimal(-(-(high - low + 1) // BINS))).cast("decimal(38,0)")
            inside = v.between(first, F.lit(Decimal(high)).cast("decimal(38,0)"))
            cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.floor((v - first) / width).cast("int").alias("b"), v.alias("v"))))
        counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.i", "x.b")
        bins: dict[int, list] = {}
        for r in counts.agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).collect():
            bins.setdefault(r["i"], []).append((int(r["low"]), int(r["high"]), r["n"]))
        for (c, p), (low, high, below) in list(left.items()):
            for bin_low, bin_high, n in sorted(bins[intervals.index((c, low, high))]):
                if p < below + n:
                    left[c, p] = (bin_low, bin_high, below)
                    break
                below += n
    return found


def text_statistics(df: DataFrame, col: str, wanted: dict[int, tuple[Column, int]]) -> dict[int, str]:
    """For each key the text at a 0-based position, in the order of bytes, among the rows of a condition; texts there are distinct.

    Counted like ``order_statistics``, by the two bytes after the prefix that all remaining texts share.
    """
    raw = F.col(col).cast("binary")
    found: dict[int, str] = {}
    left = {k: (b"", position) for k, (_, position) in wanted.items()}
    while left:
        cells = [F.when(wanted[k][0] & F.col(col).cast("binary").substr(1, len(prefix)).eqNullSafe(F.lit(bytearray(prefix))) if prefix else wanted[k][0],
                        F.struct(F.lit(k).alias("k"), F.hex(F.substring(raw, len(prefix) + 1, 2)).alias("b"), F.col(col).alias("v")))
                 for k, (prefix, _) in left.items()]
        counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.k", "x.b")
        bins: dict[int, list] = {}
        for r in counts.agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).collect():
            bins.setdefault(r["k"], []).append((r["b"], r["n"], r["low"], r["high"]))
        for k, (prefix, position) in list(left.items()):
            for _, n, low, high in sorted(bins[k]):
                if position < n:
                    if low == high:
                        found[k] = low
                        del left[k]
                    else:
                        left[k] = (os.path.commonprefix([low.encode(), high.encode()]), position)
                    break
                position -= n
    return found


def iso_date(c) -> Column:
    """Dates leave the engine as ISO text, as the reference's JSON does."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def year_month(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM")
