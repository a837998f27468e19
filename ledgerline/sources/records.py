"""Records of quoted CSV files, split in parallel.

A quoted value may hold line breaks, so where a record ends depends on all
quotes before it, and Spark's multi-line reader gives a file to one task. Here
any number of tasks reads a file:

1. Physical lines are read by blocks (Spark's text source) and written once,
   each with its place: block, and position in it. Of each line two facts are
   kept: does it end inside quotes if it starts outside of them, and if it
   starts inside. They are a function on two states.
2. Functions compose. Lines lie in chunks of at most ``CHUNK`` in a row; two
   aggregations tell the function of each chunk: its last constant line, and the
   swaps after it. The functions of chunks, a row each, are composed along the
   file and say in which state a chunk starts. No text is shuffled here.
3. A chunk that starts outside quotes and opens none holds a record a line. Lines
   of the other chunks are dealt by chunk, once; windows in a chunk give the
   state at every line, and lines of one record are put together there. Records
   that go on in later chunks, at most one a chunk, are joined by file.

The header is the first record of a file; it is found by the same pass, so no
file is opened by the driver. The result is a stored table; the lines are
removed when the records of several lines have been stored, and shuffle files
with each write.

Joins are left to Spark, which broadcasts a stored table by its size; chunks are
broadcast up to ``BROADCAST_CHUNKS`` of them.

Line breaks are ``\\n`` or, where a file's first line ends so, ``\\r\\n`` (also
inside values, where they become ``\\n``). Empty records are skipped. As in Spark's own reader a quote
opens a value only at its start, quotes inside are doubled, and what follows a
closing quote belongs to the value up to the next comma.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_folder, shared_dir, shuffles_go

QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # an opened value up to its end or the end of the line
CLOSED = QUOTED + r'"[^,]*+'
FIELD = rf'(?:{CLOSED}|(?!")[^,]*+)'
# a line that starts outside quotes and ends inside them: whole fields, then an open one
OPENS = rf"(?s)(?:{FIELD},)*+{QUOTED}"
# the same for a line that starts inside quotes; a line without a closing quote stays inside
STAYS = rf'(?s)[^"]*+(?:""[^"]*+)*+(?:"[^,]*+,(?:{FIELD},)*+{QUOTED})?'


CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS  # lines in a row that are put together in one place
BROADCAST_CHUNKS = 100_000


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _after(known: Column, parity: Column, start: Column) -> Column:
    """The state (inside quotes?) after lines whose last constant function gave ``known`` (null: none), and that swapped states ``parity`` times since."""
    return F.coalesce(known, start).cast("int").bitwiseXOR(parity) == 1


def _composed(rows: DataFrame, window) -> DataFrame:
    """``rows`` (from_out, from_in) with ``known`` and ``parity``: the function of all rows of the window up to each one."""
    swap = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    rows = rows.withColumn("__swaps", F.sum(swap).over(window))
    constant = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("v"), F.col("__swaps").alias("s")))
    rows = rows.withColumn("__last", F.last(constant, ignorenulls=True).over(window))
    parity = (F.col("__swaps") - F.coalesce(F.col("__last.s"), F.lit(0))) % 2
    return rows.withColumns({"known": F.col("__last.v"), "parity": parity.cast("int")}).drop("__swaps", "__last")


def _chunks(lines: DataFrame, folder: str) -> DataFrame:
    """(run, chunk, starts_in, plain) of each chunk of lines: does it start inside quotes, and is each of its lines a record?"""
    # the last constant line, as twice its place and its value
    last = F.max(F.when(F.col("from_out") == F.col("from_in"), F.col("at") * 2 + F.col("from_out").cast("int")))
    constants = _stored(lines.groupBy("path", "block", "run", "chunk").agg(last.alias("last"), F.bool_or("from_out").alias("opens")), folder, "constants")
    few = constants.count() <= BROADCAST_CHUNKS
    swaps = lines.where("from_out AND NOT from_in").select("run", "chunk", "at")
    bounds = constants.select("run", "chunk", "last")
    swaps = swaps.join(F.broadcast(bounds) if few else bounds, ["run", "chunk"]).where("last IS NULL OR at > shiftright(last, 1)")
    swaps = swaps.groupBy("run", "chunk").agg((F.count(F.lit(1)) % 2).cast("int").alias("swapped"))
    chunks = constants.join(swaps, ["run", "chunk"], "left").withColumn("swapped", F.coalesce("swapped", F.lit(0)))
    constant = F.col("last").bitwiseAND(F.lit(1)).cast("int").bitwiseXOR(F.col("swapped")) == 1
    chunks = chunks.withColumns({"from_out": F.coalesce(constant, F.col("swapped") == 1), "from_in": F.coalesce(constant, F.col("swapped") == 0)})
    along = Window.partitionBy("path").orderBy("block", "chunk")  # a row per chunk of a file
    chunks = _composed(chunks, along.rowsBetween(Window.unboundedPreceding, 0))
    starts_in = F.coalesce(F.lag(_after(F.col("known"), F.col("parity"), F.lit(False))).over(along), F.lit(False))
    chunks = chunks.withColumn("starts_in", starts_in)
    return _stored(chunks.select("run", "chunk", "starts_in", (~F.col("starts_in") & ~F.col("opens")).alias("plain")), folder, "chunks")


def _joined_lines(lines: DataFrame, folder: str) -> DataFrame:
    """(path, block, at, lines): the lines of each record, whose place is that of its first line."""
    lines = lines.withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    chunks = _chunks(lines, folder)
    many, odd = chunks.agg(F.count(F.lit(1)), F.count_if(~F.col("plain"))).first()
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")), -(-odd // 2))
    lines = lines.join(F.broadcast(chunks) if many <= BROADCAST_CHUNKS else chunks, ["run", "chunk"])
    plain = lines.where("plain").select("path", "block", "at", F.array("line").alias("lines"), F.lit(True).alias("whole"), F.lit(True).alias("headed"))

    inside = Window.partitionBy("run", "chunk").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    parts = _composed(lines.where(~F.col("plain")).drop("plain").repartition(tasks, "run", "chunk"), upto)
    parts = parts.withColumn("ends_in", _after(F.col("known"), F.col("parity"), F.col("starts_in")))
    parts = parts.withColumn("starts_in", F.coalesce(F.lag("ends_in").over(inside), F.col("starts_in")))
    parts = parts.withColumn("head", F.last(F.when(~F.col("starts_in"), F.col("at")), ignorenulls=True).over(upto))
    # lines without a head go on from an earlier chunk; if the last one ends inside quotes, a later chunk goes on
    parts = parts.groupBy("run", "chunk", "path", "block", "head").agg(F.array_sort(F.collect_list(F.struct("at", "line", "ends_in"))).alias("l"))
    parts = parts.select("path", "block", F.get("l", 0)["at"].alias("at"), F.transform("l", lambda x: x["line"]).alias("lines"),
                         (~F.element_at("l", -1)["ends_in"]).alias("whole"), F.col("head").isNotNull().alias("headed"))
    pieces = _stored(plain.unionByName(parts), folder, "pieces")
    drop_folder(lines.sparkSession, f"{folder}/lines")

    along = Window.partitionBy("path").orderBy("block", "at")  # at most two pieces a chunk
    split = pieces.where("NOT (whole AND headed)")
    split = split.withColumn("head", F.last(F.when(F.col("headed"), F.struct("block", "at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    split = split.groupBy("path", "head").agg(F.array_sort(F.collect_list(F.struct("block", "at", "lines"))).alias("l"))
    split = split.select("path", "head.block", "head.at", F.flatten(F.transform("l", lambda x: x["lines"])).alias("lines"))
    split = _stored(split, folder, "split")
    return pieces.where("whole AND headed").select("path", "block", "at", "lines").unionByName(split)


def _address(spark: SparkSession, path: str) -> str:
    """The path as Spark lists it."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:/(?!/)", path):
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_records(spark: SparkSession, files: list[str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, header, record) of the records after each file's header, and (path, header) of each file, null for one without a header.

    Both rest on stored tables in ``folder``, one of the shared folder unless given. The paths of records are encoded, as Spark gives them.
    """
    import uuid

    folder = folder or shared_dir(spark, f"records-{uuid.uuid4().hex}")
    text = spark.read.option("lineSep", "\n").text(files)
    place = text.metadataColumn("_metadata")
    lines = text.select(place["file_path"].alias("path"), place["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # the task's number in ``at`` and the block name a run of lines in order; places are stored, so they stay what they are
    quoted = F.contains("line", F.lit('"'))
    lines = lines.withColumns({
        "run": F.xxhash64("path", "block", F.shiftright("at", 33)),
        "from_out": quoted & F.regexp_like("line", F.lit(_whole(OPENS))), "from_in": ~quoted | F.regexp_like("line", F.lit(_whole(STAYS)))})
    lines = _stored(lines, folder, "lines")

    if lines.where("from_out").isEmpty():  # no value goes on in the next line: every line starts outside quotes
        every = lines.select("path", "block", "at", F.array("line").alias("lines"))
    else:
        every = _joined_lines(lines, folder)
    begin = every.where("block = 0")  # a file's first record starts in its first block
    heads = begin.join(F.broadcast(begin.groupBy("path").agg(F.min("at").alias("at"))), ["path", "at"])  # a row per file
    returns = F.element_at("lines", -1).endswith("\r")

    def text_of(crlf: Column) -> Column:
        bare = F.transform("lines", lambda x: F.when(crlf & x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))
        return F.array_join(bare, "\n")

    heads = heads.select("path", F.col("at").alias("head"), returns.alias("crlf"), F.regexp_replace(text_of(returns), "^\ufeff", "").alias("header"))
    heads = _stored(heads, folder, "headers")
    rows = every.join(heads, "path").where("at <> head").select("path", "header", text_of(F.col("crlf")).alias("record"))
    listed = spark.read.format("binaryFile").load(files)  # names only: contents are not selected
    listed = listed.select(F.col("path").alias("file"), listed.metadataColumn("_metadata")["file_path"].alias("path"))
    named = listed.join(heads, "path", "left").select("file", F.when(F.trim("header") != "", F.col("header")).alias("header"))
    # Spark lists no file of length 0
    named = spark.createDataFrame([(_address(spark, f),) for f in files], "file string").join(named, "file", "left").withColumnRenamed("file", "path")
    return rows.where("record <> '' AND trim(header) <> ''"), named
