"""Line dedup (3): suffix groups over line-ID sequences by distributed prefix doubling.

Every line gets an ID (equal lines, equal IDs); a suffix starts at each line of
each text and ends with its text. Prefix doubling names the suffixes by their
first 1, 2, 4, ... lines: the name for 2w lines is that of the pair (name for w
lines here, name for w lines w further on), and of a group of equal pairs the
first suffix gives the name. The suffixes under one name are an interval of the
suffix array whose common prefix has at least that many lines; a group of one
leaves, since it is in no longer interval either.

A repeated run is a copy if all of it, taken together, has at least
``min_lines`` lines and ``min_chars`` characters, however short its lines are;
runs of blank lines alone have none. Of a run that is later than an equal one in
the order of (id, place), every line is deleted. Such a run is the union of the
spans in it that reach both bounds and no longer do without their last line, or
without their first: of each line the shortest span from it and the shortest
span up to it. So two spans a line are looked at, and doubling goes on as long
as spans have lines; a span of w to 2w - 1 lines is named by the two names for
w lines that cover it. Names inside no span are dropped on the way.

Each round is two shuffles of the suffixes still in a group: a join on (row,
line number) and one on the pair of names, whose groups are stored sums before,
so that adaptive execution can split a pair that a third of all rows share.

Rows: null and empty texts have one empty line; repeated rows are copies like
any others; a null id sorts after all ids, then the place in the input decides.
An empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_rows, stored, text_of

BROADCAST_ROWS, BROADCAST_LINES = 200_000, 2_000_000  # rows, and numbers of lines in all of them


def _firsts(rows: DataFrame, *key: str) -> DataFrame:
    """Of each ``key`` that occurs more than once, ``made``: the ``g`` of the first row."""
    groups = rows.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull(), "id", "g")).alias("first"), F.count("*").alias("times"))
    return stored(groups.where("times > 1").select(*key, F.col("first.g").alias("made")), "groups")


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose ``key`` occurs more than once, with ``name``: the ``g`` of the first of them."""
    return stored(rows.join(_firsts(rows, *key), list(key)).select("row", "pos", "id", "g", "inner", "last", F.col("made").alias("name")), "names")


def _wider(names: DataFrame, width: int, min_lines: int, min_chars: int) -> DataFrame:
    """Names for 2 * ``width`` lines from names for ``width`` lines, as far as they can be inside a span."""
    further = names.select("row", (F.col("pos") - width).alias("pos"), F.col("name").alias("right"), F.col("last").alias("end"))
    pairs = names.withColumnRenamed("name", "left").join(further, ["row", "pos"])
    if 2 * width - 2 >= min_lines:
        pairs = pairs.where(F.col("end") - F.col("inner") < min_chars)
    return _named(pairs.withColumn("last", F.col("end")), "left", "right")


def _copies(names: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(row, start, n): the spans of ``width`` to 2 * ``width`` - 1 lines that are later copies."""
    exact = names.where("name <> g").select("row", F.col("pos").alias("start"))
    exact = spans.where(F.col("n") == width).join(exact, ["row", "start"]).select("row", "start", "n")
    if width == 1:
        return exact
    left = names.select("row", F.col("pos").alias("start"), "id", "g", F.col("name").alias("left"))
    right = names.select("row", F.col("pos").alias("at"), F.col("name").alias("right"))
    both = spans.where((F.col("n") > width) & (F.col("n") < 2 * width)).join(left, ["row", "start"])
    both = stored(both.withColumn("at", F.col("start") + F.col("n") - width).join(right, ["row", "at"]).drop("at"), "spans")
    key = ["n", "left", "right"]
    return exact.unionByName(both.join(_firsts(both, *key), key).where("made <> g").select("row", "start", "n"))


def _lines(keyed: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """A row for each line and one for the end of each text: ``till`` ends the shortest span from here, ``since`` starts the one up to here."""
    split = F.split("text", "\n")
    lines = keyed.select("row", "id", F.size(split).alias("size"), F.posexplode(F.concat(split, F.array(F.lit(None).cast("string")))).alias("pos", "line"))
    lines = lines.select(
        "row", "id", "size", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"),
        F.coalesce(F.char_length("line"), F.lit(0)).alias("chars"), F.monotonically_increasing_id().alias("g"))
    text, low, here = Window.partitionBy("row"), Window.unboundedPreceding, F.col("pos")
    lines = lines.withColumn("last", F.coalesce(F.sum("chars").over(text.orderBy("pos").rowsBetween(low, -1)), F.lit(0)).cast("long"))
    enough = F.min("pos").over(text.orderBy(F.desc("last")).rangeBetween(low, -min_chars))
    since = F.max("pos").over(text.orderBy("last").rangeBetween(low, -min_chars))
    lines = lines.withColumns({"till": enough, "since": since})
    # greatest and least skip nulls: without enough characters there is no span
    till = F.when(F.col("till").isNotNull(), F.greatest("till", here + min_lines))
    since = F.when(F.col("since").isNotNull(), F.least("since", here - min_lines))
    return stored(lines.withColumns({
        "till": F.when(till <= F.col("size"), till), "since": F.when(since >= 0, since), "inner": F.col("last") + F.col("chars")}), "lines")


def copied_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int = 30) -> DataFrame:
    """(row, gone): for each row with later copies of repeated runs, the numbers of the lines to delete, sorted."""
    keyed = keyed_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "row")
    lines = _lines(keyed, min_lines, min_chars)
    spans = lines.where("till IS NOT NULL").select("row", F.col("pos").alias("start"), (F.col("till") - F.col("pos")).alias("n"))
    # the shortest span of min_lines lines is the same from both ends
    back = lines.where(F.col("pos") - F.col("since") > min_lines).select("row", F.col("since").alias("start"), (F.col("pos") - F.col("since")).alias("n"))
    spans = spans.unionByName(back)
    longest = spans.agg(F.max("n")).first()[0] or 0
    names, width, found = _named(lines.where(F.col("pos") < F.col("size")), "h1", "h2", "chars"), 1, []
    while True:
        if 2 * width > min_lines:
            found.append(_copies(names, spans, width))
        if 2 * width > longest or names.isEmpty():
            break
        names, width = _wider(names, width, min_lines, min_chars), 2 * width
    copies = reduce(DataFrame.unionByName, found) if found else spans.limit(0)
    ends = copies.groupBy("row", "start").agg((F.col("start") + F.max("n")).alias("end"))
    done = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("row", F.greatest("start", done).alias("start"), "end").where("start < end")
    cover = ends.select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    return cover.groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int = 30) -> DataFrame:
    """One row per input row: (row, id, text, n_lines, gone), ``text`` without the deleted lines, ``gone`` their numbers."""
    gone = stored(copied_lines(docs, id_col, text_col, min_lines, min_chars), "gone")
    keyed = keyed_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "row")
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and numbers <= BROADCAST_LINES
    out = keyed.join(F.broadcast(gone) if few else gone, "row", "left")
    out = out.select("row", "id", "gone", "text", F.split("text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select("row", "id", text.alias("text"), F.size("lines").alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
