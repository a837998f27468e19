"""Benchmark decontamination (5) by winnowing. DataFrame functions only.

A text is a list of words; a benchmark item stands for its windows of
``window`` (10) consecutive words, an item of fewer words for one window of all
of them. Of the hashes of all ``gram``-word (5) sequences, the smallest in each
run of ``window - gram + 1`` neighbours is kept as a fingerprint. Two texts that
share ``window`` words share such a run, hence its smallest hash: every shared
span of that length is found. Items shorter than a window are fingerprinted by
their one sequence (a run of one hash), looked up among all document sequences
of that length.

Fingerprints of documents and items are joined; each hit is then extended: the
windows around it are compared word by word with the windows of the items, so a
hash collision never counts. Hits are stored once; the texts read again are
those of documents with a hit. The benchmark side and the hit list are
broadcast only up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, counted; else joins shuffle.

Rows: null text has no words, an item without words no window; repeated
document rows each get their result (rows are told apart by position, ids may
repeat or be null); an item's id counts once, a null item id marks words but is
not listed. Empty tables give no hits. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, stored, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, letters as they are."""
    return F.array_remove(F.split(text_of(text), NO_WORD), "")


def folded_words(text: Column) -> Column:
    """The words with A-Z in lower case."""
    return words_of(F.translate(text, UPPER, LOWER))


def word_hashes(words: Column) -> Column:
    """A hash per word that ignores case (also beyond A-Z: more hits, never fewer)."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _each(first: Column | int, last: Column, made: Callable) -> Column:
    """``made(i)`` for i from ``first`` to ``last``; empty if last < first."""
    none = F.filter(F.transform(F.sequence(F.lit(0), F.lit(0)), made), lambda _: F.lit(False))
    return F.when(last >= first, F.transform(F.sequence(F.lit(first) if isinstance(first, int) else first, last), made)).otherwise(none)


def gram_hashes(hashes: Column, k: int) -> Column:
    return _each(0, F.size(hashes) - k, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def span(start: Column, n: int) -> Column:
    """``n`` words of column ``words``, read one by one (``slice`` copies the whole array each time)."""
    return F.concat_ws(" ", *[F.get(F.col("words"), start + j) for j in range(n)])


def _span_of(n: int) -> Callable:
    return lambda start: span(start, n)


def winnowed(grams: Column, run: int) -> Column:
    """The smallest hash of every ``run`` neighbours."""
    if run == 1:
        return F.array_distinct(grams)
    return F.array_distinct(_each(0, F.size(grams) - run, lambda i: F.least(*[F.get(grams, i + j) for j in range(run)])))


def bounded(df: DataFrame, held: Column) -> DataFrame:
    """``df`` (stored) with a broadcast hint if its rows and the bytes ``held`` in each are counted to be few."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


# explode_outer: for explode Spark adds a filter on the array and pushes it below the projections that build the
# array, so that the hashes would be computed anew for each element. Its null rows fall out of the inner joins.


def _with_grams(rows: DataFrame, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with column ``words`` plus one column of gram hashes per gram length (each its own projection)."""
    rows = rows.withColumn("__h", word_hashes(F.col("words")))
    return rows.withColumns({f"__g{k}": gram_hashes(F.col("__h"), k) for k in dict.fromkeys(k for _, k, _ in sizes)}).drop("__h")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """One row per document row: (__row, id, n_words, n_hit, items), ``items`` the sorted ids of the items found."""
    items = stored(benchmark.select(F.col(item_col).alias("item"), folded_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0), "items")
    short = [r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]  # at most window - 1 rows
    # (words in a window, words in a gram, neighbours in a run)
    sizes = [(window, gram, window - gram + 1), *((n, n, 1) for n in short)]

    def of_size(n: int) -> Column:
        return F.size("words") >= window if n == window else F.size("words") == n

    grams = _with_grams(items, sizes)
    prints, wins = None, None
    for n, k, run in sizes:
        p = grams.where(of_size(n)).select(F.explode_outer(winnowed(F.col(f"__g{k}"), run)).alias("print"))
        w = items.where(of_size(n)).select("item", F.explode_outer(_each(0, F.size("words") - n, _span_of(n))).alias("window"))
        prints, wins = (p, w) if prints is None else (prints.union(p), wins.union(w))
    prints, wins = stored(prints.distinct(), "prints"), stored(wins.distinct(), "windows")

    keyed = keyed_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    found = _with_grams(keyed.select("__row", words_of(F.col("text")).alias("words")), sizes)
    found = found.select("__row", F.array_distinct(F.concat(*[winnowed(F.col(f"__g{k}"), run) for _, k, run in sizes])).alias("p"))
    hits = found.select("__row", F.explode_outer("p").alias("print")).join(bounded(prints, F.lit(8)), "print", "left_semi")
    hits = stored(hits.groupBy("__row").agg(F.collect_set("print").alias("prints")), "hits")

    near = keyed.join(bounded(hits, 8 + 8 * F.size("prints")), "__row").select("__row", "prints", folded_words(F.col("text")).alias("words"))
    near = _with_grams(near, sizes)

    def around(n: int, k: int) -> Column:
        """The windows of n words that hold a hit: (start, n, the words)."""
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(f"__g{k}") - 1, F.lit(0))), lambda i: F.array_contains("prints", F.get(F.col(f"__g{k}"), i)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: _each(F.greatest(p - (n - k), F.lit(0)), F.least(p, F.size("words") - n), lambda s: s))))
        return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), span(s, n).alias("window")))

    spans = near.select("__row", F.explode_outer(F.concat(*[around(n, k) for n, k, _ in sizes])).alias("w")).select("__row", "w.*")
    spans = spans.join(bounded(wins, F.octet_length("window")), "window")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "n"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, w: F.struct(F.greatest(a["end"], w["s"] + w["n"]).alias("end"),
                              (a["hit"] + F.greatest(w["s"] + w["n"] - F.greatest(a["end"], w["s"]), F.lit(0))).alias("hit")),
        lambda a: a["hit"])
    marks = spans.groupBy("__row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    every = keyed.select("__row", "id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return every.join(marks, "__row", "left").select(
        "__row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns."""
    hit = contamination(docs, benchmark).where("n_hit > 0").select(F.col("__row").alias("k"))
    rows = keyed_rows(docs.select(F.struct("*").alias("row")), "k")
    return rows.join(hit, "k", "left_anti").select("row.*")
