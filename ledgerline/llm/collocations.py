"""Phrase collocation mining (13) with weighted acyclic automata.

A word's label is a 64-bit hash of its bytes. Every word of a piece starts a
window of up to three labels (0 after the piece's end); the count of a phrase
is the weight of the windows that it is a prefix of.

1. ``count_words``: per language each word, its label and its count. Two words
   of one label, which the table shows, restart the work with another seed, so
   labels stand for words exactly.
2. ``shard_transducers``: a shard (some millions of words of a task) sorts and
   counts its windows and builds from them, in order, one acyclic count
   transducer per prefix range: a state per distinct prefix, labelled edges,
   weights at the last ones. Ranges cut the order of a hash of the first two
   labels, so a first word of a third of all text is in all ranges; there is
   about one range for each ``RANGE_WORDS`` words.
3. ``phrase_counts``: the transducers of a range meet in one task, which
   unites them and sums weights; states of enough weight are the phrases.
4. ``collocations``: a cut of a phrase asks for the weights of both parts; the
   phrase table is composed with itself and the words by joins on labels (parts
   are at least as frequent as the phrase, so no part is missing). Scores are
   integers in exact decimals.

Rows: null text counts as empty, a null language as ``und``; repeated rows count
each time; ids are not read, so they may repeat or be null. An empty table gives
no phrases. Only the text and the language column are read. A task holds a shard
and the longest text; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, slices, stored

SHARD_WORDS = 2_000_000
RANGE_WORDS = 2_000_000
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class Transducer:
    """Acyclic count transducer over windows of three labels.

    ``first``, ``second`` and ``third`` hold the labels of the edges of each level in order, ``fan1`` and ``fan2`` the
    numbers of edges that leave the states of the first two, ``weight`` the counts on the last.
    """

    first: object
    fan1: object
    second: object
    fan2: object
    third: object
    weight: object

    PARTS = (("first", "<u8"), ("fan1", "<u4"), ("second", "<u8"), ("fan2", "<u4"), ("third", "<u8"), ("weight", "<u8"))

    @staticmethod
    def of_sorted(a, b, c, weight) -> Transducer:
        """From distinct windows in order: a state begins wherever the prefix changes."""
        import numpy as np

        new1 = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        new2 = new1 | np.concatenate([[True], b[1:] != b[:-1]])[: len(a)]
        at1, at2 = np.flatnonzero(new1), np.flatnonzero(new2)
        fan1 = np.diff(np.concatenate([np.searchsorted(at2, at1), [len(at2)]]))
        fan2 = np.diff(np.concatenate([at2, [len(a)]]))
        return Transducer(a[at1], fan1, b[at2], fan2, c, weight)

    def windows(self):
        """The windows and their weights, in order."""
        import numpy as np

        second = np.repeat(self.first, self.fan1)
        return np.repeat(second, self.fan2), np.repeat(self.second, self.fan2), self.third, self.weight

    @staticmethod
    def union(parts: list[Transducer]) -> Transducer:
        """The windows of all parts, the weights of equal ones summed."""
        import numpy as np

        a, b, c, w = (np.concatenate(x) for x in zip(*(p.windows() for p in parts)))
        order = np.lexsort((c, b, a))
        a, b, c, w = a[order], b[order], c[order], w[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])[: len(a)]
        at = np.flatnonzero(new)
        return Transducer.of_sorted(a[at], b[at], c[at], np.add.reduceat(w, at) if len(at) else w)

    def pairs(self):
        """The prefixes of two labels and their weights: the sums below their states."""
        import numpy as np

        starts = np.cumsum(self.fan2) - self.fan2
        return np.repeat(self.first, self.fan1), self.second, np.add.reduceat(self.weight, starts) if len(starts) else self.weight

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(kind).tobytes() for k, kind in self.PARTS}

    @staticmethod
    def unpacked(row: dict[str, bytes]) -> Transducer:
        import numpy as np

        return Transducer(*(np.frombuffer(row[k], kind) for k, kind in Transducer.PARTS))


def _text_words(column, seed: int):
    """(bytes, begin, end, piece, label, check, row) of the words of an Arrow text column, A-Z folded."""
    import numpy as np

    from .shingles import mix, span_hashes, text_bytes

    data, starts = text_bytes(column)
    fold = np.arange(256, dtype="u1")
    fold[65:91] += 32
    kind = np.zeros(256, "u1")
    kind[[9, 32]] = 1
    kind[[*range(10, 14), *b".,;:!?"]] = 2
    data, kind = fold[data], kind[data]
    kind[starts[1:] - 1] = 2  # the separator after each text
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    piece = np.cumsum(kind == 2)[begin] if len(begin) else begin
    with np.errstate(over="ignore"):
        label = span_hashes(mix(np.arange(256, dtype="u8") + np.uint64(1 + 1000 * seed))[data], begin, end)
        check = span_hashes(mix(np.arange(256, dtype="u8") + np.uint64(501 + 1000 * seed))[data], begin, end)
    label[label == 0] = 1
    return data, begin, end, piece, label, check, np.searchsorted(starts, begin, "right") - 1


class _Shard:
    """Words of a task until there are enough for a flush: (language, piece, label, check) and where their bytes are."""

    def __init__(self):
        self.parts, self.held, self.bytes, self.pieces, self.langs = [], 0, 0, 0, {}

    def add(self, texts, langs: list[str], seed: int) -> None:
        import numpy as np

        data, begin, end, piece, label, check, row = _text_words(texts, seed)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], "i4")
        self.parts.append((data, begin + self.bytes, end + self.bytes, piece + self.pieces, label, check, lang[row]))
        self.held, self.bytes, self.pieces = self.held + len(begin), self.bytes + len(data), self.pieces + int(piece[-1] if len(piece) else 0) + 1

    def take(self):
        """(language name, data, begin, end, piece, label, check) for each language, and start anew."""
        import numpy as np

        if not self.parts:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        names, data, lang = list(self.langs), columns[0], columns[6]
        for i, name in enumerate(names):
            own = np.flatnonzero(lang == i) if len(names) > 1 else slice(None)
            yield name, data, *(x[own] for x in columns[1:6])
        self.__init__()


def _shards(rows: DataFrame, emit, schema: str, seed: int) -> DataFrame:
    """``emit`` (a generator of record batches) over the shards of each task."""

    def run(batches: Iterator) -> Iterator:
        shard = _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                shard.add(part.column("text"), part.column("lang").to_pylist(), seed)
                if shard.held >= SHARD_WORDS or shard.bytes >= 16 * SHARD_WORDS:
                    for own in shard.take():
                        yield from emit(*own)
        for own in shard.take():
            yield from emit(*own)

    return rows.mapInArrow(released(run), schema)


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, label, word, n); a null word stands for words of one label."""

    def emit(lang, data, begin, end, piece, label, check) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found, first, which, n = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        clash = np.zeros(len(found), bool)
        clash[which[check[first][which] != check]] = True
        size = (end - begin)[first]
        ends = np.cumsum(size)
        spot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[first] - (ends - size), size)
        words = pa.Array.from_buffers(pa.large_string(), len(found), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("i8")), pa.py_buffer(data[spot])]).cast(pa.string())
        words = pa.compute.if_else(pa.array(clash), pa.scalar(None, pa.string()), words)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view("i8")), words, pa.array(n.astype("i8"))], names=["lang", "label", "word", "n"])

    return _shards(rows, emit, "lang string, label long, word string, n long", seed).groupBy("lang", "label", "word").agg(F.sum("n").alias("n"))


def shard_transducers(rows: DataFrame, seed: int, ranges: int) -> DataFrame:
    """(lang, range, the parts of a transducer): one for each shard, language and prefix range."""

    def emit(lang, data, begin, end, piece, label, check) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix

        if not len(label):
            return
        labels, rank = np.unique(label, return_inverse=True)
        labels, rank = np.concatenate([np.zeros(1, "u8"), labels]), rank.astype("u8") + np.uint64(1)
        second, third = np.zeros(len(rank), "u8"), np.zeros(len(rank), "u8")
        one, two = piece[1:] == piece[:-1], piece[2:] == piece[:-2]
        second[:-1][one], third[:-2][two] = rank[1:][one], rank[2:][two]
        if len(labels) < 1 << 21:  # three ranks in one number
            windows, weight = np.unique(rank << np.uint64(42) | second << np.uint64(21) | third, return_counts=True)
            a, b, c = (labels[(windows >> np.uint64(s)) & np.uint64((1 << 21) - 1)] for s in (42, 21, 0))
        else:
            t = Transducer.union([Transducer.of_sorted(*(labels[x] for x in (rank, second, third)), np.ones(len(rank), "u8"))])
            a, b, c, weight = t.windows()
        with np.errstate(over="ignore"):
            own = ((mix(a ^ mix(b)) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(ranges + 1))
        made = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[r]:cuts[r + 1]]
            made.append({"lang": lang, "range": r, **Transducer.of_sorted(a[at], b[at], c[at], weight[at]).packed()})
        kinds = [("lang", pa.string()), ("range", pa.int32()), *((k, pa.binary()) for k, _ in Transducer.PARTS)]
        for i in range(0, len(made), 64):
            yield pa.RecordBatch.from_pylist(made[i:i + 64], pa.schema(kinds))

    parts = ", ".join(f"{k} binary" for k, _ in Transducer.PARTS)
    return _shards(rows, emit, f"lang string, range int, {parts}", seed)


def phrase_counts(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """(lang, a, b, c, n): the phrases of two labels (c null) and of three that occur at least ``least`` times."""

    def united(lang: str, parts: list) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = Transducer.union(parts)
        a, b, n = t.pairs()
        two = (n >= least) & (b != 0)
        x, y, z, w = t.windows()
        three = (w >= least) & (z != 0)
        third = np.concatenate([np.zeros(int(two.sum()), "u8"), z[three]])
        columns = [np.concatenate([a[two], x[three]]), np.concatenate([b[two], y[three]]), np.concatenate([n[two], w[three]])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(third), pa.string()), pa.array(columns[0].view("i8")), pa.array(columns[1].view("i8")),
             pa.array(third.view("i8"), mask=third == 0), pa.array(columns[2].astype("i8"))], names=["lang", "a", "b", "c", "n"])

    def run(batches: Iterator) -> Iterator:
        key, parts, held = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if key is not None and key != (row["lang"], row["range"]):
                    yield from united(key[0], parts)
                    parts, held = [], 0
                key = (row["lang"], row["range"])
                parts.append(Transducer.unpacked(row))
                held += len(parts[-1].third)
                if held > 2 * RANGE_WORDS and len(parts) > 1:  # unite early: equal windows need their room once
                    parts = [Transducer.union(parts)]
                    held = min(len(parts[0].third), RANGE_WORDS)
        if parts:
            yield from united(key[0], parts)

    dealt = shards.repartition(ranges, "lang", "range").sortWithinPartitions("lang", "range")
    return dealt.mapInArrow(released(run), "lang string, a long, b long, c long, n long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, cover_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring cut, ``n`` all words of the language;
    score = floor(1000000 a a / (l r)). Phrases inside a longer one that has ``cover_percent`` of their count are dropped.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    seed = 0
    while True:
        words = stored(count_words(rows, seed), "words")
        clashes = words.groupBy("lang", "label").agg(F.count("*").alias("k"), F.count("word").alias("w")).where("k > 1 OR w = 0")
        if clashes.isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    ranges = 1 + int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // RANGE_WORDS
    ranges = max(ranges, rows.sparkSession.sparkContext.defaultParallelism)
    phrases = stored(phrase_counts(shard_transducers(rows, seed, ranges), ranges, least), "phrases")
    known = stored(words.where(F.col("n") >= least), "known")
    two, three = phrases.where("c IS NULL").drop("c"), phrases.where("c IS NOT NULL")

    def word(at: str, text: str, n: str) -> DataFrame:
        return known.select("lang", F.col("label").alias(at), F.col("word").alias(text), F.col("n").alias(n))

    def score(n, left, right):
        return F.expr(f"(CAST(1000000 AS decimal(7,0)) * CAST({n} AS decimal(15,0)) * CAST({n} AS decimal(15,0))) div (CAST({left} AS decimal(18,0)) * CAST({right} AS decimal(18,0)))")

    two = two.join(word("a", "x", "fa"), ["lang", "a"]).join(word("b", "y", "fb"), ["lang", "b"])
    inside = three.select("lang", "a", "b", "n").unionByName(three.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    inside = inside.groupBy("lang", "a", "b").agg(F.max("n").alias("longer"))
    kept = two.join(inside, ["lang", "a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("n")))
    kept = kept.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("n").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"), score("n", "fa", "fb").alias("score"))

    pair = phrases.where("c IS NULL").select("lang", "a", "b", "n")
    long = three.join(word("a", "x", "fa"), ["lang", "a"]).join(word("b", "y", "fb"), ["lang", "b"]).join(word("c", "z", "fc"), ["lang", "c"])
    long = long.join(pair.withColumnRenamed("n", "fab"), ["lang", "a", "b"])
    long = long.join(pair.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("fbc")), ["lang", "b", "c"])
    cut = F.least(F.struct(score("n", "fa", "fbc").alias("score"), F.lit(1).alias("k"), F.col("fa").alias("l"), F.col("fbc").alias("r")),
                  F.struct(score("n", "fab", "fc").alias("score"), F.lit(2).alias("k"), F.col("fab").alias("l"), F.col("fc").alias("r")))
    long = long.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("n").alias("a"), cut.alias("cut"))
    long = long.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.unionByName(long).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
