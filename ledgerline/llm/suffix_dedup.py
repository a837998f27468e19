"""Suffix-array dedup (6): bytes of strings of ``size`` (400) bytes that start more than once are removed.

A suffix array of all bytes would need several times the corpus in shuffles, so
suffixes are first dealt by content, without loss:

1. Places whose 16 bytes have a hash of a given residue are anchors, about one
   in 64. A window (``size`` bytes) belongs to the first anchor inside it, which
   its bytes alone decide; a window without an anchor stands alone. The windows
   of an anchor whose distance to it lies in one step of ``STEP`` form a bucket.
   All possible windows of a bucket share ``size - STEP + 1`` bytes, its core;
   together they cover its outer string. Equal windows have equal cores.
2. Buckets whose core occurs once hold no repeated window and leave. Buckets
   with equal core and outer string are copies: all their windows repeat.
3. Where one core has several outer strings, some of their windows may repeat.
   One copy of each outer string goes to the task of its core, where the
   difference-cover algorithm sorts all suffixes: sampled triples are sorted and
   named, names recursed on, the other suffixes merged in, and adjacent ones
   compared on ``size`` bytes. A core with more outer strings than fit one sort
   (``SORT_BYTES``) is taken window by window instead, in a shuffle that any key
   can be split in.
4. Windows of a bucket overlap, so what repeats in it is one range of bytes.
   Ranges go back to all copies by a join, are merged per text and cut out.

Buckets are compared by two 64-bit hashes (core and outer string), windows
inside a core by their bytes (in step 3 by window: by a 64-bit hash more).

Rows: null and empty texts and texts under ``size`` bytes lose nothing; ids may
repeat or be null (repeated rows are copies like any others); an empty table
gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, released, slices, stored

GRAM, SPACING, STEP = 16, 64, 96
SORT_BYTES = 800_000
BROADCAST_ROWS, BROADCAST_ENTRIES = 200_000, 500_000  # rows, and entries of their arrays
STRINGS_PER_TASK = 4000


def buckets(rows: DataFrame, size: int) -> DataFrame:
    """(__row, text) -> (core, outer, __row, start, span): windows start .. start + span (bytes) of a row form a bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import BASE, BASE_INVERSE, GOLD, mix, powers, text_bytes

        value = mix(np.arange(1, 257, dtype="u8"))
        reach = size - GRAM  # the farthest an anchor may lie behind the start of its window
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                if not len(data):
                    continue
                sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(value[data] * powers(len(data), BASE), dtype="u8")])
                back = powers(len(data) + 1, BASE_INVERSE)

                def hashed(a, b, sums=sums, back=back):
                    return mix((sums[b] - sums[a]) * back[a])

                grams = (sums[GRAM:] - sums[:-GRAM]) * back[:len(data) + 1 - GRAM] if len(data) >= GRAM else np.zeros(0, "u8")
                anchors = np.flatnonzero((grams * GOLD) >> np.uint64(64 - SPACING.bit_length() + 1) == 0)
                begin, stop = starts[:-1], starts[1:] - 1  # without the separator
                owner = np.searchsorted(starts, anchors, "right") - 1
                held = anchors + GRAM <= stop[owner]
                anchors, owner = anchors[held], owner[held]
                same = np.concatenate([[False], owner[1:] == owner[:-1]])[: len(owner)]
                before = np.where(same, np.concatenate([[0], anchors[:-1]])[: len(anchors)] + 1, begin[owner])
                low = np.maximum(before, anchors - reach)
                high = np.minimum(anchors, stop[owner] - size)
                some = low <= high
                a, own, low, high = anchors[some], owner[some], low[some], high[some]
                near, far = (a - high) // STEP, (a - low) // STEP
                times = far - near + 1
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(near, times)
                a, own, low, high = (np.repeat(x, times) for x in (a, own, low, high))
                low, high = np.maximum(low, a - (step + 1) * STEP + 1), np.minimum(high, a - step * STEP)
                core = hashed(a - step * STEP, a - (step + 1) * STEP + 1 + size) if len(a) else np.zeros(0, "u8")
                # windows without an anchor: from reach bytes before one anchor (or the text's start) to the next
                last = np.concatenate([begin, anchors + 1])
                its = np.concatenate([np.arange(len(begin)), owner])
                order = np.lexsort((last, its))
                last, its = last[order], its[order]
                follow = np.concatenate([np.where(its[1:] == its[:-1], last[1:] - 1 - reach, stop[its[:-1]] - size + 1), stop[its[-1:]] - size + 1])
                bare = np.maximum(np.minimum(follow, stop[its] - size + 1) - last, 0)
                alone = np.arange(bare.sum()) - np.repeat(np.cumsum(bare) - bare, bare) + np.repeat(last, bare)
                alone_own = np.repeat(its, bare)
                core = np.concatenate([mix(core + step.astype("u8")), mix(hashed(alone, alone + size) ^ GOLD) if len(alone) else np.zeros(0, "u8")])
                shape = np.concatenate([(a - low) * size + (high - low), np.full(len(alone), -1)]).astype("u8")
                low, high, own = np.concatenate([low, alone]), np.concatenate([high, alone]), np.concatenate([own, alone_own])
                outer = mix(hashed(low, high + size) + mix(shape)) if len(low) else np.zeros(0, "u8")
                row = part.column("__row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view("i8")), pa.array(outer.view("i8")), pa.array(row[own]), pa.array((low - begin[own]).astype("i4")), pa.array((high - low).astype("i4"))],
                    names=["core", "outer", "__row", "start", "span"])

    return rows.select("__row", "text").mapInArrow(released(run), "core long, outer long, __row long, start int, span int")


def _bounded(df: DataFrame, entries: str) -> DataFrame:
    """``df`` (stored) with a broadcast hint if its rows and the entries of its array are counted to be few."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_ENTRIES else df


def outer_strings(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(core, outer, bytes) of the buckets ``wanted`` (core, outer, __row, start, span), read from their rows."""
    places = stored(wanted.groupBy("__row").agg(F.collect_list(F.struct("core", "outer", "start", "span")).alias("places")), "places")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                core, outer, data = [], [], []
                for text, places in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("places").to_pylist()):
                    for p in places:
                        core.append(p["core"])
                        outer.append(p["outer"])
                        data.append(text[p["start"]:p["start"] + p["span"] + size])
                yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(outer, pa.int64()), pa.array(data, pa.binary())], names=["core", "outer", "data"])

    return rows.join(_bounded(places, "places"), "__row").select("text", "places").mapInArrow(released(run), "core long, outer long, data binary")


def sorted_ranges(strings: DataFrame, size: int) -> DataFrame:
    """(core, outer, low, high) of the strings in which windows low .. high hold all that start elsewhere too, by sorting suffixes."""

    def of_piece(core: list, outer: list, data: list):
        import numpy as np

        from .suffix_array import repeated_windows

        text = np.frombuffer(b"\0".join(data), "u1")
        found = repeated_windows(text, size)
        at = 0
        for c, o, d in zip(core, outer, data):
            inside = np.flatnonzero(found[at:at + len(d) - size + 1])
            if len(inside):
                yield c, o, int(inside[0]), int(inside[-1])
            at += len(d) + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        core, outer, data, held, cut = [], [], [], 0, 0

        def out(k: int):
            rows = list(of_piece(core[:k], outer[:k], data[:k]))
            del core[:k], outer[:k], data[:k]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                                              names=["core", "outer", "low", "high"])

        for batch in batches:
            for c, o, d in zip(*(batch.column(x).to_pylist() for x in ("core", "outer", "data"))):
                if core and c != core[-1]:
                    if held >= SORT_BYTES // 8:  # a core is never parted: pieces end between cores
                        yield out(len(core))
                        held = 0
                core.append(c)
                outer.append(o)
                data.append(d)
                held += len(d) + 1
        if core:
            yield out(len(core))

    tasks = max(1, -(-strings.count() // STRINGS_PER_TASK))
    return strings.repartition(tasks, "core").sortWithinPartitions("core").mapInArrow(released(run), "core long, outer long, low int, high int")


def hashed_ranges(strings: DataFrame, size: int) -> DataFrame:
    """The same window by window: equal windows of a core meet by hash."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import span_hashes

        for batch in batches:
            for c, o, d in zip(*(batch.column(x).to_pylist() for x in ("core", "outer", "data"))):
                at = np.arange(len(d) - size + 1)
                h = span_hashes(np.frombuffer(d, "u1").astype("u8") + np.uint64(1), at, at + size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(np.full(len(at), o)), pa.array(at.astype("i4")), pa.array(h.view("i8"))], names=["core", "outer", "at", "h"])

    windows = stored(strings.mapInArrow(released(run), "core long, outer long, at int, h long"), "windows")
    often = stored(windows.groupBy("core", "h").agg(F.count("*").alias("n")).where("n > 1").select("core", "h"), "often")
    return windows.join(often, ["core", "h"]).groupBy("core", "outer").agg(F.min("at").alias("low"), F.max("at").alias("high"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(__row, ranges): for each row with repeated bytes the sorted, merged byte ranges (a, b) to remove."""
    keyed = keyed_rows(docs.select(F.col(text_col).alias("text")))
    every = buckets(keyed.where("text is not null"), size)
    repeated = stored(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    held = stored(every.join(repeated, "core", "left_semi"), "buckets")
    kinds = held.groupBy("core", "outer").agg(F.count("*").alias("n"), F.min(F.struct("__row", "start", "span")).alias("one"))
    kinds = stored(kinds.select("core", "outer", "n", "one.*"), "kinds")
    mixed = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    strings = stored(outer_strings(keyed, kinds.join(mixed, "core").select("core", "outer", "__row", "start", "span"), size).join(mixed, "core"), "strings")
    fits = F.col("kinds") * (size + STEP) <= SORT_BYTES - SORT_BYTES // 8
    some = sorted_ranges(strings.where(fits).select("core", "outer", "data"), size).unionByName(hashed_ranges(strings.where(~fits).select("core", "outer", "data"), size))
    verdict = kinds.select("core", "outer", "n", "span").join(some, ["core", "outer"], "left")
    whole = F.col("n") > 1
    verdict = verdict.where(whole | F.col("low").isNotNull()).select(
        "core", "outer", F.when(whole, 0).otherwise(F.col("low")).alias("low"), F.when(whole, F.col("span")).otherwise(F.col("high")).alias("high"))
    found = held.join(stored(verdict, "verdict"), ["core", "outer"])
    found = found.select("__row", F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + size).alias("b")).alias("r"))
    return merged(found.groupBy("__row").agg(F.array_sort(F.collect_list("r")).alias("ranges")))


def merged(spans: DataFrame) -> DataFrame:
    """(__row, ranges) with the sorted ranges of each row joined where they touch or overlap."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("ranges")
            flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            out, lengths = [], []
            for low, high in zip(ends[:-1], ends[1:]):
                far = np.maximum.accumulate(b[low:high])
                first = np.concatenate([[True], a[low + 1:high] > far[:-1]])
                at = np.flatnonzero(first)
                out.append((a[low:high][at], far[np.concatenate([at[1:] - 1, [high - low - 1]])]))
                lengths.append(len(at))
            x, y = (np.concatenate([o[i] for o in out]) if out else np.empty(0, "i4") for i in (0, 1))
            made = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["a", "b"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4")), made)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), runs], names=["__row", "ranges"])

    return spans.mapInArrow(released(run), "__row long, ranges array<struct<a int, b int>>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """One row per input row: (__row, id, n_bytes, kept, removed): remaining bytes as binary, removed runs as (a, b)."""
    ranges = stored(repeated_ranges(docs, id_col, text_col, size), "ranges")
    rows = keyed_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.join(_bounded(ranges, "ranges"), "__row", "left").select("__row", "id", "text", "ranges")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, kept, removed = [], [], []
                for text, found in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("ranges").to_pylist()):
                    text, runs = text or b"", found or []
                    edges = [0, *(x for r in runs for x in (r["a"], r["b"])), len(text)]
                    sizes.append(len(text))
                    kept.append(b"".join([text[a:b] for a, b in zip(edges[0::2], edges[1::2])]))
                    removed.append(runs)
                yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, shape)],
                                                 names=["__row", "id", "n_bytes", "kept", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(released(run), f"__row long, id {kind}, n_bytes long, kept binary, removed array<struct<a int, b int>>")
