"""N-gram Jaccard join (10): chosen-path join on five-word shingle sets.

1. Documents with equal shingle sets form one class, for which the row with the
   smallest id stands, so copies cost one member and no pair.
2. A set is embedded as ``MINHASHES`` one-permutation minhash values: tokens
   (coordinate, value) of which two sets share about their Jaccard similarity.
3. Each of ``runs_for(recall)`` repeated runs splits all sets recursively: at a
   node of the run's tree every coordinate is chosen with probability
   1 / (threshold * MINHASHES), by a hash of the path, and a set goes to one
   child per chosen coordinate, named by its value there. Similar sets share a
   child on every level with the probability a critical branching process
   survives; unlike sets part. After ``DEPTH`` levels a bucket of at most
   ``BUCKET`` sets is compared by brute force; a larger one is split on, up to
   ``MAX_DEPTH``, and its sets take part in more runs, as many as the recall
   asks for at that depth. What then is still larger is a group of sets that
   hardly differ: its pairs are compared in blocks, a block pair per task unit,
   so no bucket is cut and none has to fit in one task.
4. Buckets compare minhash values, with a margin of ``MARGIN`` standard errors
   below the threshold, and emit a spanning forest of their candidate pairs
   (fewer edges than members). Components of these edges are candidate groups.
5. Inside a candidate group all pairs of different sets are compared exactly,
   again in blocks; what leaves a task is a count of links per set and a
   spanning forest of exact links, never the pairs. Components of the exact
   links are the near-duplicate groups.

Every exact link whose sets met in some run is found, and every link inside a
candidate group whether or not its sets met. Similarity is that of sets of
64-bit shingle hashes.

Rows: a text of fewer than ``shingle`` words is one shingle of all its words;
null texts and texts without words have no set and no links, and are alone in
their class. Ids may repeat or be null (rows are told apart by position); the
group id is the smallest id of the group, null if it has none. Empty tables
give an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, released, slices, stored
from .components import components

MINHASHES, DEPTH, MAX_DEPTH = 128, 3, 6
BUCKET, MARGIN = 4096, 4.0
SPLIT_ROWS = 8000  # rows whose coordinates are drawn at a time (a few arrays of MINHASHES numbers a row)
BLOCK, BLOCK_BYTES = 1024, 16 << 20  # sets, and bytes of their hashes, in a block of exact comparisons
BROADCAST_ROWS = 1_000_000


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    meet = 1.0
    for _ in range(depth):  # a node has a Poisson number, of mean 1, of children that both sets go to
        meet = 1 - math.exp(-meet)
    # short sets share a number of coordinates that varies; below DEPTH that costs up to a fifth of the runs
    return math.ceil((1 if depth <= DEPTH else 1.25) * math.log(1 - recall) / math.log(1 - meet))


def minhashes(found):
    """One-permutation minhash of a sorted distinct set: the smallest hash per stripe, empty stripes filled from the next full one."""
    import numpy as np

    from .shingles import mix

    width = np.uint64((1 << 64) // MINHASHES)
    stripe = (found // width).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    at = np.searchsorted(stripe[first], np.arange(MINHASHES))
    at[at == len(first)] = 0
    full = stripe[first][at]
    away = ((full - np.arange(MINHASHES)) % MINHASHES).astype("u8")
    return (mix(found[first][at] + away) & np.uint64(0xFFFF)).astype("<u2")


def describe(rows: DataFrame, shingle: int) -> DataFrame:
    """(__row, id, text) -> (__row, id, n, d1, d2, sig): size, two digests and minhashes of the shingle set; n = 0: no set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix, shingle_sets

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                with np.errstate(over="ignore"):
                    d1 = [int(mix(s).sum(dtype="u8").view("i8")) for s in sets]
                    d2 = [int((mix(s ^ np.uint64(0x5555)) * np.uint64(3)).sum(dtype="u8").view("i8")) for s in sets]
                    sig = [minhashes(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), part.column("id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(d1, pa.int64()),
                     pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["__row", "id", "n", "d1", "d2", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"__row long, id {kind}, n int, d1 long, d2 long, sig binary")


def split(sets: DataFrame, threshold: float, levels: int, runs: range = range(0)) -> DataFrame:
    """(node, sig[, path]) -> (node, path): the buckets of each set ``levels`` further down (from the root of each run if ``runs``)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix

        coordinate = mix(np.arange(MINHASHES, dtype="u8") + np.uint64(7))
        chosen = np.uint64(int(2.0**64 / (threshold * MINHASHES)))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, MINHASHES).astype("u8")
                row = np.arange(batch.num_rows)
                path = batch.column("path").to_numpy().view("u8") if not runs else mix(np.repeat(np.arange(runs.start + 1, runs.stop + 1, dtype="u8"), len(row)))
                row = row if not runs else np.tile(row, len(runs))
                for _ in range(levels):
                    who, where = [], []
                    for part in range(0, len(row), SPLIT_ROWS):
                        p = path[part:part + SPLIT_ROWS]
                        x, i = np.nonzero(mix(p[:, None] ^ coordinate) < chosen)
                        r = row[part:part + SPLIT_ROWS][x]
                        who.append(r)
                        where.append(mix(mix(p[x] + coordinate[i]) ^ values[r, i]))
                    row, path = (np.concatenate(who), np.concatenate(where)) if who else (row, path)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row)), pa.array(path.view("i8"))], names=["node", "path"])

    return sets.mapInArrow(released(run), "node long, path long")


def blocks(members: DataFrame, group: str) -> DataFrame:
    """Members of groups dealt to units in which every pair of a group meets.

    A group is cut in ``cuts`` blocks by a hash of the member; a unit is a pair of blocks (i <= j). Adds ``unit`` and ``side``:
    0 or 1 for the two blocks of a pair, 2 where a unit is one block with itself.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    return dealt.select(
        *members.columns, F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))


def _units(batches: Iterator) -> Iterator:
    """The rows of each unit as an Arrow table, from a partition sorted by unit."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column("unit")[-1].as_py() != unit[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """The edges that join two trees, among links given row by row."""

    def __init__(self, n: int):
        import numpy as np

        self.tree, self.edges = np.arange(n), []

    def add(self, x: int, linked) -> None:
        import numpy as np

        for tree, first in zip(*np.unique(self.tree[linked], return_index=True)):
            if tree != self.tree[x]:
                self.tree[self.tree == tree] = self.tree[x]
                self.edges.append((x, linked[first]))


def _may_link(at: int, stop: int, n, side, threshold: float):
    """Mask of the pairs (at .. stop - 1, all) that a unit compares: each once, sizes not too far apart."""
    import numpy as np

    pairs = np.arange(len(n)) > np.arange(at, stop)[:, None]
    pairs &= (side[at:stop, None] != side) | (side == 2)
    return pairs & (np.minimum(n[at:stop, None], n) >= threshold * np.maximum(n[at:stop, None], n) - 1e-9)


def bucket_edges(dealt: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest of the pairs of each unit whose minhash estimate comes near the threshold: (a, b)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches):
            node, n, side = (unit.column(c).to_numpy() for c in ("node", "n", "side"))
            sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), "<u2").reshape(-1, MINHASHES)
            columns, forest = np.ascontiguousarray(sig.T), Forest(len(node))
            for at in range(0, len(node), 128):
                stop = min(at + 128, len(node))
                near = _may_link(at, stop, n, side, threshold)
                if not near.any():
                    continue
                same = np.zeros(near.shape, "i2")
                for c in columns:
                    same += c[at:stop, None] == c
                least = np.minimum(np.minimum(n[at:stop, None], n), MINHASHES)
                near &= same / MINHASHES >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / least)
                for x in np.flatnonzero(near.any(1)).tolist():
                    forest.add(at + x, np.flatnonzero(near[x]))
            if forest.edges:
                a, b = np.array(forest.edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return dealt.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(released(run), "a long, b long")


def with_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, root, cuts, text) -> (node, root, cuts, n, set): the shingle hashes as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import shingle_sets

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("root"), part.column("cuts"), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "root", "cuts", "n", "set"])

    return rows.select("node", "root", "cuts", "text").mapInArrow(released(run), "node long, root long, cuts int, n int, set binary")


def common_counts(sets: list):
    """How many members each pair of sets shares, by products of incidence matrices over slices of the members."""
    import numpy as np

    k = len(sets)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]  # others are in no pair
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((k, k), "f4")
    if len(column):
        dense = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for low in range(0, int(dense[-1]) + 1, 4096):
            a, b = np.searchsorted(dense, [low, low + 4096])
            part = np.zeros((k, min(4096, int(dense[-1]) + 1 - low)), "f4")
            part[row[a:b], dense[a:b] - low] = 1
            out += part @ part.T
    return out


def exact_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Per unit: (node, null, links) for members with links, and (a, b, 0) for the edges of a spanning forest of the links."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches):
            node, n, side = (unit.column(c).to_numpy() for c in ("node", "n", "side"))
            pairs = _may_link(0, len(node), n, side, threshold)
            if not pairs.any():
                continue
            shared = common_counts([np.frombuffer(b, "<u8") for b in unit.column("set").to_pylist()])
            pairs &= shared >= threshold * (n[:, None] + n - shared) - 1e-6
            forest = Forest(len(node))
            for x in np.flatnonzero(pairs.any(1)).tolist():
                forest.add(x, np.flatnonzero(pairs[x]))
            links = (pairs | pairs.T).sum(1)
            own = np.flatnonzero(links)
            a, b = np.array(forest.edges, "i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[own], node[a]])), pa.array(np.concatenate([np.zeros(len(own), "i8"), node[b]]), mask=np.arange(len(own) + len(a)) < len(own)),
                 pa.array(np.concatenate([links[own], np.zeros(len(a), "i8")]))], names=["a", "b", "links"])

    return dealt.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(released(run), "a long, b long, links long")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (stored) with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _buckets(sets: DataFrame, threshold: float, first: int, stop: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Of runs ``first`` to ``stop`` - 1: (path, node, m), the buckets to compare, and the nodes of those that were split on (null: none)."""
    if stop <= first:
        return None, None
    paths = stored(split(sets.select("node", "sig"), threshold, DEPTH, range(first, stop)), "paths")
    leaves, deeper = None, None
    for depth in range(DEPTH, MAX_DEPTH + 1):
        sizes = stored(paths.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        whole = sizes if depth == MAX_DEPTH else sizes.where(F.col("m") <= BUCKET)
        leaf = paths.join(whole, "path").select("path", "node", "m")
        leaves = leaf if leaves is None else leaves.union(leaf)
        large = sizes.where(F.col("m") > BUCKET)
        if depth == MAX_DEPTH or large.isEmpty():
            break
        further = paths.join(large.select("path"), "path")
        if deeper is None:
            deeper = stored(further.select("node").distinct(), "deeper")
        paths = stored(split(further.join(sets.select("node", "sig"), "node").select("node", "sig", "path"), threshold, 1), "paths")
    return leaves, deeper


def candidate_groups(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, root): components of the candidate pairs that the runs bring together.

    Sets of large buckets, which are split on below ``DEPTH``, meet there less often: they take further runs, as many
    as ``recall`` asks for at ``MAX_DEPTH``.
    """
    sets, runs = classes.select("node", "sig"), runs_for(recall)
    leaves, deeper = _buckets(sets, threshold, 0, runs)
    if deeper is not None:
        again, _ = _buckets(stored(sets.join(deeper, "node", "left_semi"), "large"), threshold, runs, runs_for(recall, MAX_DEPTH))
        leaves = leaves if again is None else leaves.union(again)
    leaves = leaves.select("path", "node", F.ceil(F.col("m") / BUCKET).cast("int").alias("cuts"))
    dealt = blocks(leaves, "path").join(classes.select("node", "n", "sig"), "node")
    return components(bucket_edges(dealt, threshold))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    shingle: int = 5, recall: float = 0.995) -> DataFrame:
    """One row per input row: (__row, id, group_id, n_links, kept).

    ``n_links``: the different shingle sets of other documents that this row's
    set is similar to; ``kept``: the row with the smallest id of each group (of equal ids the first).
    """
    keyed = keyed_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    every = stored(describe(keyed, shingle), "described")
    key = ["n", "d1", "d2"]
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("__row"))).alias("best")
    classes = every.where("n > 0").groupBy(*key).agg(best, F.first("sig").alias("sig"))
    classes = stored(classes.select(*key, "best", F.col("best.__row").alias("node"), "sig"), "classes")
    candidates = candidate_groups(classes, threshold, recall)
    candidates = stored(candidates.join(classes.select("node", "n"), "node"), "candidates")
    cuts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8.0 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("cuts")
    candidates = stored(candidates.join(stored(candidates.groupBy("root").agg(cuts), "sizes"), "root").select("node", "root", "cuts"), "candidates")
    texts = keyed.join(bounded(candidates.withColumnRenamed("node", "__row")), "__row").withColumnRenamed("__row", "node")
    found = stored(exact_links(blocks(with_sets(texts, shingle), "root"), threshold), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    roots = components(found.where("b is not null").select("a", "b"))
    placed = classes.drop("sig").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "placed")
    names = stored(placed.groupBy("root").agg(F.min("best").alias("first")), "names")
    verdict = stored(placed.join(names, "root").select(*key, "first", "n_links"), "verdict")
    return every.select("__row", "id", *key).join(verdict, key, "left").select(
        "__row", "id", F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.coalesce("first.__row", "__row") == F.col("__row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``."""
    gone = near_duplicates(docs).where("not kept").select(F.col("__row").alias("k"))
    rows = keyed_rows(docs.select(F.struct("*").alias("row")), "k")
    return rows.join(gone, "k", "left_anti").select("row.*")
