"""Embedding near-dedup (11): subspace pigeonhole join on cosine similarity.

Unit vectors of cosine c lie sqrt(2 - 2c) apart, in any rotation. Of the squared
distance budget 2 - 2 * threshold each block of ``SIZE`` coordinates gets its
share by dimensions; a pair within the budget is within its share in at least
one block, so joining every block under its share loses no pair.

1. Equal vectors of a label form one class with a count; classes are compared.
2. Vectors are normalised, rotated by a fixed random rotation (which spreads
   what sets vectors apart over all blocks) and cut in blocks. A block is joined
   by range on a grid over its first coordinates, with cells twice as wide as
   the share's distance: a class is at home in one cell and visits those its
   ball reaches. The number of gridded coordinates follows the number of classes.
3. In a cell each home class meets the larger ones present: first by their
   distance in the block, then by that of the whole vectors (16-bit rounded,
   with the rounding error allowed for). What leaves is a spanning forest of
   the candidate pairs, fewer edges than members. Cells with more than ``BLOCK``
   classes are cut in blocks of which every pair meets, in a task each.
4. Components of these edges are candidate groups. Inside a group all pairs are
   verified by cosine in double precision, again in blocks; what leaves is a
   count of links per class and a spanning forest of the links, never the pairs.

Rows: a vector that is null, empty, zero or holds null or non-finite components,
and one without a label, links with nothing; vectors of different length do not
link. Ids may repeat or be null (rows are told apart by their place); a
component's id is its smallest, null if it has none. An empty table gives an
empty result. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, released, stored
from .components import components
from .jaccard import Forest, _units, blocks, bounded

SIZE = 8  # dimensions of a block
BLOCK = 1024  # classes compared with as many in one step
CELL_CLASSES = 1024  # classes in a cell of all labels that the grid aims at
STEP = 1 / 32767  # rounding of the vectors that travel to cells


def usable(vector: Column) -> Column:
    """Whether a vector can link: finite entries, not all of them zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(8)
def rotation(d: int):
    """A random rotation of d dimensions, the same in every task."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit_rows(column):
    """An Arrow list column of equally long vectors as a matrix of unit rows; scaled by powers of two first, which rounds nothing."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None], x


def by_length(batch, name: str = "vector") -> Iterator:
    """The rows of a batch or table in parts of equally long vectors (lists, or bytes)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(name)
    size = np.asarray(pc.binary_length(column) if pa.types.is_binary(column.type) else pc.list_value_length(column))
    for s in np.unique(size):
        yield batch if (size == s).all() else batch.take(pa.array(np.flatnonzero(size == s)))


def shares(d: int, budget: float) -> list[tuple[int, int, float]]:
    """(first, end, distance share) of the blocks of d dimensions."""
    cuts = [*range(0, d, SIZE), d]
    return [(a, b, math.sqrt(budget * (b - a) / d)) for a, b in zip(cuts[:-1], cuts[1:])]


def grid_depth(classes: int) -> int:
    """Coordinates to grid: a cell is about two standard deviations wide at a threshold of 0.98, which parts a coordinate in some 3.6."""
    return max(1, min(SIZE, round(math.log2(max(classes, 1) / CELL_CLASSES) / 1.87))) if classes > CELL_CLASSES else 1


def cells(classes: DataFrame, threshold: float, depth: int, payload: bool) -> DataFrame:
    """(node, part, vector) -> (cell, node, home[, q]): the cells of every block that a class is at home in or visits."""
    budget = 2 - 2 * threshold + 1e-9

    def of_block(y, share: float, depth: int):
        """(row, cell hash, home): cells of width 2 * share that a ball of radius ``share`` around each row meets."""
        import numpy as np

        from .shingles import mix

        width = 2 * share
        row, spent = np.arange(len(y)), np.zeros(len(y))
        code, home = np.zeros(len(y), "u8"), np.ones(len(y), bool)
        for i in range(min(depth, y.shape[1])):
            at = np.floor(y[row, i] / width)
            off = y[row, i] - at * width
            salt = np.uint64(i + 1)
            own = (row, mix(mix(code + salt) ^ at.astype("i8").view("u8")), home, spent)
            sides = [own]
            for step, cost in ((-1, off), (1, width - off)):
                more = spent + cost * cost
                ok = np.flatnonzero(more <= share * share + 1e-12)
                sides.append((row[ok], mix(mix(code[ok] + salt) ^ (at[ok] + step).astype("i8").view("u8")), np.zeros(len(ok), bool), more[ok]))
            row, code, home, spent = (np.concatenate(x) for x in zip(*sides))
        return row, code, home

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for batch in by_length(whole.slice(at, 1000)):
                    unit, _ = unit_rows(batch.column("vector"))
                    d = unit.shape[1]
                    y = unit @ rotation(d)
                    node, part = batch.column("node").to_numpy(), batch.column("part").to_numpy().view("u8")
                    q = np.round(y / STEP).astype("<i2")
                    packed = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer((np.arange(len(q) + 1) * 2 * d).astype("i4")), pa.py_buffer(np.ascontiguousarray(q))])
                    for k, (a, b, share) in enumerate(shares(d, budget)):
                        row, code, home = of_block(y[:, a:b], share, depth)
                        cell = mix(mix(part[row] + np.uint64(k)) ^ code).view("i8")
                        columns = [pa.array(cell), pa.array(node[row]), pa.array(home), pa.array(np.full(len(row), k, "i4"))]
                        columns += [packed.take(pa.array(row))] if payload else []
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "node", "home", "block", "q"][: len(columns)])

    return classes.select("node", "part", "vector").mapInArrow(released(run), "cell long, node long, home boolean, block int" + ", q binary" * payload)


def dealt_cells(present: DataFrame, large: DataFrame) -> DataFrame:
    """The classes of cells as units: (unit, node, role, block, q); role 1 home, 2 present, 3 both.

    A cell of ``cuts`` blocks (table ``large``; one for others) is dealt to units in which a block of home classes
    meets a block of those present.
    """
    rows = present.join(bounded(large), "cell", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    as_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.col("home") & (j != F.col("own"))),
                          lambda j: F.struct(F.col("own").alias("h"), j.cast("int").alias("p"), F.lit(1).alias("role")))
    as_present = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(
        j.cast("int").alias("h"), F.col("own").alias("p"), F.when(F.col("home") & (j == F.col("own")), 3).otherwise(2).alias("role")))
    units = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("p"), F.when(F.col("home"), 3).otherwise(2).alias("role")))) \
        .otherwise(F.concat(as_home, as_present))
    rows = rows.select("cell", "node", "block", "q", F.explode(units).alias("u"))
    return rows.select(F.xxhash64("cell", "u.h", "u.p").alias("unit"), "node", F.col("u.role").alias("role"), "block", "q")


def candidate_edges(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs of each unit within the block's share and near the threshold as a whole."""
    budget = 2 - 2 * threshold

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in _units(batches):
            for unit in by_length(whole, "q"):
                node, role, block = (unit.column(c).to_numpy() for c in ("node", "role", "block"))
                y = np.frombuffer(b"".join(unit.column("q").to_pylist()), "<i2").reshape(len(node), -1).astype("f4") * np.float32(STEP)
                d = y.shape[1]
                a, b, share = shares(d, budget)[block[0]]
                error = 2 * STEP  # twice the rounding of a coordinate of two vectors
                z = np.ascontiguousarray(y[:, a:b])
                near_block, near_all = (share + error * math.sqrt(b - a)) ** 2 + 1e-5, (math.sqrt(budget) + error * math.sqrt(d)) ** 2 + 1e-5
                square, whole_square = (z * z).sum(1), (y * y).sum(1)
                present = np.flatnonzero(role & 2)
                forest = Forest(len(node))
                homes = np.flatnonzero(role & 1)
                for at in range(0, len(homes), 256):
                    h = homes[at:at + 256]
                    near = square[h, None] + square[present] - 2 * (z[h] @ z[present].T) <= near_block
                    near &= (node[h, None] < node[present]) & (block[h, None] == block[present])
                    x, p = np.nonzero(near)
                    if not len(x):
                        continue
                    x, p = h[x], present[p]
                    fits = np.concatenate([whole_square[x[i:i + 65536]] + whole_square[p[i:i + 65536]] - 2 * np.einsum("ij,ij->i", y[x[i:i + 65536]], y[p[i:i + 65536]]) <= near_all
                                           for i in range(0, len(x), 65536)])
                    x, p = x[fits], p[fits]
                    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]).tolist()
                    for s, e in zip(starts, [*starts[1:], len(x)]):
                        forest.add(int(x[s]), p[s:e])
                if forest.edges:
                    a, b = np.array(forest.edges).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(released(run), "a long, b long")


def verified_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Per unit (node, null, links) for classes with links, ``links`` counting vectors, and (a, b, 0) for a spanning forest of the links."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in _units(batches):
            for unit in by_length(whole):
                node, side, times = (unit.column(c).to_numpy() for c in ("node", "side", "times"))
                label = pc.index_in(unit.column("label"), pc.unique(unit.column("label"))).to_numpy()
                _, x = unit_rows(unit.column("vector").combine_chunks() if isinstance(unit.column("vector"), pa.ChunkedArray) else unit.column("vector"))
                norm = np.sqrt((x * x).sum(1))
                links, forest = np.zeros(len(node), "i8"), Forest(len(node))
                for at in range(0, len(node), 256):
                    stop = min(at + 256, len(node))
                    pairs = (np.arange(len(node)) > np.arange(at, stop)[:, None]) & ((side[at:stop, None] != side) | (side == 2)) & (label[at:stop, None] == label)
                    pairs &= (x[at:stop] @ x.T) / (norm[at:stop, None] * norm) >= threshold
                    links[at:stop] += pairs @ times
                    links += times[at:stop] @ pairs
                    for i in np.flatnonzero(pairs.any(1)).tolist():
                        forest.add(at + i, np.flatnonzero(pairs[i]))
                own = np.flatnonzero(links)
                if not len(own):
                    continue
                a, b = np.array(forest.edges, "i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[own], node[a]])), pa.array(np.concatenate([np.zeros(len(own), "i8"), node[b]]), mask=np.arange(len(own) + len(a)) < len(own)),
                     pa.array(np.concatenate([links[own], np.zeros(len(a), "i8")]))], names=["a", "b", "links"])

    return dealt.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(released(run), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: (__row, id, component_id, n_links, kept).

    ``n_links``: the other vectors of cosine >= ``threshold`` to this one; ``component_id``: the smallest id reachable
    by links; ``kept``: the first row with that id in each component.
    """
    rows = keyed_rows(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")))
    fine = F.col("label").isNotNull() & usable(F.col("vector"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("__row"))).alias("best")
    classes = rows.where(fine).groupBy("label", "vector").agg(best, F.count("*").alias("times"))
    classes = stored(classes.withColumns({"node": F.col("best.__row"), "part": F.xxhash64("label", F.size("vector"))}), "classes")
    depth = grid_depth(classes.count())
    large = cells(classes, threshold, depth, False).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = stored(large.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts")), "large")
    groups = components(candidate_edges(dealt_cells(cells(classes, threshold, depth, True), large), threshold))
    groups = stored(groups, "groups")
    cuts = stored(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")), "cuts")
    dealt = blocks(groups.join(cuts, "root").select("node", "root", "cuts"), "root")
    found = stored(verified_links(dealt.join(classes.select("node", "label", "vector", "times"), "node"), threshold), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    placed = classes.select("label", "vector", "node", "best", "times").join(links, "node", "left").join(roots, "node", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("best").alias("first")), "names")
    verdict = stored(placed.join(names, "root").select("label", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "verdict")
    linked = rows.where(fine).join(verdict, ["label", "vector"]).select(
        "__row", "id", F.col("first.id").alias("component_id"), F.col("n_links").cast("long").alias("n_links"), (F.col("first.__row") == F.col("__row")).alias("kept"))
    alone = rows.where(~fine).select("__row", "id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def keep_one(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row of each component, with the columns of ``vectors``."""
    gone = near_duplicates(vectors, id_col, vector_col, label_col, threshold).where("not kept").select(F.col("__row").alias("k"))
    return keyed_rows(vectors.select(F.struct("*").alias("row")), "k").join(gone, "k", "left_anti").select("row.*")
