"""Embedding whitening (12): covariance by bit-sliced scatter, exact up to the eigenvectors.

1. Every entry c becomes the integer x = floor(SCALE * c) + OFFSET. One grouped
   pass finds the count, the sums and the least and greatest x per dimension.
2. Bit-sliced scatter: x minus the dimension's least is cut in bit planes, and a
   plane of a slice of rows packed in words of 64 rows. The cross-product of two
   dimensions is the sum over pairs of their planes of 2 ** (p + q) times the
   popcount of the planes' AND. Tasks sum slices in 64-bit integers that cannot
   overflow, and emit one row per pair of dimensions; Spark adds them as decimals.
3. The driver holds dimensions x dimensions integers. It undoes the shift and
   centres in integers: n * sum(x y) - sum(x) sum(y), divided by n * n only then;
   ``eigh`` gives components, numbered by falling eigenvalue.
4. Rows are centred as n * x - S in integers and projected. Partial sums of the
   whitened rows' products give the covariance that they really have.

Rows: a vector that is null or holds null or non-finite entries is dropped, and
so is one that has not the most frequent length (of equally frequent ones the
greatest). Entries beyond 2 ** 45 in size count as that. Components of an
eigenvalue not above 1e-12 of the greatest (as many as the vectors' span leaves
out) are not returned. Ids may repeat or be null. Without vectors, or with
vectors that are all equal, the result is empty. Only the id and vector column
are read. The driver holds O(dimensions ** 2) numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, stored

SCALE, OFFSET, REACH = 64, 1_000_000, 2.0**45
SLICE = 64 * 64  # rows whose planes are packed at a time


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


@dataclass(frozen=True)
class Whitening:
    """What rows need to be whitened: count, sums, eigenvalues and components (columns), and shares of the trace."""

    n: int
    sums: list
    values: object
    components: object
    explained: object


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the rows that count, as arrays of long of one length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("v") == (size[0]["d"] if size else 0))

    def integer(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * SCALE, F.lit(REACH)), F.lit(-REACH))).cast("long") + OFFSET

    return rows.select("id", F.transform("v", integer).alias("x"))


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ranges(rows: DataFrame) -> list:
    """(dimension, count, sum, least, greatest), exact, by dimension: as many rows as there are dimensions."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = _matrix(batch.column("x").slice(at, SLICE))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype="i4")), pa.array(np.full(x.shape[1], len(x))), pa.array(x.sum(0)), pa.array(x.min(0)), pa.array(x.max(0))],
                                                     names=["i", "n", "s", "low", "high"])

    parts = rows.mapInArrow(released(run), "i int, n long, s long, low long, high long")
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()


def plane_products(x, bits):
    """Cross-products of the columns of a non-negative integer matrix, from the popcounts of ANDed bit planes.

    ``bits``: the planes of each column; all counts fit 64 bits for at most SLICE rows of up to 25 bits, else integers of any size are used.
    """
    import numpy as np

    column = np.repeat(np.arange(x.shape[1]), bits)
    power = np.concatenate([np.arange(b) for b in bits]) if len(bits) else column
    planes = ((x.T[column] >> power[:, None].astype(x.dtype)) & 1).astype("u1")
    packed = np.packbits(np.pad(planes, ((0, 0), (0, -len(x) % 64))), axis=1).view("u8")
    kind = "i8" if 2 * int(max(bits, default=0)) + len(x).bit_length() < 62 else object
    weight = 1 << power.astype(kind)
    starts = np.concatenate([[0], np.cumsum(bits)[:-1]])
    some = np.flatnonzero(np.asarray(bits))  # columns of one value have no plane
    out = np.zeros((x.shape[1], x.shape[1]), kind)
    rows = np.zeros((len(column), x.shape[1]), kind)
    for p in range(len(column)):
        counts = np.bitwise_count(packed[p] & packed).sum(1, dtype="i8").astype(kind) * weight
        if len(some):
            rows[p, some] = np.add.reduceat(counts, starts[some]) * weight[p]
    if len(some):
        out[some] = np.add.reduceat(rows, starts[some], axis=0)
    return out


def scatter(rows: DataFrame, low: list[int], high: list[int]) -> dict[tuple[int, int], int]:
    """sum over rows of (x_i - low_i)(x_j - low_j) for i <= j, exact."""
    bits = [int(h - s).bit_length() for s, h in zip(low, high)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        d = len(low)
        i, j = np.triu_indices(d)
        total, base = np.zeros((d, d), object), np.array(low, "i8")
        held = []

        def taken() -> None:
            nonlocal held, total
            total = total + plane_products(np.concatenate(held), bits)
            held = []

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held.append(_matrix(batch.column("x").slice(at, SLICE)) - base)
                if sum(map(len, held)) >= SLICE:
                    taken()
        if held:
            taken()
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array([str(v) for v in total[i, j]])], names=["i", "j", "v"])

    parts = rows.mapInArrow(released(run), "i int, j int, v string")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # dimensions squared, at most
    return {(r["i"], r["j"]): int(r["v"]) for r in found}


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all rows (id, x); null without rows or spread."""
    import numpy as np

    of = ranges(rows)
    if not of:
        return None
    n, d = int(of[0]["n"]), len(of)
    low, sums = [int(r["low"]) for r in of], [int(r["s"]) for r in of]
    shifted = [s - n * x for s, x in zip(sums, low)]
    products = scatter(rows, low, [int(r["high"]) for r in of])
    v = np.zeros((d, d))
    for (i, j), p in products.items():  # the shift does not change what is centred
        v[i, j] = v[j, i] = (n * p - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(1e-12 * values.max(), 0.0)]
    if not len(order):
        return None
    return Whitening(n, sums, values[order], vectors[:, order], values[order] / np.trace(v))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w, p): the exact deviation, the whitened vector, and (in one row of a task's slice) the packed sums and products of the slice's w."""
    n, sums = model.n, model.sums

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        turn = model.components / np.sqrt(model.values)
        k = turn.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = _matrix(part.column("x"))
                if not len(x):
                    continue
                small = (n * int(np.abs(x).max()) + max(map(abs, sums))) < 2**62
                centred = n * x - np.array(sums, "i8") if small else n * x.astype(object) - np.array(sums, object)
                far = int(np.abs(centred).max())
                deviation = (centred * centred).sum(1) if far * far * x.shape[1] < 2**63 else (centred.astype(object) ** 2).sum(1)
                w = (centred.astype("f8") / n) @ turn
                moments = np.concatenate([w.sum(0), (w.T @ w).ravel()])
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(w) + 1) * k).astype("i4")), pa.array(w.ravel()))
                first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(len(w), len(moments))]).astype("i4")), pa.array(moments))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([int(v) if v < 2**63 else None for v in deviation.tolist()], pa.int64()), lists, first],
                                                 names=["id", "deviation", "w", "moments"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, deviation long, w array<double>, moments array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row per row and component: (id, component, n, deviation, whitened, explained, identity_error).

    ``deviation`` is null where it passes 64 bits.
    """
    import numpy as np

    rows = stored(integers(vectors, id_col, vector_col), "integers")
    model = fit(rows, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whitened = stored(project(rows, model), "whitened")
    k = len(model.values)
    found = whitened.where(F.size("moments") > 0).select(F.posexplode("moments").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    moments = np.zeros(k + k * k)
    moments[[r["at"] for r in found]] = [r["v"] for r in found]
    mean = moments[:k] / model.n
    error = float(np.abs(moments[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    out = whitened.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
