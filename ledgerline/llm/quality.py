"""Quality classifier (7): regularised quadratic discriminant.

Each text becomes ``FEATURES`` transformed statistics (shares of character
classes, word and line statistics, repetition). Class means and covariances come
from summed moments of the labelled training rows. A class covariance is shrunk
twice: towards the pooled one by ``alpha``, then towards the pooled diagonal by
``gamma``. The discriminant is the difference of the two Mahalanobis
log-densities plus the log prior ratio, computed with Cholesky factors that are
made once and kept with the model. ``alpha`` and ``gamma`` are chosen by log loss
over out-of-fold discriminants of all training rows, and a logistic curve fitted to
these turns a discriminant into the probability of label 1.

What reaches the driver are moments and histogram counts of fixed size, however
large the corpus.

Rows: null text counts as empty; empty texts get a score like any other; rows
with null or repeated ids each get a score; label rows with a null label or id
are ignored, repeated ones all count. With labels of one class or none the score
is (n1 + 1) / (n + 2) for every row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, released, slices, stored

FEATURES = ("log_bytes", "upper", "digit", "symbol", "bang", "stop", "blank", "line_break", "beyond_ascii", "word_length", "short_words",
            "distinct_words", "repeated_runs", "repeated_lines", "line_length", "symbol_words")
GRID = tuple((a, g) for a in (0.05, 0.3, 0.8) for g in (0.01, 0.1, 0.4))
BINS, REACH = 400, 60.0


def _classes():
    import numpy as np

    members = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*<>{}[]|\\^~_=+@/", b"!?", b".,;:", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)), bytes([*range(65, 91), *range(97, 123)])]
    out = np.zeros((len(members), 256), bool)
    for i, m in enumerate(members):
        out[i, list(m)] = True
    return out


def statistics(column):
    """The transformed statistics of an Arrow text column: rows x features."""
    import numpy as np

    from .shingles import BYTE_VALUE, mix, span_hashes, text_bytes

    data, starts = text_bytes(column)
    rows = len(starts) - 1
    n = np.diff(starts) - 1.0  # without the separator
    size = np.maximum(n, 1.0)

    def per_row(mask, at=None):
        """How many marked positions (or entries at byte positions ``at``) each row has."""
        if at is None:
            return np.add.reduceat(mask, starts[:-1], dtype="i8").astype("f8") if rows else np.zeros(0)
        return np.bincount(np.searchsorted(starts, at, "right") - 1, weights=mask, minlength=rows)

    upper, digit, symbol, bang, stop, blank, line, beyond, letter = (per_row(c[data]) for c in _classes())
    inside = np.concatenate([[False], BYTE_VALUE[data] != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    hashes, length = span_hashes(BYTE_VALUE[data], begin, end), end - begin
    first = np.searchsorted(begin, starts)
    words = np.diff(first).astype("f8")
    some = np.maximum(words, 1.0)
    runs = hashes.copy()
    for j in (1, 2):
        runs[: len(hashes) - j] += mix(hashes[j:] + np.uint64(j))
    breaks = np.flatnonzero((data == 10) | (data == 0))
    opens = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    lines = span_hashes(data.astype("u8") + np.uint64(1), opens, breaks)
    long = breaks - opens >= 10  # a line worth counting
    line_first = np.searchsorted(opens, starts)

    def distinct(values, bounds):
        """Different values per row over a sorted copy of (row, value)."""
        owner = np.repeat(np.arange(rows), np.diff(bounds))
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])[: len(v)]
        return np.bincount(o[new], minlength=rows).astype("f8")

    n_runs = np.maximum(words - 2, 0)
    run_owner = np.concatenate([np.arange(a, max(a, b - 2)) for a, b in zip(first[:-1], first[1:])]).astype("i8") if rows else np.zeros(0, "i8")
    run_first = np.concatenate([[0], np.cumsum(n_runs)]).astype("i8")
    long_first = np.concatenate([[0], np.cumsum(long)])[line_first]
    n_lines = np.diff(long_first).astype("f8")
    share = lambda x, of, least=1e-3: np.log(x / of + least)
    return np.stack([
        np.log1p(n), share(upper, np.maximum(letter, 1)), share(digit, size), share(symbol, size), share(bang, size), share(stop, size), share(blank, size, 1e-2),
        share(line, size), share(beyond, size), np.log(per_row(length, begin) / some + 0.5), share(per_row(length <= 3, begin), some, 1e-2),
        np.log(distinct(hashes, first) + 1) - np.log(words + 1), share(n_runs - distinct(runs[run_owner], run_first), np.maximum(n_runs, 1), 1e-2),
        share(n_lines - distinct(lines[long], long_first), np.maximum(n_lines, 1), 1e-2), np.log(size / (line + 1)), share(symbol + bang, some, 1e-2)], 1)


def with_statistics(rows: DataFrame) -> DataFrame:
    """(__row, id, text) -> (__row, id, x): the statistics as array<double>."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                ends = pa.array(np.arange(len(x) + 1, dtype="i4") * len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["__row", "id", "x"])

    return rows.mapInArrow(released(run), f"__row long, id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


def moments(train: DataFrame):
    """Counts, sums and sums of products per (fold, label): array [fold, label, 1 + d + d * d]."""
    import numpy as np

    d = len(FEATURES)
    size = 1 + d + d * d

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((5, 2, size))
        for batch in batches:
            x, y, fold = _matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in range(5):
                for c in range(2):
                    own = x[(fold == f) & (y == c)]
                    total[f, c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total.ravel()[at])], names=["at", "v"])

    sums = train.mapInArrow(released(run), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # at most 10 * size rows
    out = np.zeros(10 * size)
    out[sums["at"]] = sums["v"]
    return out.reshape(5, 2, size)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and the log prior ratio."""

    means: object
    factors: object
    log_dets: tuple[float, float]
    log_prior: float

    @staticmethod
    def of(sums, alpha: float, gamma: float) -> Discriminant:
        import numpy as np

        d = len(FEATURES)
        n = sums[:, 0]
        means = sums[:, 1:1 + d] / n[:, None]
        scatter = sums[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        target = np.diag(np.diag(pooled) + 1e-6)
        factors, dets = [], []
        for c in range(2):
            own = (1 - alpha) * scatter[c] / n[c] + alpha * pooled
            low = np.linalg.cholesky((1 - gamma) * own + gamma * target)
            factors.append(np.linalg.inv(low))
            dets.append(2 * float(np.log(np.diag(low)).sum()))
        return Discriminant(means, factors, (dets[0], dets[1]), float(np.log(n[1] / n[0])))

    def __call__(self, x):
        import numpy as np

        far = [np.square((x - m) @ f.T).sum(1) for m, f in zip(self.means, self.factors)]
        return 0.5 * (far[0] - far[1] + self.log_dets[0] - self.log_dets[1]) + self.log_prior


def _bin(d):
    """Discriminants on a scale that is linear near 0 and logarithmic far out."""
    import numpy as np

    return np.clip((np.arcsinh(d) / np.arcsinh(REACH) + 1) * BINS / 2, 0, BINS - 1).astype("i4")


def _logistic(mid, counts):
    """(slope >= 0, offset) of the logistic curve through binned discriminants, and its log loss."""
    import numpy as np

    w, total = np.array([1.0, 0.0]), counts.sum()
    z = np.stack([mid, np.ones(len(mid))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (counts.sum(0) * p - counts[1]) + 1e-3 * w
        hess = (z * (counts.sum(0) * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
    w[0] = max(w[0], 0.0)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return w, -(counts[1] @ np.log(p) + counts[0] @ np.log(1 - p)) / max(total, 1)


@dataclass(frozen=True)
class Model:
    discriminant: Discriminant | None
    slope: float
    offset: float

    def score(self, x):
        """The probability of label 1, rising with the discriminant."""
        import numpy as np

        # the curve was fitted on the asinh scale of the bins
        d = np.zeros(len(x)) if self.discriminant is None else np.arcsinh(self.discriminant(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.offset, -40, 40)))


def fit(train: DataFrame) -> Model:
    """Fit on (x, label 0/1, fold 1..4), a stored table."""
    import numpy as np

    by_fold = moments(train)
    n = by_fold.sum(0)[:, 0]
    if n.min() < 1:
        return Model(None, 0.0, float(np.log((n[1] + 1) / (n[0] + 1))))
    models = {}
    for f in range(1, 5):
        rest = by_fold.sum(0) - by_fold[f]
        models[f] = [Discriminant.of(rest if rest[:, 0].min() >= 1 else by_fold.sum(0), *g) for g in GRID]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((len(GRID), 2, BINS), "i8")
        for batch in batches:
            x, y, fold = _matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f, tried in models.items():
                own = fold == f
                for g, model in enumerate(tried):
                    total[g] += np.bincount(y[own] * BINS + _bin(model(x[own])), minlength=2 * BINS).reshape(2, BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total.ravel()[at])], names=["at", "v"])

    sums = train.mapInArrow(released(run), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # at most len(GRID) * 2 * BINS rows
    counts = np.zeros(len(GRID) * 2 * BINS)
    counts[sums["at"]] = sums["v"]
    mid = ((np.arange(BINS) + 0.5) / BINS * 2 - 1) * np.arcsinh(REACH)
    curves = [_logistic(mid, c) for c in counts.reshape(len(GRID), 2, BINS)]
    best = int(np.argmin([loss for _, loss in curves]))
    (slope, offset), _ = curves[best]
    return Model(Discriminant.of(by_fold.sum(0), *GRID[best]), float(slope), float(offset))


def fold_of(id_col: str | Column) -> Column:
    """The remainder by which rows are held out (0) or dealt to training folds (1 to 4)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string")), F.lit(5)).cast("int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document row: (__row, id, held_out, score)."""
    rows = keyed_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    scored = stored(with_statistics(rows), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    train = stored(scored.withColumn("fold", fold_of("id")).where("fold > 0").join(known, "id").select("x", "label", "fold"), "train")
    model = fit(train)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["__row", "id", "score"])

    out = scored.mapInArrow(released(run), f"__row long, id {scored.schema['id'].dataType.simpleString()}, score double")
    return out.select("__row", "id", F.coalesce(fold_of("id") == 0, F.lit(False)).alias("held_out"), "score")
