"""Toxicity (4): a classifier chain of linear models.

Categories are predicted one after the other. The model of a category is a
logistic regression on the presence of hashed words plus the probabilities of
all categories before it. While training, those probabilities are out of fold:
each training row's comes from a model fitted on the other folds, so a later
model learns how far an earlier one can be trusted on unseen text. At scoring
time the models fitted on all training rows run in chain order.

The models are fitted on at most about ``sample_rows`` labelled rows, chosen by
a hash of the id (the only bounded sample), so one fit is the work of one task;
the fits of a category (one per fold and one on all rows) run side by side.
Scoring covers whole texts of all rows without a shuffle. Folds follow a hash of
the text, so copies of a text are in one fold.

Rows: null text counts as empty; empty texts get scores; ids may repeat or be
null (each row is scored; a null id matches no label); labels that are null are
ignored for the row; a category with labels of one kind only, or none, gets the
constant (positives + 1) / (rows + 2). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, slices, stored, text_of

FOLDS = 3


def present(column, buckets: int):
    """(the distinct word buckets of every row in order, index of each row's first; one more at the end)."""
    import numpy as np

    from .shingles import words

    hashes, first = words(column)
    rows = len(first) - 1
    key = np.unique(np.repeat(np.arange(rows, dtype="u8"), np.diff(first)) * np.uint64(buckets) + hashes % np.uint64(buckets))
    return (key % np.uint64(buckets)).astype("i4"), np.searchsorted(key, np.arange(rows + 1, dtype="u8") * np.uint64(buckets))


def linear(weights, bucket, first, before):
    """Decision values: words' weights, the earlier probabilities' weights (the next ones), and the offset (the last)."""
    import numpy as np

    k = before.shape[1]
    sums = np.concatenate([[0.0], np.cumsum(weights[bucket])])
    return sums[first[1:]] - sums[first[:-1]] + before @ weights[len(weights) - 1 - k:-1] + weights[-1]


def probability_of(values):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def fit_logistic(bucket, first, before, y, buckets: int, strength: float, iterations: int):
    """Weights of least mean log loss + strength / 2 * |weights|^2 (offset free), by limited-memory BFGS steps."""
    import numpy as np

    n, k = len(y), before.shape[1]
    owner = np.repeat(np.arange(n), np.diff(first))

    def loss(w):
        z = linear(w, bucket, first, before)
        error = probability_of(z) - y
        grad = np.concatenate([np.bincount(bucket, error[owner], buckets), before.T @ error, [error.sum()]]) / n
        grad[:-1] += strength * w[:-1]
        return (np.logaddexp(0, z) - y * z).mean() + strength / 2 * (w[:-1] @ w[:-1]), grad

    w = np.zeros(buckets + k + 1)
    value, grad = loss(w)
    steps: list = []
    for _ in range(iterations):
        way, scales = -grad, []
        for s, g, r in reversed(steps):
            scales.append(r * (s @ way))
            way = way - scales[-1] * g
        if steps:
            s, g, r = steps[-1]
            way = way / (r * (g @ g))
        for (s, g, r), a in zip(steps, reversed(scales)):
            way = way + (a - r * (g @ way)) * s
        slope, size = grad @ way, 1.0 if steps else 1.0 / max(np.abs(grad).max(), 1e-12)
        if slope > -1e-12:
            break
        while True:  # shorten the step until the loss falls enough
            new_value, new_grad = loss(w + size * way)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, g = size * way, new_grad - grad
        if s @ g > 1e-14:
            steps = [*steps[-9:], (s, g, 1 / (s @ g))]
        fell = value - new_value
        w, value, grad = w + s, new_value, new_grad
        if fell < 1e-7:
            break
    return w


def _numbers(table, names: list[str]):
    import numpy as np

    return np.stack([table.column(c).to_numpy() for c in names], 1) if names else np.zeros((table.num_rows, 0))


def _fits(train: DataFrame, category: str, before: list[str], models: list[int], buckets: int, strength: float, iterations: int) -> dict:
    """Weights per model: model f < FOLDS is fitted without fold f, model FOLDS on all rows; a constant gives no weights."""
    known = train.where(F.col(category).isNotNull())
    own = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    rows = known.select("fold", "words", F.col(category).cast("double").alias("y"), *before, own).where("fold <> model")

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        y = table.column("y").to_numpy()
        words = table.column("words").combine_chunks()
        first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        if y.min() == y.max():
            w = np.zeros(0)
        else:
            w = fit_logistic(words.flatten().to_numpy(), first, _numbers(table, before), y, buckets, strength, iterations)
        return pa.table({"model": table.column("model").slice(0, 1).cast(pa.int32()), "n": pa.array([len(y)]), "ones": pa.array([int(y.sum())]), "w": pa.array([w], pa.list_(pa.float64()))})

    import numpy as np

    found = rows.groupBy("model").applyInArrow(run, "model int, n long, ones long, w array<double>").collect()  # FOLDS + 1 models
    got = {r.model: np.array(r.w) if r.w else (r.ones + 1) / (r.n + 2) for r in found}
    return {m: got.get(m, 0.5) for m in models}


def apply(model, bucket, first, before):
    """Probabilities by one model's weights, or its constant."""
    import numpy as np

    if isinstance(model, float):
        return np.full(len(first) - 1, model)
    return probability_of(linear(model, bucket, first, before))


def probability(category: str) -> str:
    return f"p_{category}"


def fit(train: DataFrame, categories: list[str], buckets: int, strength: float = 1e-4, iterations: int = 60) -> list:
    """``train``: a stored table of words, fold and one 0/1 (or null) column per category, in chain order; one model each."""
    chain: list = []
    before: list[str] = []
    for i, category in enumerate(categories):
        last = i + 1 == len(categories)
        models = _fits(train, category, before, [FOLDS] if last else [*range(FOLDS), FOLDS], buckets, strength, iterations)
        chain.append(models[FOLDS])
        if not last:
            train = stored(_out_of_fold(train, models, before, probability(category)), f"out-of-fold-{category}")
        before = [*before, probability(category)]
    return chain


def _out_of_fold(train: DataFrame, models: dict, before: list[str], out: str) -> DataFrame:
    names = train.columns

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words, fold = batch.column("words"), batch.column("fold").to_numpy()
            first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            bucket, earlier = words.flatten().to_numpy(), _numbers(batch, before)
            p = np.zeros(batch.num_rows)
            for f in range(FOLDS):
                p = np.where(fold == f, apply(models[f], bucket, first, earlier), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema.fields)
    return train.mapInArrow(released(run), f"{kinds}, `{out}` double")


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, sample_rows: int, buckets: int) -> DataFrame:
    """About ``sample_rows`` labelled rows: fold, the labels, and the hashed words of the text."""
    known = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(k) for k, c in categories.items()])
    known = known.where("id is not null")
    share = min(1.0, sample_rows / max(known.count(), 1))
    chosen = stored(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)), "chosen")  # its size is bounded by sample_rows
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    keep = ["fold", *categories]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                bucket, first = present(part.column("text"), buckets)
                words = pa.ListArray.from_arrays(pa.array(first.astype("i4")), pa.array(bucket))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], words], names=[*keep, "words"])

    return stored(rows.select(fold, *categories, "text").mapInArrow(released(run), ", ".join(f"`{c}` int" for c in keep) + ", words array<int>"), "train")


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = 30_000, buckets: int = 1 << 16) -> DataFrame:
    """One row per document row: id and ``p_<category>`` for each category.

    ``categories``: in chain order, name -> 0/1 expression over ``labels``.
    """
    chain = fit(training_rows(docs, labels, categories, id_col, text_col, sample_rows, buckets), list(categories), buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [probability(c) for c in categories]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                bucket, first = present(part.column("text"), buckets)
                made = np.zeros((part.num_rows, 0))
                for model in chain:
                    made = np.concatenate([made, apply(model, bucket, first, made)[:, None]], 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(made[:, i]) for i in range(made.shape[1])]], names=["id", *names])

    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names))
