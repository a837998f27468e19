"""Pricing I1–I4: unit prices, demand curves, price statistics, LOWESS trend.

I1–I3 are native aggregations over every (material group, product) at once.
I4 is the one place Python runs on executors: a smoother over blocks of points
of each product's binned curve (bins are whole currency units of its prices).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..plans.common import keyed, materialize, tasks_for, top_k


def product_col(df: DataFrame) -> str:
    """Product level: ITEM_NAME_GROUP, else ITEMNAME, else MATERIALGROUP."""
    for c in (M.ITEM_GROUP, M.ITEM, M.MATERIAL):
        if c in df.columns:
            return c
    raise ValueError("no product column")


def unit_prices(df: DataFrame) -> DataFrame:
    """Rows with QTY > 0 and AMOUNT > 0, UNIT_PRICE = AMOUNT / QTY."""
    q = M.qty_col(df)
    return (df.where((F.col(q) > 0) & (F.col(M.AMOUNT) > 0))
              .withColumn("UNIT_PRICE", F.try_divide(F.col(M.AMOUNT).cast("double"), F.col(q).cast("double"))))


def _top_products(pe: DataFrame, material: str | None, product: str, top: int) -> DataFrame:
    """The ``top`` products by revenue inside each material group (a window per
    material group over one row per product; without one, an ordered limit)."""
    keys = [material, product] if material else [product]
    g = keyed(pe, *keys).groupBy(*keys).agg(F.sum(M.AMOUNT).alias("__rev"))
    order = [F.col("__rev").desc(), F.col(product).asc()]
    if not material:
        return top_k(g, top, *order).select(*keys)
    w = Window.partitionBy(material).orderBy(*order)
    return g.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).select(*keys)


def demand_curve(df: DataFrame, top: int = 50) -> DataFrame:
    """Per (material group, product) of the top ``top`` products of each
    material group: price rounded to whole units -> total quantity, lines."""
    pe = unit_prices(df)
    prod = product_col(df)
    mat = M.MATERIAL if M.MATERIAL in df.columns and prod != M.MATERIAL else None
    keys = [mat, prod] if mat else [prod]
    tp = _top_products(pe, mat, prod, top)
    q = M.qty_col(df)
    return (pe.join(tp, keys, "left_semi")
              .withColumn("PRICE_BIN", F.round("UNIT_PRICE", 0))
              .groupBy(*keys, "PRICE_BIN")
              .agg(F.sum(q).cast("double").alias("TOTAL_QTY"), F.count(q).alias("TXN_COUNT")))


def price_stats(df: DataFrame, top: int = 50, dp: int = 6) -> DataFrame:
    """Mean unit price and its sample standard deviation per product
    (the reference labels the latter "variance")."""
    pe = unit_prices(df)
    prod = product_col(df)
    mat = M.MATERIAL if M.MATERIAL in df.columns and prod != M.MATERIAL else None
    keys = [mat, prod] if mat else [prod]
    tp = _top_products(pe, mat, prod, top)
    return (pe.join(tp, keys, "left_semi").groupBy(*keys)
              .agg(F.round(F.avg("UNIT_PRICE"), dp).alias("avg_price"),
                   F.round(F.stddev_samp("UNIT_PRICE"), dp).alias("price_stddev")))


BLOCK_POINTS = 256  # points of a long curve fitted in one step, at least; a task's unit of work
NEAR_POINTS = 64  # neighbouring points that share running sums, at least
SHARES = 16  # a long curve is fitted in at most about so many blocks, each with at most so many sets of running sums
WHOLE_POINTS = 65_536  # curves up to this stay in one task for all passes
TASK_POINTS = 10_000  # points a task aims at
ROBUST_PASSES = 3


def lowess_pass(x: np.ndarray, y: np.ndarray, fit: np.ndarray | None, first: int, stop: int, frac: float, radius: np.ndarray | None = None) -> np.ndarray:
    """One pass of LOWESS over a curve sorted by ``x``, at its points ``first`` to ``stop`` - 1.

    Local lines with tricube weights over the nearest ``frac`` of points; with the ``fit`` of the pass before at all
    points, points far off it get bisquare weights. A perfect fit is kept. ``radius``: ``_radii`` of these points, if known.
    """
    n = len(x)
    if n < 3:
        return y[first:stop]
    robust = np.ones(n)
    if fit is not None:
        s = np.median(np.abs(y - fit))
        if s <= 0:
            return fit[first:stop]
        q = (y - fit) / (6.0 * s)
        robust = np.where(np.abs(q) < 1, (1.0 - q * q) ** 2, 0.0)
    radius = _radii(x, x[first:stop], frac) if radius is None else radius
    near = max(NEAR_POINTS, -(-n // SHARES))
    return np.concatenate([_by_moments(x, y, robust, x[a:min(a + near, stop)], radius[a - first:min(a + near, stop) - first]) for a in range(first, stop, near)])


def lowess(x: np.ndarray, y: np.ndarray, frac: float, passes: int) -> np.ndarray:
    """All passes over a whole curve."""
    fit, radius = None, _radii(x, x, frac)
    for _ in range(passes + 1):
        fit = lowess_pass(x, y, fit, 0, len(x), frac, radius)
    return fit


def _radii(x: np.ndarray, at: np.ndarray, frac: float) -> np.ndarray:
    """The distance of the farthest of the nearest ``frac`` of points from each of ``at``: bisection on the left end of the window."""
    n = len(x)
    r = min(max(int(np.ceil(frac * n)), 2), n)
    low, high = np.zeros(len(at), int), np.full(len(at), n - r)
    while (low < high).any():
        mid = (low + high) // 2
        right = at - x[mid] > x[np.minimum(mid + r, n - 1)] - at
        open_ = low < high
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return np.maximum(at - x[low], x[low + r - 1] - at)


DEGREES = 12
_Q, _K = np.arange(DEGREES)[:, None], np.arange(DEGREES)
BINOMIAL = np.array([[math.comb(q, k) for k in range(DEGREES)] for q in range(DEGREES)], float)[:, :, None]


def _by_moments(x: np.ndarray, y: np.ndarray, robust: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Local lines at neighbouring points from moments of the curve.

    The tricube weight is a polynomial of degree 9 in the distance on either side of a point, so every sum of a local
    line is a combination of running sums of powers, taken about the middle of the points and in units of their
    radius (where they are well conditioned): work grows as points + window, not as points x window. Points whose
    radii or places differ too much for that are halved down to ``NEAR_POINTS``; those, and points that nearly all
    weight has left, are fitted one by one.
    """
    unit, middle = radius.max(), (at[0] + at[-1]) / 2
    if unit <= 0 or radius.min() < 0.7 * unit or at[-1] - at[0] > 0.4 * unit:
        if len(at) <= NEAR_POINTS:
            return _local_lines(x, y, robust, at, radius)
        half = len(at) // 2
        return np.concatenate([_by_moments(x, y, robust, at[:half], radius[:half]), _by_moments(x, y, robust, at[half:], radius[half:])])
    low, high = np.searchsorted(x, (at - radius).min(), "left"), np.searchsorted(x, (at + radius).max(), "right")
    xs, ys, rs = x[low:high], y[low:high], robust[low:high]
    z, t, g = (xs - middle) / unit, (at - middle) / unit, radius / unit
    powers = z ** np.arange(DEGREES)[:, None] * rs
    base = ys.mean()
    sums = [np.concatenate([np.zeros((DEGREES, 1)), np.cumsum(p, axis=1)], axis=1) for p in (powers, powers * (ys - base))]
    cuts = [np.searchsorted(xs, at - radius, "left"), np.searchsorted(xs, at, "left"), np.searchsorted(xs, at + radius, "right")]
    # shift[q, k]: the factor of the sum of z ** k in that of (z - t) ** q
    shift = BINOMIAL * np.stack([(-t) ** i for i in range(DEGREES)])[np.maximum(_Q - _K, 0)]

    def centred(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of (z - t) ** q between two cuts, for each q."""
        held = s[:, b] - s[:, a]
        out = shift[:, 0] * held[0]
        for k in range(1, DEGREES):
            out[k:] += shift[k:, k] * held[k]
        return out

    sides = [(centred(s, cuts[0], cuts[1]), centred(s, cuts[1], cuts[2])) for s in sums]

    def moment(of: int, j: int) -> np.ndarray:
        """sum of weight * (z - t) ** j over the window."""
        left, right = sides[of]
        out = np.zeros(len(at))
        for p, share in enumerate((1, -3, 3, -1)):
            out += share / g ** (3 * p) * (right[3 * p + j] + (-1) ** (3 * p) * left[3 * p + j])
        return out

    s0, s1, s2, t0, t1 = (moment(of, j) for of, j in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1)))
    thin = s0 <= 1e-3 * (cuts[2] - cuts[0])
    some = np.where(thin, 1.0, s0)
    spread, lean = s2 - s1 * s1 / some, t1 - s1 * t0 / some
    thin |= spread <= 1e-6 * some
    made = base + t0 / some - np.where(thin, 0.0, lean / np.where(thin, 1.0, spread)) * s1 / some
    for some in np.array_split(np.flatnonzero(thin), -(-thin.sum() // NEAR_POINTS)) if thin.any() else []:
        made[some] = _local_lines(x, y, robust, at[some], radius[some])
    return made


def _local_lines(x: np.ndarray, y: np.ndarray, robust: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Weighted lines at the points ``at``, each from its distances to the whole curve."""
    away = np.abs(x - at[:, None])
    radius = radius[:, None]
    u = np.where(radius > 0, away / np.where(radius > 0, radius, 1.0), np.where(away > 0, 2.0, 0.0))
    w = np.maximum(1.0 - u * u * u, 0.0) ** 3 * robust
    total = w.sum(1)
    some = np.where(total > 0, total, 1.0)
    mx, my = np.einsum("ij,j->i", w, x) / some, np.einsum("ij,j->i", w, y) / some  # not by BLAS, whose threads would fight over a worker's core
    dx = x - mx[:, None]
    vx = (w * dx * dx).sum(1)
    lean = (w * dx * (y - my[:, None])).sum(1)
    slope = np.where(vx > 1e-12 * np.maximum(1.0, mx * mx), lean / np.where(vx > 0, vx, 1.0), 0.0)
    return np.where(total > 0, my + slope * (at - mx), y[away.argmin(1)])


def smooth(curve: DataFrame, x: str = "PRICE_BIN", y: str = "TOTAL_QTY", frac: float = 2.0 / 3.0, passes: int = ROBUST_PASSES) -> DataFrame:
    """I4: LOWESS trend per product curve, fitted at every point.

    Curves (one point per distinct price) are packed in a row each, written once, and dealt to as many tasks as their
    points ask for. One of up to ``WHOLE_POINTS`` points takes all passes in its task. A longer one is dealt in blocks,
    fitted apart, in a round per pass: the robustness weights come from the pass before. Blocks grow with the curve, so
    it is sent to about ``SHARES`` of them and no more; a task holds one curve and a block's distances to it.
    """
    from pyspark.sql import types as T

    keys = [c for c in curve.columns if c not in (x, y, "TXN_COUNT")]
    own = [x, y, *[c for c in curve.columns if c not in (*keys, x, y)]]
    # a new StructType: ``schema.add`` would mutate the frame's cached schema
    schema = T.StructType([*[curve.schema[c] for c in (*keys, *own)], T.StructField("trend", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: dict[str, list] = {c: [] for c in (*own, "trend")}
            for row in batch.to_dict("records"):
                xs, ys = np.asarray(row[x], float), np.asarray(row[y], float)
                first, stop = 0, len(xs)
                if "__block" in row:
                    first, stop = row["__block"] * row["__points"], min((row["__block"] + 1) * row["__points"], len(xs))
                    fit = np.asarray(row["trend"], float) if "trend" in row else None
                    parts["trend"].append(lowess_pass(xs, ys, fit, first, stop, frac))
                else:
                    parts["trend"].append(lowess(xs, ys, frac, passes))
                for c in own:
                    parts[c].append(row[c][first:stop])
            if parts["trend"]:
                times = [len(p) for p in parts["trend"]]
                out = {c: batch[c].repeat(times).to_numpy() for c in keys} | {c: np.concatenate(p) for c, p in parts.items()}
                yield pd.DataFrame(out)[[*keys, *own, "trend"]]

    def packed(rows: DataFrame) -> DataFrame:
        held = rows.columns[len(keys):]
        made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("__c"))
        return made.select(*keys, *[F.transform("__c", _field(c)).alias(c) for c in held])

    def tasks(points: int | None) -> int:
        return tasks_for(curve.sparkSession, points or 0, TASK_POINTS)

    curves = materialize(packed(curve.select(*keys, *own)))
    whole = F.size(x) <= WHOLE_POINTS
    short, long = curves.agg(F.sum(F.when(whole, F.size(x))), F.sum(F.when(~whole, F.size(x)))).first()
    rows = curves.where(whole).repartition(tasks(short), *keys).mapInPandas(run, schema)
    if long:
        points = F.greatest(F.lit(BLOCK_POINTS), F.ceil(F.size(x) / SHARES)).cast("int")
        held, fitted = curves.where(~whole), None
        for _ in range(passes + 1):
            held = held if fitted is None else packed(fitted)
            blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.col("__points")).cast("int"))
            dealt = held.withColumn("__points", points).withColumn("__block", F.explode(blocks)).repartition(tasks(long), *keys, "__block")
            fitted = dealt.mapInPandas(run, schema)
        rows = rows.unionByName(fitted)
    return rows.select(*curve.columns, "trend")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]
