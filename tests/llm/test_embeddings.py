"""Embedding operators: against brute force in numpy, with small blocks, and odd tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import embedding_join, queries, whitening
from tests.conftest import SF_SMALL

CHECK_S = "/root/testdata/check_s/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string, x int, v int"


@pytest.fixture()
def put(spark, tmp_path):
    made = iter(range(100))

    def write(rows, schema=SCHEMA):
        path = str(tmp_path / f"vectors-{next(made)}")
        spark.createDataFrame([(*r, 7, "own", 7, 7) for r in rows], schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows):
    """(id, component id, links) by comparing all pairs."""
    links = [set() for _ in rows]
    for a, (_, v, k) in enumerate(rows):
        for b, (_, w, m) in enumerate(rows):
            if a != b and k is not None and k == m and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, "f4").astype("f8"), np.array(w, "f4").astype("f8")
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    links[a].add(b)
    out, seen = [None] * len(rows), set()
    for a in range(len(rows)):
        if a not in seen:
            part, todo = set(), [a]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += links[x]
            seen |= part
            name = min((rows[x][0] for x in part if rows[x][0] is not None), default=None)
            for x in part:
                out[x] = (rows[x][0], name, len(links[x]))
    return sorted(out, key=repr)


def clusters(seed, d, n=260, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(d)
        for _ in range(rng.integers(1, 16)):  # cosines on both sides of the threshold, chains too
            base = base + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.15, 0.25])
            rows.append((len(rows), (base * 10.0 ** rng.integers(-2, 3)).astype("f4").tolist(), int(rng.integers(labels)) if rng.random() < 0.1 else 0))
    return rows


@pytest.mark.parametrize("d, block, cell", [(64, 1024, 1024), (64, 3, 8), (12, 1024, 16), (3, 4, 1024), (1, 1024, 1024)])
def test_embedding_join_matches_brute_force(spark, put, monkeypatch, d, block, cell):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    monkeypatch.setattr(embedding_join, "CELL_CLASSES", cell)
    rows = clusters(d + block, d)
    rows += [(900, rows[0][1], 0), (900, rows[0][1], 0), (None, rows[0][1], 0), (901, rows[0][1], None), (902, None, 0), (903, [], 0), (904, [0.0] * d, 0),
             (905, [float("nan")] * d, 0), (906, [float("inf")] * d, 0), (907, [None] * d, 0), (908, [1.0] * (d + 1), 0), (909, [1.0] * (d + 1), 0), (None, None, None),
             (910, [3e38] * d, 1), (911, [1e-44] * d, 1), (912, [2.0] * d, 1)]
    got = embedding_join.near_duplicates(put(rows)).collect()
    assert sorted(((r.id, r.component_id, r.n_links) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == sum(1 for r in got if not r.n_links) + len({r.component_id for r in got if r.n_links})


def test_embedding_join_odd_tables(spark, put):
    assert embedding_join.near_duplicates(put([])).count() == 0
    kept = embedding_join.keep_one(put([(1, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (None, None, None)]))
    assert sorted(str(r.vec_id) for r in kept.collect()) == ["1", "3", "None"] and {"node", "cell", "x"} <= set(kept.columns)


def check_links(spark, path):
    """All pairs of a table against the join; the number of links."""
    t = spark.read.parquet(path).toPandas()
    x = np.stack(t["embedding"].to_numpy()).astype("f8")
    norm = np.sqrt((x * x).sum(1))
    want = np.zeros(len(x), int)
    for k in t["label"].unique():
        own = np.flatnonzero(t["label"] == k)
        want[own] = ((x[own] @ x[own].T) / (norm[own, None] * norm[own]) >= 0.98).sum(1) - 1
    got = embedding_join.near_duplicates(spark.read.parquet(path)).toPandas().set_index("id")["n_links"]
    assert got.loc[t["vec_id"]].tolist() == want.tolist()
    return want.sum()


@pytest.mark.skipif(not os.path.exists(CHECK_S), reason="the check tool's tables are not on this machine")
def test_embedding_join_loses_no_pair_of_the_table(spark):
    check_links(spark, CHECK_S)


def test_embedding_join_loses_no_pair_of_a_made_table(spark, tmp_path):
    """10,256 vectors in 10 classes, cosines on both sides of the threshold."""
    rng = np.random.default_rng(8)
    rows = []
    while len(rows) < 10256:
        base, label = rng.standard_normal(64), int(rng.integers(10))
        for noise in rng.choice([0.0, 0.05, 0.1, 0.14, 0.2], rng.integers(1, 11)):
            v = base + noise * rng.standard_normal(64)
            rows.append((len(rows), (v / np.sqrt(v @ v)).astype("f4").tolist(), label))
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows[:10256], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
    assert check_links(spark, path) > 10000


# ------------------------------------------------------------------------------------------------ whitening
def check_whitening(rows, got, d, components=32):
    """The contract against numpy; the sign of a component is free."""
    fine = [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in fine], object)
    n, sums = len(x), x.sum(0)
    centred = n * x - sums
    v = (n * (x.T @ x) - np.outer(sums, sums)).astype("f8") / (n * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = min(components, int((e > 1e-12 * e.max()).sum()))
    w = (centred.astype("f8") / n) @ u[:, :some] / np.sqrt(e[:some])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by, key=repr) == sorted((i for i, _ in fine), key=repr) and len(got) == n * some
    mine = np.array([[by[i][k + 1].whitened for k in range(some)] for i, _ in fine])
    sign = np.sign((mine * w).sum(0))
    gap = np.abs(np.diff(np.append(e, 0)))[:some]
    apart = (gap > 1e-3 * e[0]) & (np.append(np.inf, gap[:-1]) > 1e-3 * e[0])  # others may turn among themselves
    assert np.allclose((mine * sign)[:, apart], w[:, apart], atol=1e-6)
    assert np.abs(mine.T @ mine / n - np.eye(some)).max() < 1e-6
    first = next(iter(by.values()))
    assert np.allclose([first[k + 1].explained for k in range(some)], e[:some] / e.sum(), rtol=1e-6)
    assert [by[i][1].deviation for i, _ in fine] == [x if x < 2**63 else None for x in (int((c * c).sum()) for c in centred)]
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-6 and len({r.identity_error for r in got}) == 1


def test_whitening_of_the_table(spark):
    t = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    check_whitening([(r.vec_id, r.embedding) for r in t], queries.op12_whitening(spark, SF_SMALL).collect(), 64)


@pytest.mark.parametrize("d, wide", [(5, 1.0), (40, 3.0), (3, 1e6)])
def test_whitening_matches_numpy(spark, put, monkeypatch, d, wide):
    monkeypatch.setattr(whitening, "SLICE", 64)
    rng = np.random.default_rng(d)
    turn = rng.standard_normal((d, d)) * np.arange(1, d + 1)
    rows = [(i, v.tolist(), None) for i, v in enumerate((rng.standard_normal((300, d)) @ turn * wide).astype("f4"))]
    rows += [(300, [1.0] * (d + 1), 1), (301, None, 1), (302, [None] * d, 1), (303, [float("nan")] * d, 1), (304, [float("-inf")] * d, 1), (305, [0.0] * d, 1), (306, [], 1)]
    got = whitening.whiten(put(rows)).withColumnRenamed("id", "vec_id").collect()
    check_whitening(rows, got, d)


def test_whitening_odd_tables(spark, put):
    assert whitening.whiten(put([])).count() == 0
    assert whitening.whiten(put([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    got = whitening.whiten(put([(1, [1.0, 2.0], 1), (1, [3.0, 2.0], 1), (None, [1.0, 2.0], 2), (1, [3.0, 2.0], 1)])).collect()
    assert len(got) == 4 and {round(abs(r.whitened), 9) for r in got} == {1.0} and {r.component for r in got} == {1}
    far = whitening.whiten(put([(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [1.0, 3.0], 1)])).collect()
    assert {r.component for r in far if math.isfinite(r.whitened)} and len({r.id for r in far}) == 3


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(4)
    for high in (1, 2, 1000, 1 << 25, 1 << 40):
        x = rng.integers(0, high, (130, 7))
        x[:, 3] = 0
        bits = [int(c.max()).bit_length() for c in x.T]
        assert (plane := whitening.plane_products(x, bits)).tolist() == (x.astype(object).T @ x.astype(object)).tolist() and len(plane) == 7
