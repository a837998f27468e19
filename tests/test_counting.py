"""Exact order statistics by counting, against sorting."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.common import BINS, order_statistics, text_statistics


@pytest.mark.parametrize("n, wide", [(1, 10), (2, 10), (777, 5), (500, 10**6), (300, 10**14)])
def test_positions_are_those_of_a_sort(spark, n, wide):
    rng = random.Random(n + wide)
    rows = [(rng.randrange(-wide, wide), Decimal(rng.randrange(-wide, wide)) / 10000 if rng.random() > 0.1 else None, rng.choice([3, 3, 3, 8])) for _ in range(n)]
    df = spark.createDataFrame(rows, "a long, b decimal(26,4), c int")
    columns = [sorted(x for x in c if x is not None) for c in zip(*rows)]
    wanted = {name: sorted({0, len(c) // 4, len(c) // 2, len(c) - 1}) if c else [] for name, c in zip("abc", columns)}
    got = order_statistics(df, wanted)
    for name, c in zip("abc", columns):
        assert got[name] == {p: (Decimal(c[p]), sum(x < c[p] for x in c)) for p in wanted[name]}


def test_no_rows_and_nulls_only(spark):
    df = spark.createDataFrame([(None,)], "a long")
    assert order_statistics(df, {"a": []}) == {"a": {}} == order_statistics(df.limit(0), {"a": []})
    with pytest.raises(TypeError):
        order_statistics(df.select(F.col("a").cast("double").alias("a")), {"a": [0]})
    assert BINS >= 2


def test_text_positions(spark):
    rng = random.Random(8)
    names = sorted({"Customer#" + "".join(rng.choice("01é日z\x00") for _ in range(rng.randrange(8))) for _ in range(400)} | {"", "Cust"}, key=lambda x: x.encode())
    df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(names)], "v string, k int").repartition(4)
    own = [[x for i, x in enumerate(names) if i % 2 == k] for k in (0, 1)]
    wanted = {10 * k + j: (F.col("k") == k, p) for k in (0, 1) for j, p in enumerate((0, 5, len(own[k]) // 2, len(own[k]) - 1))}
    got = text_statistics(df, "v", wanted)
    assert got == {10 * k + j: own[k][p] for k in (0, 1) for j, p in enumerate((0, 5, len(own[k]) // 2, len(own[k]) - 1))}
