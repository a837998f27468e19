"""Plan building blocks under skew: the running sum splits a tied value
across ranges and stays exact."""

from pyspark.sql import functions as F

from ledgerline.plans.common import materialize, running_sum


def test_running_sum_all_tied_is_split_and_exact(spark):
    n = 400
    df = spark.createDataFrame([(f"k{i:04d}", 5, i % 7) for i in range(n)], "key string, v int, w int")
    out = running_sum(df, "v", "key", "w", "cum", descending=True, ranges=4)
    got = [(r.key, r.cum) for r in out.orderBy("key").collect()]
    want, acc = [], 0
    for i in range(n):
        acc += i % 7
        want.append((f"k{i:04d}", acc))
    assert got == want
    # the tied value is spread over all ranges (range key includes the key)
    ranged = materialize(df.repartitionByRange(4, F.col("v").desc(), F.col("key")))
    sizes = [r[1] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < n


def test_running_count_with_groups(spark):
    rows = [("g1", "a", 3), ("g1", "b", 3), ("g1", "c", 1), ("g2", "a", 2), ("g2", "b", 9)]
    df = spark.createDataFrame(rows, "g string, key string, v int")
    out = running_sum(df, "v", "key", None, "rank", descending=False, partition_cols=("g",), ranges=3)
    got = sorted((r.g, r.key, r.rank) for r in out.collect())
    assert got == [("g1", "a", 2), ("g1", "b", 3), ("g1", "c", 1), ("g2", "a", 1), ("g2", "b", 2)]


def test_stored_fact_layout(spark):
    """The stored fact is partitioned by tenant, and reports prune on it."""
    import os

    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    df = T.sales(spark, SF_SMALL)
    path = df.inputFiles()[0].split("/tenant_id=")[0].replace("file:", "")
    tenants = sorted(d for d in os.listdir(path) if d.startswith("tenant_id="))
    assert len(tenants) == df.select("tenant_id").distinct().count()
    plan = df.where(F.col("tenant_id") == "BUILDING").select("AMOUNT")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "ReadSchema: struct<AMOUNT" in plan


def test_per_group_top_k_limits_before_shuffle(spark):
    """row_number() <= k filters are planned as WindowGroupLimit (partial, then final)."""
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL

    for name in ("g21_product_mix", "i2_demand_curve"):
        df = entry.queries()[name](spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
        assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2, name


def test_fact_is_built_without_shuffling_lines_for_the_join(spark, monkeypatch):
    """lineitem and orders meet by buckets: with broadcasts off the plan has no exchange below their join."""
    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    T.build_sales(spark, SF_SMALL)  # makes the bucketed tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = T.build_sales(spark, SF_SMALL)
        plan = fact._jdf.queryExecution().sparkPlan().toString() + fact._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.rindex("SortMergeJoin [l_orderkey"):]
        below = join[: join.index("part.parquet")] if "part.parquet" in join else join
        lines = [x for x in below.splitlines() if "l_orderkey" in x or "o_orderkey" in x]
        assert "Bucketed: true" in below and not any("Exchange" in x for x in lines)
        assert fact.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fact_files_hold_ranges_of_days(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    plan = T.build_sales(spark, SF_SMALL)
    odd = plan.limit(5).withColumn("DATE", F.lit(None).cast(plan.schema["DATE"].dataType))  # lines without a date are kept
    T.write_fact(plan.unionByName(odd), f"{tmpdir_path}/fact", SF_SMALL)
    back = spark.read.schema(plan.schema).parquet(f"{tmpdir_path}/fact")
    assert back.count() == plan.count() + 5 and back.where("DATE IS NULL").count() == 5
    spans = back.where("DATE IS NOT NULL").groupBy("tenant_id", F.input_file_name().alias("f")).agg(F.min("DATE").alias("a"), F.max("DATE").alias("b")).orderBy("tenant_id", "a").collect()
    assert all(x.tenant_id != y.tenant_id or x.b.date() < y.a.date() for x, y in zip(spans, spans[1:])) and len(spans) >= 8


def test_fact_build_deals_by_the_size_of_the_lines(spark, monkeypatch):
    """Buckets, ranges and the tasks of the dimension joins grow with the lines, whatever the session's number of partitions."""
    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    size = T._length(spark, f"{SF_SMALL}/lineitem.parquet")
    assert T._days(spark, SF_SMALL)[1] == max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(T, "RANGE_BYTES", size // 40)
    assert T._days(spark, SF_SMALL)[1] >= 40
    monkeypatch.setattr(T, "BUCKET_BYTES", size // 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = [T._lines(spark, SF_SMALL), T._orders(spark, SF_SMALL)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        dealt = [T._lines(spark, SF_SMALL), T._orders(spark, SF_SMALL)]
        for key, a, b in zip(("l_partkey", "o_custkey"), plain, dealt):
            plan = b._jdf.queryExecution().optimizedPlan().toString()
            assert f"RepartitionByExpression [{key}" in plan and ", 64" in plan
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
