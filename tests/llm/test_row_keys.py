"""Row keys rest on the files alone: results do not change when the splits of the input change between two scans."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontaminate, exact_dedup, jaccard, language_id, line_dedup, quality, suffix_dedup
from tests.conftest import SF_SMALL

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture()
def docs(spark, tmp_path):
    path = str(tmp_path / "docs six files")  # a blank in the path
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(6, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def resplit(spark):
    """Call it to change how files are split."""
    state = [0]

    def change():
        state[0] += 1
        size = ("2000", "3", "16") if state[0] % 2 else ("134217728", "1", "1")
        for k, v in zip(SPLITS, size):
            spark.conf.set(k, v)

    yield change
    for k in SPLITS:
        spark.conf.unset(k)


def test_keys_are_the_same_in_every_scan(spark, docs, resplit):
    found = []
    for _ in range(2):
        resplit()
        rows = common.keyed_rows(docs.select(F.struct("*").alias("row")), "k")
        found.append(({r.k: r.doc_id for r in rows.select("k", "row.doc_id").collect()}, rows.rdd.getNumPartitions()))
    (one, parts), (two, other) = found
    assert one == two and len(one) == docs.count() and parts != other


@pytest.mark.parametrize("module, run", [
    (exact_dedup, lambda d, spark: exact_dedup.keep_first(d).select("doc_id", "text")),
    (line_dedup, lambda d, spark: line_dedup.dedup_lines(d).select("id", "text")),
    (suffix_dedup, lambda d, spark: suffix_dedup.dedup(d).select("id", F.sha2("kept", 256).alias("kept"))),
    (jaccard, lambda d, spark: jaccard.keep_one(d).select("doc_id", "text")),
    (decontaminate, lambda d, spark: decontaminate.keep_clean(d, common.table(spark, SF_SMALL, "benchmark")).select("doc_id", "text")),
    (language_id, lambda d, spark: language_id.keep_identified(d).select("doc_id", "text")),
])
def test_operators_give_the_same_when_splits_change(spark, docs, resplit, monkeypatch, module, run):
    calm = sorted(run(docs, spark).collect())
    plain = module.stored

    def stored(df, name):
        out = plain(df, name)
        resplit()
        return out

    monkeypatch.setattr(module, "stored", stored)
    resplit()
    assert sorted(run(docs, spark).collect()) == calm and calm


def test_keys_need_files(spark):
    with pytest.raises(Exception, match="(?i)metadata"):
        common.keyed_rows(spark.read.parquet(f"{SF_SMALL}/documents.parquet").groupBy("doc_id").count()).collect()


@pytest.mark.parametrize("shingles, depth_bucket", [(9, 4), (18, 4), (90, 4), (18, 4096)])
def test_jaccard_candidates_reach_the_promised_recall(spark, tmp_path, monkeypatch, shingles, depth_bucket):
    """300 pairs at a similarity of exactly 0.8, also where buckets are split on to the last depth."""
    monkeypatch.setattr(jaccard, "BUCKET", depth_bucket)
    rng, rows = random.Random(shingles), []
    for p in range(300):
        own = [f"p{p}w{i}" for i in range(shingles + 4)]
        # a changed last word takes one shingle; of two texts of n shingles each 0.8 asks for n / 9 such
        other = own[:-(shingles // 9)] + [f"q{p}w{i}" for i in range(shingles // 9)]
        rows += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(other))]
    rng.shuffle(rows)
    path = str(tmp_path / "pairs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = jaccard.near_duplicates(spark.read.parquet(path)).where("n_links = 1").count() / 2
    assert found >= 0.985 * 300  # 0.995 is expected; four in 300 by chance would be a run of bad luck


def test_quality_learns_from_few_rows_of_a_class(spark, tmp_path):
    """Three rows of one class, which the shrinkage towards the pooled covariance is made for."""
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the report", "was written", "in a clear", "and calm", "style today."]) for _ in range(60)) for _ in range(60)]
    bad = ["$$$ ### !!! " * 40, "!!! @@@ ### " * 35, "### $$$ " * 60]
    texts = good + bad
    path = str(tmp_path / "few")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(63)], "doc_id long, quality int")
    rows = {r.id: r for r in quality.classify(spark.read.parquet(path), labels).collect()}
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows.values())
    taught = [i for i in range(60, 63) if not rows[i].held_out]
    assert taught and max(rows[i].score for i in taught) < min(rows[i].score for i in range(60))
