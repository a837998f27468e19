"""The fitted models against plain numpy and dictionaries: chain and folds (4), discriminant (7), evidence (8), web pages."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import language_id, quality, toxicity


# ------------------------------------------------------------------------------------------------ 4
def plain_logistic(x, y, strength):
    """Newton's method on the dense matrix with a last column of ones, whose weight is free."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    keep = np.append(np.full(x.shape[1] - 1, strength), 0.0)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(keep + 1e-12), grad)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


def test_chain_and_folds_are_those_of_plain_fits(spark, tmp_path):
    rng = random.Random(1)
    buckets, strength = 40, 0.02
    rows = []
    for i in range(400):
        words = sorted(rng.sample(range(buckets), rng.randrange(3, 12)))
        a = int(rng.random() < (0.8 if 1 in words else 0.2))
        b = int(rng.random() < (0.9 if a and 2 in words else 0.15))
        rows.append((i % toxicity.FOLDS, a, b if i % 17 else None, words))  # some rows lack the second label
    path = str(tmp_path / "train")
    spark.createDataFrame(rows, "fold int, a int, b int, words array<int>").write.parquet(path)
    train = spark.read.parquet(path)
    chain = toxicity.fit(train, ["a", "b"], buckets, strength=strength, iterations=500)
    x = np.zeros((len(rows), buckets))
    for i, r in enumerate(rows):
        x[i, r[3]] = 1
    fold, a = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    b = np.array([-1 if r[2] is None else r[2] for r in rows])
    first = plain_logistic(x, a, strength)
    out_of_fold = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):  # a row's earlier probability comes from a model that has not seen it
        w = plain_logistic(x[fold != f], a[fold != f], strength)
        out_of_fold[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w[:-1] + w[-1])))
    known = b >= 0
    second = plain_logistic(np.concatenate([x, out_of_fold[:, None]], 1)[known], b[known], strength)
    assert np.allclose(chain[0], first, atol=0.02) and np.allclose(chain[1], second, atol=0.02)


# ------------------------------------------------------------------------------------------------ 7
def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    sets = [rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + shift for n, shift in ((60, 0.0), (25, 0.7))]
    sums = np.stack([np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]) for x in sets])
    asked = rng.standard_normal((40, d)) * 2
    for alpha, gamma in quality.GRID:
        got = quality.Discriminant.of(sums, alpha, gamma)(asked)
        scatter = [(x - x.mean(0)).T @ (x - x.mean(0)) for x in sets]
        pooled = sum(scatter) / 85
        logs = []
        for x, s in zip(sets, scatter):
            cov = (1 - gamma) * ((1 - alpha) * s / len(x) + alpha * pooled) + gamma * np.diag(np.diag(pooled) + 1e-6)
            far = asked - x.mean(0)
            logs.append(-0.5 * (np.einsum("ij,ij->i", far, np.linalg.solve(cov, far.T).T) + np.linalg.slogdet(cov)[1]) + math.log(len(x)))
        assert np.allclose(got, logs[1] - logs[0], rtol=1e-6, atol=1e-6)


def test_equal_statistics_get_equal_scores(spark, tmp_path):
    path = str(tmp_path / "ties")
    spark.createDataFrame([(i, ["good words here", "BAD!!! $$$"][i % 2]) for i in range(80)], "doc_id long, text string").write.parquet(path)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    rows = quality.classify(spark.read.parquet(path), labels).collect()
    assert len({(r.id % 2, r.score) for r in rows}) == 2


# ------------------------------------------------------------------------------------------------ 8
def plain_trigrams(text):
    data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").encode()]
    return [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 19 for a, b, c in zip(data, data[1:], data[2:]) if (a != 32) + (b != 32) + (c != 32) >= 2]


def plain_identify(rows, taught, temper=0.05, strength=20.0, least=0.5):
    """Dictionaries for the sums, one row after the other."""
    languages = sorted({k for _, k in taught})
    counts = {k: defaultdict(lambda: 0.5) for k in languages}
    for text, k in taught:
        for g in plain_trigrams(text):
            counts[k][g] += 1
    total = {k: sum(c.values()) + 0.5 * (language_id.BUCKETS - len(c)) for k, c in counts.items()}
    mass = {name: defaultdict(lambda: defaultdict(float)) for name in ("all", "declared", "suffix", "host", "domain")}
    scored = []
    for text, declared, suffix, domain, host in rows:
        grams = plain_trigrams(text)
        plain = {k: sum(math.log(counts[k][g] / total[k]) for g in grams) for k in languages}
        top = max(plain.values())
        p = {k: math.exp(temper * (v - top)) for k, v in plain.items()}
        p = {k: v / sum(p.values()) for k, v in p.items()}
        scored.append((plain, p, top / len(grams) + math.log(language_id.BUCKETS) if grams else None))
        if grams:
            for name, value in (("all", 1), ("declared", declared), ("suffix", suffix), ("host", None if host is None else (domain, host)), ("domain", None if host is None else domain)):
                if value is not None:
                    for k in languages:
                        mass[name][value][k] += p[k]
    whole = mass["all"][1]
    base = {k: (whole[k] + 1) / (sum(whole.values()) + len(languages)) for k in languages}

    def prior(domain, host):
        if host is None or (domain, host) not in mass["host"]:
            return base
        up, own = mass["domain"][domain], mass["host"][domain, host]
        up = {k: (up[k] + strength * base[k]) / (sum(up.values()) + strength) for k in languages}
        return {k: (own[k] + strength * up[k]) / (sum(own.values()) + strength) for k in languages}

    out = []
    for (plain, p, lift), (_, declared, suffix, domain, host) in zip(scored, rows):
        s = {k: temper * plain[k] + math.log(prior(domain, host)[k]) for k in languages}
        for name, value in (("declared", declared), ("suffix", suffix)):
            if value in mass[name]:
                for k in languages:
                    s[k] += math.log((mass[name][value][k] + 1) / (whole[k] + len(mass[name])))
        top = max(s.values())
        posterior = 1 / sum(math.exp(v - top) for v in s.values())
        rejected = lift is None or lift < 0 or posterior < least
        out.append((None if rejected else max(languages, key=lambda k: s[k]), posterior, rejected))
    return out


def test_language_sums_are_those_of_dictionaries(spark, tmp_path):
    rng = random.Random(4)
    said = {"en": "the and of that with from this have".split(), "de": "der die und nicht mit auch werden für".split(), "fr": "le la et que avec des été dans".split()}
    taught = [(" ".join(rng.choices(said[k], k=25)), k) for k in said for _ in range(20)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(t, k) for t, k in taught], "text string, lang string").write.parquet(path)
    model = language_id.fit(spark.read.parquet(path))
    rows = []
    for _ in range(90):
        k = rng.choice(list(said))
        host = rng.choice([None, "a.x.org", "b.x.org", "c.y.de"])
        text = rng.choice([None, "", "12 34", " ".join(rng.choices(said[k], k=rng.randrange(1, 5))), " ".join(rng.choices(said[k], k=15)), "zq qz xj"])
        rows.append((text, rng.choice([k, "en", None]), host and host.rsplit(".")[-1], host and host[2:], host))
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, text string, declared string, suffix string, domain string, host string")
    got = {r.k: r for r in language_id.identify(asked, model).collect()}
    for i, (lang, posterior, rejected) in enumerate(plain_identify(rows, taught)):
        assert (got[i].rejected, got[i].lang) == (rejected, lang), rows[i]
        assert abs(got[i].posterior - posterior) < 1e-9


def test_pages_of_all_kinds(spark):
    long = "<html lang=de><body>" + "der die und nicht " * 30_000 + "</body></html>"
    pages = [(1, "http://a.de/x", "<html lang='de'><p>der die und nicht mit auch werden eine</p></html>"), (2, None, None), (3, "http://a.de/x", ""), (None, "no address", "<p>the and of that</p>"),
             (5, "https://u@B.Example.COM:80/", long), (5, "https://u@B.Example.COM:80/", long), (6, "http://a.de", "<script>the and of</script>")]
    df = spark.createDataFrame([(*p, "own", "own") for p in pages], "page_id long, url string, html string, lang string, host string")
    rows = language_id.of_pages(df, "page_id").collect()
    assert [(r.page_id, r.declared, r.suffix, r.domain, r.host) for r in rows if r.page_id in (2, 5)] == [(2, None, None, None, None), *[(5, "de", "com", "example.com", "b.example.com")] * 2]
    docs = spark.createDataFrame([("der die und nicht mit auch werden eine " * 3, "de"), ("the and of that with from this have " * 3, "en")] * 10, "text string, lang string")
    model = language_id.Model(("de", "en"), np.log(np.stack([np.bincount(np.array(plain_trigrams(r.text)), minlength=language_id.BUCKETS) + 0.5 for r in docs.orderBy("lang").dropDuplicates(["lang"]).orderBy("lang").collect()])
                                                   / language_id.BUCKETS))
    got = {}
    for r in language_id.identify(language_id.of_pages(df, "page_id"), model).collect():
        got.setdefault(r.page_id, []).append((r.rejected, r.lang))
    assert got[1] == [(False, "de")] and got[None] == [(False, "en")] and got[5] == [(False, "de")] * 2 and got[2] == got[3] == got[6] == [(True, None)]
    assert language_id.identify(language_id.of_pages(df.limit(0), "page_id"), model).count() == 0


def test_more_languages_than_the_model_holds_raise(spark, tmp_path):
    import pytest

    path = str(tmp_path / "many")
    spark.createDataFrame([(f"some text {i}", f"l{i}") for i in range(5)], "text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    assert len(language_id.fit(docs, max_languages=5).languages) == 5
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs, max_languages=4)
    assert language_id.fit(docs.where(F.lit(False))).languages == ()
