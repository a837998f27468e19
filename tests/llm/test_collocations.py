"""Phrase collocation mining: against a count in plain Python, with small shards and ranges, and odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import collocations
from ledgerline.llm.collocations import Transducer


def brute(docs, least=10, top=2000, cover=50):
    """The contract, phrase by phrase."""
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    for lang in total:
        found = []
        for (own, p), a in f.items():
            if own != lang or len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * n >= cover * a for (x, q), n in f.items() if x == lang and len(q) == 3 and n >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture()
def put(spark, tmp_path):
    made = iter(range(100))

    def write(rows):
        path = str(tmp_path / f"docs-{next(made)}")
        spark.createDataFrame(rows, "text string, lang string, a long, n string, word string, label long").repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "of", "new", "york", "city", "é", "日本", "\x00", "x\x00y", "don't", "Ü"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(vocabulary + ["new york", "new  york city", "of\tthe"]) + rng.choice([" ", " ", "  ", ". ", ",", "\n", "\x0b", "\t", " ! "]) for _ in range(rng.randrange(60))]
        rows.append(("".join(parts), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("shard, part", [(2_000_000, 2_000_000), (40, 60)])
def test_collocations_match_brute_force(spark, put, monkeypatch, shard, part):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "RANGE_WORDS", part)
    rows = texts(shard) + [(None, "en"), ("", None), (" .,", "xx"), ("one", "de"), ("a b c " * 30, None), ("a b c " * 30, None)]
    docs = put([(*r, 7, "own", "own", 7) for r in rows])
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == brute(rows) and len(got) > 20


def test_collocations_top_and_cover(spark, put):
    rows = texts(3)
    docs = put([(*r, 7, "own", "own", 7) for r in rows])
    got = sorted(map(tuple, collocations.collocations(docs, least=4, top=7, cover_percent=80).collect()))
    assert got == brute(rows, 4, 7, 80)


def test_collocations_of_odd_tables(spark, put):
    assert collocations.collocations(put([])).count() == 0
    assert collocations.collocations(put([(None, None, 1, "", "", 1)])).count() == 0
    long = "w1 w2 w3, " * 60_000
    got = collocations.collocations(put([(long, "en", 1, "", "", 1)])).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("w1 w2 w3", 60_000, 60_000, 60_000, 180_000, 1_000_000)]


def test_labels_shared_by_two_words_change_the_seed(spark, put, monkeypatch):
    """With labels of three bits under the first seed, words clash; the result must not show it."""
    rows = texts(9)
    docs = put([(*r, 7, "own", "own", 7) for r in rows])
    plain, seeds = collocations.count_words, []

    def counted(df, seed):
        seeds.append(seed)
        words = plain(df, seed)
        return words.withColumn("label", words["label"] % 3) if seed == 0 else words

    monkeypatch.setattr(collocations, "count_words", counted)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute(rows) and seeds == [0, 1]


def test_transducers_unite_and_pack():
    rng = np.random.default_rng(1)
    every, parts = Counter(), []
    for _ in range(5):
        own = Counter(tuple(x) for x in rng.integers(0, 4, (50, 3)).tolist())
        every += own
        a, b, c = np.array(sorted(own), "u8").T
        t = Transducer.of_sorted(a, b, c, np.array([own[w] for w in sorted(own)], "u8"))
        parts.append(Transducer.unpacked(t.packed()))
    whole = Transducer.union(parts)
    a, b, c, n = whole.windows()
    assert {w: k for *w, k in zip(zip(a.tolist(), b.tolist(), c.tolist()), n.tolist()) for w in w} == dict(every)
    x, y, n = whole.pairs()
    pairs = Counter()
    for (p, q, _), k in every.items():
        pairs[p, q] += k
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == dict(pairs)
    assert len(whole.first) == len({w[0] for w in every}) and len(whole.second) == len(pairs)
