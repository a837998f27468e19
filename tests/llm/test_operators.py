"""The training-data operators: against SQL, brute force or exact round trips, and on odd tables.

Odd tables: null ids and texts, empty and very long texts, repeated rows, no
rows, and extra columns whose names the operators use themselves.
"""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, exact_dedup, jaccard, language_id, line_dedup, pii, quality, queries, suffix_dedup, toxicity
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def put(spark, tmp_path_factory):
    """Rows as a stored table (operators read files), with columns named like the operators' own."""
    made = iter(range(10_000))

    def write(rows, schema=DOCS, clash=True):
        df = spark.createDataFrame(rows, schema)
        if clash:
            df = df.withColumns({c: F.lit(f"own {c}") for c in ("__row", "k", "row", "id", "words", "run", "score", "label", "sig")})
        path = f"{tmp_path_factory.getbasetemp()}/docs-{next(made)}"
        df.coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return write


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""))


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [doc(1, "a b c d e f g"), doc(None, "a b c d e f g"), doc(2, None), doc(3, ""), doc(4, LONG), doc(5, LONG), doc(5, LONG),
       doc(7, "a  b\tc d e f g"), doc(None, None, None, None), doc(8, "x"), doc(9, "é ü 日本 🙂\n\n\n")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF_SMALL).toPandas(), duck.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and [got[c].dtype for c in cols] == [want[c].dtype for c in cols]
    assert sorted(map(repr, got[cols].itertuples(index=False, name=None))) == sorted(map(repr, want[cols].itertuples(index=False, name=None)))


NATIVE = {"op2_exact_dedup", "op5_decontaminate"}


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_native_plans_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ------------------------------------------------------------------------------------------------ 1 PII
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_pii_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1234567890 .-+@%()_é\n") for _ in range(rng.randrange(300))) for _ in range(1500)]
    assert [pii.find(t)[0] for t in texts] == [plain_pii(t) for t in texts]


@pytest.mark.parametrize("text, kind, found", [
    ("write john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john dot doe at mail dot example dot org", "email", "john dot doe at mail dot example dot org"),
    ("to jоhn@example.com", "email", "jоhn@example.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ("card four one one one 1 1 1 1 one one one one 1111", "card", "four one one one 1 1 1 1 one one one one 1111"),
    ("4111​1111 1111 1111", "card", "4111​1111 1111 1111"),
    ("host 192(dot)168[.]0 [dot] 7", "ip", "192(dot)168[.]0 [dot] 7"),
])
def test_pii_disguises_map_back_to_the_source(text, kind, found):
    _, added = pii.find(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in added]


@pytest.mark.parametrize("text, kind, found", [
    ("call plus 49 151 23456789 now", "phone", "plus 49 151 23456789"),
    ("pay 4111, 1111, 1111, 1111", "card", "4111, 1111, 1111, 1111"),
    ("4111\t1111  1111 1111", "card", "4111\t1111  1111 1111"),
])
def test_pii_plus_and_gaps_need_no_other_disguise(text, kind, found):
    _, added = pii.find(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in added]


@pytest.mark.parametrize("text, kind, found", [
    ("host 192 dot 168 dot 0 dot 1", "ip", "192 dot 168 dot 0 dot 1"),
    ("at one nine two dot one six eight dot zero dot one now", "ip", "one nine two dot one six eight dot zero dot one"),
    ("eins neun zwei punkt 168.zero punkt 7", "ip", "eins neun zwei punkt 168.zero punkt 7"),
    ("to a dot b dot c dot d dot e dot f dot g at example dot com", "email", "a dot b dot c dot d dot e dot f dot g at example dot com"),
    ("to a dot b dot c dot d dot e dot f dot g at example.com", "email", "a dot b dot c dot d dot e dot f dot g at example.com"),
])
def test_pii_spelled_dots(text, kind, found):
    _, added = pii.find(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in added]


def test_pii_spelled_dots_take_linear_time():
    for unit in ("1 dot ", "one dot ", "one two ", "1 . ", "a dot b dot c at d dot e ", "a dot a.", "one.", "1  ", "a dot b at c.d "):
        pii.find(unit * (200_000 // len(unit)))


def test_pii_hint_misses_no_rewritten_text():
    rng = random.Random(8)
    parts = ["a", "b.c", "at", "@", "dot", ".", ".-", "plus", "one", "six", "7", "42", ",", "-", " ", " ", "  ", "\t", "[", "]", "é", "е", "\u200b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(30_000)]
    assert [t for t in texts if not pii.HINT.search(t) and pii.normalise(t).text != t] == []


def test_pii_takes_linear_time_on_long_texts():
    for unit in ("1", "a@", "1.", "+1 ", " ", "a dot ", "( ", "one ", "a at b.com "):
        pii.find(unit * (200_000 // len(unit)))


def test_pii_odd_tables(spark, put):
    rows = pii.find_pii(put([*ODD, doc(20, "a@b.co 1.2.3.4")])).collect()
    assert len(rows) == len(ODD) + 1
    assert [(s.kind, s.start, s.end) for r in rows for s in r.spans] == [("email", 0, 6), ("ip", 7, 14)]
    assert pii.find_pii(put([])).count() == 0


# ------------------------------------------------------------------------------------------------ 2 exact dedup
def test_exact_dedup_odd_tables(spark, put):
    rows = exact_dedup.exact_dedup(put(ODD * 3), fan_in=2).collect()
    groups = defaultdict(list)
    for i, text, *_ in ODD * 3:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    assert len(rows) == 3 * len(ODD) and sum(r.kept for r in rows) == len(groups)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.id, r.keep_id, r.group_size) for r in rows) == want
    assert exact_dedup.exact_dedup(put([])).count() == 0
    kept = exact_dedup.keep_first(put(ODD * 3))
    assert kept.count() == len(groups) and {"k", "run", "text", "lang"} <= set(kept.columns)


# ------------------------------------------------------------------------------------------------ 3 line dedup
def brute_lines(docs, m, least):
    seen = defaultdict(list)
    for r, (i, text) in sorted(enumerate(docs), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        lines = (text or "").split("\n")
        for p in range(len(lines) - m + 1):
            seen[tuple(lines[p:p + m])].append((r, p))
    gone = defaultdict(set)
    for w, at in seen.items():
        if sum(map(len, w)) >= least:
            for r, p in at[1:]:
                gone[r] |= set(range(p, p + m))
    return sorted((i is None, i or 0, "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[r])) for r, (i, t) in enumerate(docs))


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_line_dedup_matches_brute_force(spark, put, m):
    rng = random.Random(m)
    docs = [(n, "\n".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(12)))) for n in range(60)]
    docs += [(None, None), (100, ""), (101, docs[0][1])]
    rows = line_dedup.dedup_lines(put([doc(*d) for d in docs]).coalesce(1), min_lines=m, min_chars=m).collect()
    assert sorted((r.id is None, r.id or 0, r.text) for r in rows) == brute_lines(docs, m, m)


def brute_runs(docs, m, least):
    """Lines left of each text: every span of enough lines and characters that an earlier place holds too goes."""
    seen, left = set(), []
    for i, text in docs:
        lines, gone = text.split("\n"), set()
        for p in range(len(lines)):
            for e in range(p + m, len(lines) + 1):
                if sum(map(len, lines[p:e])) >= least:
                    if tuple(lines[p:e]) in seen:
                        gone |= set(range(p, e))
                    seen.add(tuple(lines[p:e]))
        left.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return left


@pytest.mark.parametrize("m, least", [(1, 1), (1, 6), (2, 9), (3, 4), (2, 0)])
def test_line_dedup_judges_whole_runs(spark, put, m, least):
    rng = random.Random(10 * m + least)
    docs = [(n, "\n".join(rng.choice(["", "", "a", "b", "cc", "dddddddd"]) for _ in range(rng.randrange(30)))) for n in range(50)]
    docs += [(90 + n, "\n".join([docs[n][1], "x", docs[n + 5][1]])) for n in range(5)]
    rows = line_dedup.dedup_lines(put([doc(*d) for d in docs]).coalesce(1), min_lines=m, min_chars=least).collect()
    assert sorted((r.id, r.text) for r in rows) == brute_runs(docs, m, least)


def test_line_dedup_takes_long_runs_of_short_lines(spark, put):
    run = "\n".join(f"line {k:05}" for k in range(40))
    rows = line_dedup.dedup_lines(put([doc(1, f"one\n{run}\ntwo"), doc(2, f"three\n{run}\nfour")])).collect()
    assert sorted((r.id, r.text) for r in rows) == [(1, f"one\n{run}\ntwo"), (2, "three\nfour")]


def test_line_dedup_takes_passages_of_one_line(spark, put):
    line = " ".join(f"word{k}" for k in range(60))
    docs = [(1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, line), (4, f"a\n{line[1:]}\nb")]
    rows = line_dedup.dedup_lines(put([doc(*d) for d in docs])).collect()
    assert sorted((r.id, r.text) for r in rows) == [docs[0], (2, "c\nd"), (3, ""), docs[3]]


def test_line_dedup_odd_tables(spark, put):
    assert line_dedup.dedup_lines(put([])).count() == 0
    assert line_dedup.dedup_lines(put(ODD)).count() == len(ODD)


# ------------------------------------------------------------------------------------------------ 4 toxicity
def test_toxicity_separates_held_out_texts(spark, put):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(bad, loud):
        words = rng.choices(vocabulary, k=80) + (rng.choices(["scum", "moron", "clown"], k=3) if bad else []) + (["junkjunk"] * 3 if loud else [])
        rng.shuffle(words)
        return " ".join(words)

    truth = [(i, rng.random() < 0.3, rng.random() < 0.2) for i in range(900)]
    docs = put([doc(i, text(bad, loud)) for i, bad, loud in truth] + ODD[:4])
    labels = spark.createDataFrame([(i, int(not loud), int(bad)) for i, bad, loud in truth if i < 600] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")}, buckets=1 << 14)
    got = [(r.id, r.p_toxic, r.p_low) for r in out.collect()]
    assert len(got) == 904
    held = {i: (p, q) for i, p, q in got if i is not None and 600 <= i < 900}
    assert sum((held[i][0] >= 0.5) == bad for i, bad, _ in truth if i >= 600) > 290
    assert sum((held[i][1] >= 0.5) == loud for i, _, loud in truth if i >= 600) > 290
    none = toxicity.score(docs, labels.where("toxic = 0"), {"toxic": F.col("toxic")}, buckets=1 << 10)
    assert {0 < r.p_toxic < 0.01 for r in none.collect()} == {True}
    assert toxicity.score(put([]), labels, {"toxic": F.col("toxic")}, buckets=1 << 10).count() == 0


# ------------------------------------------------------------------------------------------------ 5 decontamination
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else []:
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        out.append((i is None, i or 0, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return sorted(out)


def test_decontamination_matches_brute_force(spark, put):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "GAMMA", "Été", "éTé", "x1", "日本", "İs"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(i, text(rng.randrange(8, 30))) for i in range(25)] + [(30, "alpha Beta x1"), (31, "x1"), (32, None), (33, ""), (None, text(12)), (3, text(15))]
    docs = [(i, text(rng.randrange(60))) for i in range(120)]
    docs += [(200 + i, text(20) + items[i][1].upper() + text(10)) for i in range(25)] + [(None, items[0][1]), (300, None), (300, ""), (301, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(put([doc(*d) for d in docs]), bench).collect()
    assert sorted((r.id is None, r.id or 0, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows) == brute_hits(docs, items)
    few = [d for d in docs if d[0] is not None][:5]
    assert decontaminate.contamination(put([doc(*d) for d in few]), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(put([]), bench).count() == 0


def test_decontamination_without_broadcasts(spark, monkeypatch):
    want = queries.op5_decontaminate(spark, SF_SMALL).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert Counter(queries.op5_decontaminate(spark, SF_SMALL).collect()) == Counter(want)



def test_bpe_learns_many_pre_tokens_together(monkeypatch):
    """Tokens that end at a byte against a plain search; pre-tokens together, one by one and the library's ids."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words = bpe.SuffixAutomaton({b"a": 0, b"b": 1, b"ab": 2, b"bab": 3, b"abab": 4, b"c": 5})
    node, text = 0, b"cababbabcaab"
    for end in range(1, len(text) + 1):
        node = words.step[node, text[end - 1]]
        found, token = [], words.top[node]
        while token >= 0:
            found.append(int(token))
            token = words.below[token]
        ids = {b"a": 0, b"b": 1, b"ab": 2, b"bab": 3, b"abab": 4, b"c": 5}
        assert found == [i for w, i in sorted(ids.items(), key=lambda x: -len(x[0])) if text[:end].endswith(w)]
    texts = ["".join(chr(97 + (i * k * k + i) % 26) + (" " if (i + k) % 5 == 0 else "") for i in range(1, 60)) + "\u00e9\u4e16 12'll" + "a" * k for k in range(120)]
    library, made = Tokenizer.from_file(path), []
    for few in (0, 10**9):
        monkeypatch.setattr(bpe, "FEW", few)
        made.append(bpe.ByteBpe(path).encode(texts))
    assert made[0] == made[1]
    for t, packed in zip(texts, made[0]):
        assert np.frombuffer(packed, "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


# ------------------------------------------------------------------------------------------------ 6 suffix dedup
def brute_spans(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i:i + size]] > 1:
                cover[i:i + size] = b"\1" * size
        out.append((len(b), bytes(x for x, c in zip(b, cover) if not c), [m.span() for m in re.finditer(b"\1+", bytes(cover))]))
    return out


def copied_texts(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefgh éñ日 \n") for _ in range(n))

    shared = prose(900)
    texts = [prose(rng.randrange(1500)) for _ in range(30)]
    for _ in range(40):
        a = rng.randrange(800)
        texts.append(prose(rng.randrange(300)) + shared[a:a + rng.randrange(900)] + prose(rng.randrange(300)))
    texts += [texts[0], texts[0], "z" * 3000, "ab" * 700, "z" * 401, "z" * 399, None, "", ("abcdefghij" * 45 + "!") * 3]
    return texts


@pytest.mark.parametrize("sort_bytes", [800_000, 1000])
def test_suffix_dedup_matches_brute_force(spark, put, monkeypatch, sort_bytes):
    """Also with every core of several strings taken window by window (the small limit)."""
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    texts = copied_texts(4)
    rows = {r.id: r for r in suffix_dedup.dedup(put([doc(i, t) for i, t in enumerate(texts)])).collect()}
    for i, (n, kept, runs) in enumerate(brute_spans(texts, 400)):
        assert (rows[i].n_bytes, bytes(rows[i].kept), [(r.a, r.b) for r in rows[i].removed]) == (n, kept, runs), i


def test_suffix_array_and_odd_tables(spark, put):
    import numpy as np

    from ledgerline.llm.suffix_array import repeated_windows, suffix_array

    rng = np.random.default_rng(0)
    for n in [*range(12), 300]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    t = rng.integers(1, 3, 300).astype("u1")
    count = Counter(t[i:i + 9].tobytes() for i in range(292))
    assert repeated_windows(t, 9)[:292].tolist() == [count[t[i:i + 9].tobytes()] > 1 for i in range(292)]
    assert suffix_dedup.dedup(put([])).count() == 0
    rows = suffix_dedup.dedup(put(ODD)).collect()
    assert len(rows) == len(ODD) and sum(len(r.kept) for r in rows if r.id == 5) == 0  # copies and a period: nothing is left


def test_suffix_dedup_query_on_planted_passages(spark, tmp_path):
    """Passages of over 50 words in three documents each: gone from all three from 400 bytes on, kept below, clean documents whole."""
    rng = random.Random(11)

    def prose(words):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(words))

    texts, removed, kept = [prose(rng.randrange(40, 600)) for _ in range(100)], [0] * 100, []
    kept += texts
    for size in [350, 399, 400, 401, *range(402, 900, 17)]:
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(size // 6)]  # size - 1 bytes or fewer
        passage = " ".join(words).ljust(size, "z")
        assert len(passage) == size and len(passage.split()) > 50
        for end in "ABC":  # other neighbours in each document, so that no match is longer than the passage
            before, after = f"{prose(rng.randrange(300))} {end}", f"{end} {prose(rng.randrange(300))}"
            texts.append(before + passage + after)
            removed.append(size if size >= 400 else 0)
            kept.append(before + after if size >= 400 else texts[-1])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(queries.op6_suffix_dedup(spark, str(tmp_path)).collect())
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [
        (i, len(t), n, int(n > 0), hashlib.sha256(k.encode()).hexdigest()) for i, (t, n, k) in enumerate(zip(texts, removed, kept))]


# ------------------------------------------------------------------------------------------------ 7 quality
def test_quality_held_out_accuracy(spark):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_tables(spark, put):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (5, 1)], "doc_id long, quality int")
    rows = quality.classify(put(ODD), labels).collect()
    assert len(rows) == len(ODD) and len({round(r.score, 9) for r in rows}) == 1  # one class only: one score for all
    assert quality.classify(put([]), labels).count() == 0
    assert {r.held_out for r in rows if r.id is None} == {False}


# ------------------------------------------------------------------------------------------------ 8 language
def test_language_of_pages_and_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = queries.op8_language_id(spark, SF_SMALL).join(docs.select("doc_id", F.col("lang").alias("told")), "doc_id").collect()
    assert len(rows) == docs.count() and not any(r.rejected for r in rows)
    assert sum(r.text_lang == r.told for r in rows) >= 0.99 * len(rows)
    pages = queries.op8_language_id_pages(spark, SF_SMALL).collect()
    assert len(pages) == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count() and sum(p.rejected for p in pages) <= 0.05 * len(pages)


def test_language_evidence_moves_an_undecided_text(spark, put):
    rng = random.Random(2)
    said = {"en": "the and of that with from this have".split(), "de": "der die und nicht mit auch werden eine".split()}
    docs = put([doc(i, " ".join(rng.choices(said[x], k=60)), x, f"host-{x}") for i, x in enumerate(["en", "de"] * 100)])
    model = language_id.fit(docs)
    short = [("mit the", "de", "host-de", "de"), ("mit the", "en", "host-en", "en"), ("12 34", None, None, None), (None, "en", "host-en", None)]
    asked = spark.createDataFrame([(i, t, d, None, "", h) for i, (t, d, h, _) in enumerate(short)], "k long, text string, declared string, suffix string, domain string, host string")
    every = language_id.of_documents(docs, F.lit(-1).cast("long").alias("k")).unionByName(asked)
    got = {r.k: r.lang for r in language_id.identify(every, model).where("k >= 0").collect()}
    assert [got[i] for i in range(4)] == [want for *_, want in short]


def test_language_odd_tables(spark, put):
    docs = put(ODD)
    rows = language_id.identify(language_id.of_documents(docs, "doc_id"), language_id.fit(docs)).collect()
    assert len(rows) == len(ODD) and all(r.rejected for r in rows if r.doc_id in (2, 3))
    assert language_id.keep_identified(put([])).count() == 0
    unlabelled = put([doc(1, "some text", None), doc(2, None, None)])
    assert language_id.keep_identified(unlabelled).count() == 2


# ------------------------------------------------------------------------------------------------ 9 BPE
def test_bpe_equals_the_library(spark, put):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(60).collect()]
    texts += ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "\x1c\x1d a\x85b\xa0 c", "don't we'LL", "a" * 4000, " " * 3000 + "x", "ʼn ſ ½ ²3４ 日本 🙂"]
    texts += ["".join(rng.choice("ab'st  \n\t19é½🙂日<|endoftext|> \x1d") for _ in range(60)) for _ in range(300)]
    docs = put([doc(i, t) for i, t in enumerate(texts)])
    encoded = bpe.encode(docs.select("doc_id", "text", "words"), path)
    rows = {r.doc_id: r for r in bpe.decode(encoded, path).collect()}
    both = {r.doc_id: r for r in bpe.round_trip(docs.select("doc_id", "text"), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids == both[i].ids
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False) == both[i].decoded == (t or "")
    assert bpe.round_trip(put([]).select("doc_id", "text"), path).count() == 0


# ------------------------------------------------------------------------------------------------ 10 Jaccard join
def brute_links(docs):
    sets = []
    for i, text in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))) if w else None)
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    links = {s: {t for t in kinds if t != s and len(s & t) >= 0.8 * len(s | t) - 1e-9} for s in kinds}
    ids = defaultdict(list)
    for (i, _), s in zip(docs, sets):
        if i is not None:
            ids[s].append(i)
    group = {}
    for s in kinds:
        if s not in group:
            part, todo = set(), [s]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += links[x]
            name = min((i for x in part for i in ids[x]), default=None)
            group |= {x: name for x in part}
    return sorted(((i is None, i or 0), (group[s] if s else i), len(links[s]) if s else 0) for (i, _), s in zip(docs, sets))


def near_copies(seed, groups=12, members=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(30, 400))
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 45))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize("block", [1024, 5])
def test_jaccard_join_matches_brute_force(spark, put, monkeypatch, block):
    """Also with buckets and groups cut into small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", 4096 if block > 5 else 6)
    docs = near_copies(block) + [(None, "a b c"), (None, "a b c"), (900, "a b c"), (901, None), (902, ""), (903, LONG), (904, LONG + " end")]
    rows = jaccard.near_duplicates(put([doc(*d) for d in docs]), recall=0.9999).collect()
    assert sorted(((r.id is None, r.id or 0), r.group_id, r.n_links) for r in rows) == brute_links(docs)
    groups = len({(r.group_id, r.id if r.group_id is None else 0) for r in rows if r.id not in (901, 902)})
    assert sum(r.kept for r in rows) == groups + 2


def test_jaccard_runs_reach_the_recall_and_odd_tables(spark, put):
    assert jaccard.runs_for(0.995) == 12 and jaccard.runs_for(0.5) < 4
    assert jaccard.near_duplicates(put([])).count() == 0
    kept = jaccard.keep_one(put(ODD))
    assert kept.count() == 7 and {"k", "sig", "lang"} <= set(kept.columns)


# ------------------------------------------------------------------------------------------------ pipeline
def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seen, first = set(), []
    for r in docs:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if key not in seen:
            seen.add(key)
            first.append((r.doc_id, r.text))
    near = brute_links(first)
    one = {i for (_, i), g, _ in near if g == i}
    hit = {i for _, i, _, h, _ in brute_hits([d for d in first if d[0] in one], items) if h}
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == one - hit and len(rows) == len(one - hit)
    texts = dict(first)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r["ids"]) for r in rows)
    assert len(corpus_pipeline.STAGES) == 5 and rows
