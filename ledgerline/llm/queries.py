"""Registered queries of the training-data operators and their SQL twins.

Each query applies its operator to whole tables and derives the columns of its
contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, embedding_join, exact_dedup, jaccard, language_id, line_dedup, pii, quality, suffix_dedup, toxicity, whitening
from .common import table

SQL: dict[str, str] = {}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of_kind(kind: str) -> Callable:
    return lambda s: s["kind"] == kind


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    run_starts = F.filter("gone", lambda p, i: (i == 0) | (F.get("gone", i - 1) != p - 1))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.size(run_starts).cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
ends AS (SELECT r, doc_id, line, pos FROM l UNION ALL SELECT r, doc_id, NULL, len(lines) FROM d),
p AS (SELECT r, doc_id, pos, coalesce(sum(length(line)) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM ends),
e AS (SELECT r, doc_id, pos, min(pos) OVER (PARTITION BY r ORDER BY chars DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING) AS till,
             max(pos) OVER (PARTITION BY r ORDER BY chars RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING) AS since FROM p),
s AS (SELECT r, doc_id, pos AS a, till AS b FROM e WHERE till IS NOT NULL UNION SELECT r, doc_id, since, pos FROM e WHERE since IS NOT NULL),
f AS (SELECT s.r, a, b, row_number() OVER (PARTITION BY b - a, array_to_string(lines[a + 1 : b], chr(10)) ORDER BY s.doc_id NULLS LAST, s.r, a) AS nth
      FROM s JOIN d USING (r)),
gone AS (SELECT DISTINCT r, unnest(range(a, b)) AS pos FROM f WHERE nth > 1),
k AS (SELECT l.*, gone.pos IS NOT NULL AS cut, lag(gone.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.r ORDER BY l.pos) AS before
      FROM l LEFT JOIN gone ON gone.r = l.r AND gone.pos = l.pos)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE cut AND NOT before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM k GROUP BY r
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label one category besides quality, so the chain is: low quality, then toxic."""
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    rows = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories)
    return rows.select(F.col("id").alias("doc_id"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(language_id.of_documents(docs, "doc_id"), language_id.fit(docs))


def op8_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, which carry all four kinds of evidence."""
    pages = table(spark, sf_dir, "pages")
    return language_id.identify(language_id.of_pages(pages, "page_id"), language_id.fit(table(spark, sf_dir, "documents")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op5_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN iw USING (win)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN found USING (r)
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "n_links")


SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])) END AS grams
  FROM d),
k AS (SELECT sha256(array_to_string(grams, '|')) AS c, any_value(grams) AS grams, min(doc_id) AS id FROM s WHERE len(grams) > 0 GROUP BY c),
g AS (SELECT c, len(grams) AS n, unnest(grams) AS gram FROM k),
p AS (SELECT x.c AS a, y.c AS b FROM g x JOIN g y ON x.gram = y.gram AND x.c <> y.c GROUP BY x.c, y.c, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))),
reach AS (SELECT a, a AS b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
home AS (SELECT a AS c, min(k.id) AS class_id FROM reach JOIN k ON k.c = reach.b GROUP BY a),
n AS (SELECT a AS c, count(*) AS n_links FROM p GROUP BY a)
SELECT doc_id, coalesce(home.class_id, k.id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN k ON len(s.grams) > 0 AND k.c = sha256(array_to_string(s.grams, '|'))
LEFT JOIN home ON home.c = k.c LEFT JOIN n ON n.c = k.c
"""


def op11_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


SQL["op11_embedding_join"] = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
p AS (SELECT x.r AS a, y.r AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.r <> y.r
      WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT a, a AS b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
home AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM v LEFT JOIN home USING (r) LEFT JOIN n USING (r)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
f1 AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY lang, x),
f2 AS (SELECT lang, g[1] AS x, g[2] AS y, count(*) AS n FROM (SELECT lang, unnest([[ws[i], ws[i + 1]] for i in range(1, len(ws))]) AS g FROM w) GROUP BY ALL),
f3 AS (SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS n
       FROM (SELECT lang, unnest([[ws[i], ws[i + 1], ws[i + 2]] for i in range(1, len(ws) - 1)]) AS g FROM w) GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, x, y, max(n) AS longer FROM (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) GROUP BY ALL),
two AS (SELECT f.lang, f.x || ' ' || f.y AS phrase, f.n AS a, p.n AS l, q.n AS r, 1000000::HUGEINT * f.n * f.n // (p.n::HUGEINT * q.n) AS score
        FROM f2 f JOIN f1 p ON p.lang = f.lang AND p.x = f.x JOIN f1 q ON q.lang = f.lang AND q.x = f.y
        LEFT JOIN inside i ON i.lang = f.lang AND i.x = f.x AND i.y = f.y
        WHERE f.n >= 10 AND (i.longer IS NULL OR 100 * i.longer < 50 * f.n)),
cuts AS (SELECT f.lang, f.x || ' ' || f.y || ' ' || f.z AS phrase, f.n AS a, p.n AS l1, q2.n AS r1, p2.n AS l2, q.n AS r2,
                1000000::HUGEINT * f.n * f.n // (p.n::HUGEINT * q2.n) AS s1, 1000000::HUGEINT * f.n * f.n // (p2.n::HUGEINT * q.n) AS s2
         FROM f3 f JOIN f1 p ON p.lang = f.lang AND p.x = f.x JOIN f1 q ON q.lang = f.lang AND q.x = f.z
         JOIN f2 p2 ON p2.lang = f.lang AND p2.x = f.x AND p2.y = f.y JOIN f2 q2 ON q2.lang = f.lang AND q2.x = f.y AND q2.y = f.z),
every AS (SELECT * FROM two UNION ALL
          SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(n) AS total FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op8_language_id_pages": op8_language_id_pages,
    "op9_bpe": op9_bpe,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_embedding_join": op11_embedding_join,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
