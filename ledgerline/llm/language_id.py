"""Language ID (8) by fusion of text, markup, address and host evidence.

log posterior(l) = temper * log P(text | l) + log P(declared | l) + log P(suffix | l) + log prior(l | host)

* P(text | l): a smoothed model of hashed byte trigrams per language, fitted on
  about ``sample_rows`` labelled rows per language (chosen by a hash of the
  row's place; the only bounded sample here), used on whole texts. ``temper`` allows
  for trigrams not being independent.
* P(declared | l), P(suffix | l): how often rows of language l declare a markup
  language or lie under an address suffix, by grouped sums of the text-only
  posteriors over all rows.
* prior(l | host): grouped sums per host, smoothed towards its domain, which is
  smoothed towards the whole: (n_hl + strength * prior(l | domain)) / (n_h + strength).

Rows whose text has no trigram of letters, whose best posterior is below
``least``, or whose text is likelier under an even spread over all trigram
buckets than under every language, are rejected (lang null).

Rows: null or empty text gives no text evidence (rejected); a null declared
language, address or host gives no evidence of that kind; rows repeat freely
and ids may be null. Without any labelled row no language is known: lang is
null and nothing is rejected. An empty table gives an empty result. Only the
named columns are read. Hot hosts only meet partial sums; tables of declared
values, suffixes, domains and hosts are broadcast up to ``BROADCAST_ROWS``
counted rows, else joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, released, slices, stored, text_of

BUCKETS = 8192
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Model:
    """Languages in order and, per language, the log probability of each trigram bucket."""

    languages: tuple[str, ...]
    log_p: object  # numpy array, languages x BUCKETS


def trigrams(column):
    """(bucket of every letter trigram of an Arrow text column, index of each row's first; one more at the end)."""
    import numpy as np

    from .shingles import text_bytes

    data, starts = text_bytes(column)
    fold = np.arange(256, dtype="u4")
    fold[65:91] += 32
    letter = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
    values = np.where(letter, fold, 32)[data] if len(data) else np.empty(0, "u4")
    values = values.astype("u4")
    n = max(len(values) - 2, 0)
    first, second, third = values[:n], values[1:n + 1], values[2:n + 2]
    ends = np.zeros(len(data), bool)
    ends[starts[1:] - 1] = True  # the separators after the texts
    inside = ~(ends[:n] | ends[1:n + 1] | ends[2:n + 2])
    some = inside & ((first != 32).astype("i1") + (second != 32) + (third != 32) >= 2)
    at = np.flatnonzero(some)
    code = (first[at] << 16) | (second[at] << 8) | third[at]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype("i8")
    return bucket, np.searchsorted(at, starts)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = 20_000, max_languages: int = 500) -> Model:
    """Fit the text model on rows whose label is not null: all rows of a label up to ``sample_rows``, of larger
    ones about that many, chosen by a hash of the row's place (so that copies do not stand or fall together).

    The model holds a number per language and bucket on the driver and in every task; more than ``max_languages``
    labels raise ValueError rather than lose some of them.
    """
    import numpy as np

    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    counts = rows.where("label is not null and text is not null").groupBy("label").agg(F.count("*").alias("n"))
    many = {r["label"]: r["n"] for r in counts.limit(max_languages + 1).collect()}
    if len(many) > max_languages:
        raise ValueError(f"more than {max_languages} languages; give a larger max_languages")
    rows = keyed_rows(rows, "k").where("label is not null and text is not null")
    if not many:
        return Model((), np.zeros((0, BUCKETS)))
    languages = tuple(sorted(many))
    share = F.element_at(F.create_map(*[x for k, n in many.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))]), F.col("label"))
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "label")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((len(languages), BUCKETS), "i8")
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, first = trigrams(part.column("text"))
                label = np.array([place[x] for x in part.column("label").to_pylist()])
                total += np.bincount(np.repeat(label, np.diff(first)) * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype("i4")), pa.array((at % BUCKETS).astype("i4")), pa.array(total.ravel()[at])], names=["l", "b", "n"])

    sums = chosen.mapInArrow(released(count), "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    found = sums.toPandas()  # at most max_languages * BUCKETS rows
    counts[found["l"], found["b"]] = found["n"]
    counts += 0.5
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)))


def text_scores(rows: DataFrame, model: Model, temper: float) -> DataFrame:
    """``rows`` with ``text`` replaced by ``score`` (tempered log likelihoods), ``p`` (text-only posteriors) and ``lift``.

    ``lift``: the best mean log likelihood of a trigram over that of an even spread; null without trigrams.
    """
    keep = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        log_p = model.log_p
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, first = trigrams(part.column("text"))
                n = np.diff(first)
                score = np.zeros((len(n), len(log_p)))
                for i, row in enumerate(log_p):
                    sums = np.concatenate([[0.0], np.cumsum(row[bucket])])
                    score[:, i] = sums[first[1:]] - sums[first[:-1]]
                lift = (score.max(1) / np.maximum(n, 1) + np.log(BUCKETS)) if len(log_p) else np.zeros(len(n))
                score = score * temper
                p = np.exp(score - score.max(1, keepdims=True)) if len(log_p) else score
                p /= np.maximum(p.sum(1, keepdims=True), 1e-300)

                def arrays(m):
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype="i4") * m.shape[1]), pa.array(m.ravel()))

                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [arrays(score), arrays(p), pa.array(lift, mask=n == 0)], names=[*keep, "score", "p", "lift"])

    return rows.select(*keep, "text").mapInArrow(released(run), f"{kinds}, score array<double>, p array<double>, lift double")


def _summed(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """Posterior mass per language of each group, as array ``n``."""
    sums = rows.where("lift is not null").groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)])
    return sums.select(*by, F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) for i in range(k)]).alias("n"))


def _total(n: Column) -> Column:
    return F.aggregate(n, F.lit(0.0), lambda a, x: a + x)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _likelihood(rows: DataFrame, k: int, by: str, whole: list[float]) -> DataFrame:
    """(by, e): log P(value | language) with add-one smoothing over the values met."""
    sums = stored(_summed(rows.where(F.col(by).isNotNull()), k, by), by)
    values = sums.count()
    logs = [F.log((F.col("n")[i] + 1.0) / (whole[i] + values)) for i in range(k)]
    return stored(sums.select(by, F.array(*logs).alias(f"e_{by}")), f"e_{by}")


def _prior(rows: DataFrame, whole: list[float], strength: float) -> DataFrame:
    """(domain, host, e_host): log prior of the host, smoothed towards its domain and that towards the whole."""
    k = len(whole)
    base = [(n + 1.0) / (sum(whole) + k) for n in whole]

    def smooth(n: Column, up: list) -> Column:
        return F.array(*[(n[i] + strength * up[i]) / (_total(n) + strength) for i in range(k)])

    hosts = stored(_summed(rows.where("host is not null"), k, "domain", "host"), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(F.col("n")[i]).alias(f"d{i}") for i in range(k)])
    domains = domains.select("domain", smooth(F.array(*[F.col(f"d{i}") for i in range(k)]), [F.lit(b) for b in base]).alias("up"))
    priors = hosts.join(domains, "domain").select("domain", "host", smooth(F.col("n"), [F.col("up")[i] for i in range(k)]).alias("q"))
    return stored(priors.select("domain", "host", F.transform("q", lambda x: F.log(x)).alias("e_host")), "priors")


def identify(rows: DataFrame, model: Model, temper: float = 0.05, strength: float = 20.0, least: float = 0.5) -> DataFrame:
    """``rows`` (text, declared, suffix, domain, host and any others) -> the others, lang, posterior, text_lang, rejected."""
    evidence = ["declared", "suffix", "domain", "host"]
    others = [c for c in rows.columns if c not in ["text", *evidence]]
    k = len(model.languages)
    if not k:
        return rows.select(*others, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("rejected"))
    scored = stored(text_scores(rows, model, temper), "scored")
    whole = _summed(scored.withColumn("all", F.lit(1)), k, "all").first()
    whole = list(whole["n"]) if whole else [0.0] * k
    out = scored
    for by in ("declared", "suffix"):
        out = out.join(_bounded(_likelihood(scored, k, by, whole)), by, "left")
    base = F.array(*[F.log(F.lit((n + 1.0) / (sum(whole) + k))) for n in whole])
    out = out.join(_bounded(_prior(scored, whole, strength)), ["domain", "host"], "left")
    none = F.array(*[F.lit(0.0)] * k)
    parts = [F.col("score"), F.coalesce("e_declared", none), F.coalesce("e_suffix", none), F.coalesce("e_host", base)]
    out = out.withColumn("s", F.array(*[sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(k)]))
    top = F.array_max("s")
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumns({
        "posterior": 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top)),
        "best": F.get(names, F.array_position("s", top).cast("int") - 1),
        "text_lang": F.when(F.col("lift").isNotNull(), F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1))})
    rejected = F.col("lift").isNull() | (F.col("lift") < 0) | (F.col("posterior") < least)
    return out.select(*others, F.when(~rejected, F.col("best")).alias("lang"), "posterior", "text_lang", rejected.alias("rejected"))


def of_documents(docs: DataFrame, *others: str | Column) -> DataFrame:
    """Documents as evidence: ``lang`` is the declared language, ``source`` the host (with no domain above it)."""
    return docs.select(*others, F.col("text").alias("text"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.when(F.col("source").isNotNull(), F.lit("")).alias("domain"), F.col("source").alias("host"))


def of_pages(pages: DataFrame, *others: str | Column) -> DataFrame:
    """Web pages as evidence: text without markup, the html element's lang, and the address cut in suffix, domain and host."""
    host = F.lower(F.regexp_extract(text_of("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    html = text_of("html")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return pages.select(
        *others, text.alias("text"), F.when(declared != "", F.lower(declared)).alias("declared"),
        F.when(host != "", F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        F.when(host != "", F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]+)$", 0)).alias("domain"),
        F.when(host != "", host).alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    gone = identify(of_documents(keyed_rows(docs.select("text", "lang", "source"), "k"), "k"), fit(docs)).where("rejected").select("k")
    rows = keyed_rows(docs.select(F.struct("*").alias("row")), "k")
    return rows.join(gone, "k", "left_anti").select("row.*")
