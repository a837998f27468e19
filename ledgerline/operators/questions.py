"""Question answering L1–L3, re-aimed as batch jobs over a table of questions.

L1 links entities: every question is cut into lower-case 1–4-word n-grams
(edge punctuation stripped), equi-joined to a dictionary of dimension values
built from the fact, and the longest, earliest n-gram wins per column.
L2 reads intent (metric, top-k or total, group dimension) from keywords.
L3 answers all questions together. What they need are sums of the fact over a
bounded set of column sets (the filters a question sets, plus the dimension it
ranks): all of them are made by one aggregation with GROUPING SETS, partial
sums first, so lines are never shuffled by a filter value. Ranks are computed
per filter value once, for all questions that share it, and joined to the
questions by rank: no list is collected, and k may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..plans.common import materialize, running_sum, tasks_for, with_total

# FIXED VALUES: n-gram lengths, edge punctuation, year pattern, intent keywords.
MAX_NGRAM = 4
EDGE_PUNCT = "?,.!:"
QUESTION_GRAMS = 32  # n-grams of a question, about
SALTS = 8  # places that the rows of one n-gram are dealt to
YEAR_PATTERN = r"\b(20\d{2})\b"
TOP_PATTERN = r"top (\d+)"
DEFAULT_K = 5
MAX_K = (1 << 63) - 1
# Lists deeper than this are ranked by range partitions instead of a window per filter value.
WINDOW_K = 10_000
QTY_WORDS = ["quantity", "qty", "volume", "units"]
ORDER_WORDS = ["count", "orders", "invoices"]
TOP_WORDS = ["top", "best"]
CUSTOMER_WORDS = ["customer"]
PRODUCT_WORDS = ["product", "item"]
STATE_WORDS = ["state", "region"]



def product_dim(fact: DataFrame) -> str:
    return M.MATERIAL if M.MATERIAL in fact.columns else M.ITEM


def dictionary(fact: DataFrame) -> DataFrame:
    """(key, column, value): lower-cased distinct values of STATE, CUSTOMER_NAME
    and the product column. An equal key in a later column replaces an earlier
    one (product > customer > state); case variants inside one column resolve
    to the smallest value."""
    prod = product_dim(fact)
    parts = []
    for prio, (col, name) in enumerate([(M.STATE, M.STATE), (M.CUSTOMER, M.CUSTOMER), (prod, "PRODUCT")]):
        if col in fact.columns:
            parts.append(fact.where(F.col(col).isNotNull()).select(
                F.lower(F.col(col).cast("string")).alias("key"), F.lit(name).alias("column"),
                F.col(col).cast("string").alias("value"), F.lit(prio).alias("prio")).distinct())
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    best = F.min_by(F.struct("column", "value"), F.struct(-F.col("prio"), F.col("value")))
    return d.groupBy("key").agg(best.alias("b")).select("key", "b.column", "b.value")


def _words(text: Column) -> Column:
    """Whitespace split as Python's ``str.split()`` does (NBSP too; no empties)."""
    return F.filter(F.split(F.trim(F.lower(text)), r"[\s ]+"), lambda w: w != "")


def ngrams(questions: DataFrame) -> DataFrame:
    """(q_id, pos, len, chunk) for every 1..4-word window, edge punctuation stripped."""
    w = questions.select("q_id", _words(F.col("text")).alias("words"))
    w = w.select("q_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("pos"))
    w = w.select("q_id", "words", "pos", F.explode(F.sequence(F.lit(1), F.lit(MAX_NGRAM))).alias("len"))
    w = w.where(F.col("pos") + F.col("len") <= F.size("words"))
    edge = "[" + "".join("\\" + c for c in EDGE_PUNCT) + "]+"
    chunk = F.array_join(F.slice("words", F.col("pos") + 1, F.col("len")), " ")
    return w.select("q_id", "pos", "len", F.regexp_replace(chunk, f"^{edge}|{edge}$", "").alias("chunk"))


def link_entities(questions: DataFrame, dictionary_df: DataFrame) -> DataFrame:
    """L1: (q_id, column, value), one per (question, column): the longest n-gram
    first, then the earliest; plus YEAR from the first ``20\\d\\d`` token.

    N-grams and links are dealt to as many tasks as the questions ask for, and n-grams that most questions hold
    ("top 3") to ``SALTS`` places, each with its copy of the dictionary."""
    asked = questions.count()
    n = tasks_for(questions.sparkSession, asked * QUESTION_GRAMS)
    salt = F.pmod(F.xxhash64("q_id"), F.lit(SALTS)).cast("int")
    grams = ngrams(questions).withColumn("__salt", salt).repartition(n, "chunk", "__salt")
    keys = dictionary_df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(n, "key", "__salt")
    g = grams.join(keys, (grams["chunk"] == keys["key"]) & (grams["__salt"] == keys["__salt"])).select("q_id", "pos", "len", "column", "value")
    g = g.repartition(tasks_for(questions.sparkSession, asked * MAX_NGRAM), "q_id")
    w = Window.partitionBy("q_id", "column").orderBy(F.col("len").desc(), F.col("pos").asc())
    ents = g.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).select("q_id", "column", "value")
    year = questions.select("q_id", F.regexp_extract(F.lower(F.col("text")), YEAR_PATTERN, 1).alias("value"))
    year = year.where(F.col("value") != "").select("q_id", F.lit("YEAR").alias("column"), "value")
    return ents.unionByName(year)


def _has_any(text: Column, words: list[str]) -> Column:
    c = None
    for w in words:
        x = text.contains(w)
        c = x if c is None else c | x
    return c


def parse_intent(questions: DataFrame, product_column: str = M.MATERIAL) -> DataFrame:
    """L2: metric (QTY / INVOICE_NO / AMOUNT), shape (top / total), k, dimension."""
    t = F.lower(F.trim(F.col("text")))
    metric = (F.when(_has_any(t, QTY_WORDS), M.QTY).when(_has_any(t, ORDER_WORDS), M.INVOICE_NO)
               .otherwise(M.AMOUNT))
    shape = F.when(_has_any(t, TOP_WORDS), "top").otherwise("total")
    kx = F.regexp_extract(t, TOP_PATTERN, 1)
    # a number beyond 64 bits asks for everything there is
    k = F.when(kx != "", F.coalesce(kx.try_cast("bigint"), F.lit(MAX_K))).otherwise(F.lit(DEFAULT_K))
    dim = (F.when(_has_any(t, CUSTOMER_WORDS), M.CUSTOMER).when(_has_any(t, PRODUCT_WORDS), product_column)
            .when(_has_any(t, STATE_WORDS), M.STATE).otherwise(M.CUSTOMER))
    return questions.select("q_id", metric.alias("metric"), shape.alias("shape"),
                            F.when(shape == "top", k).alias("k"), F.when(shape == "top", dim).alias("dim"))


def specs(questions: DataFrame, fact: DataFrame) -> DataFrame:
    """One row per question: intent plus the linked filter values as columns."""
    prod = product_dim(fact)
    links = link_entities(questions, dictionary(fact))
    piv = links.groupBy("q_id").pivot("column", [M.STATE, M.CUSTOMER, "PRODUCT", "YEAR"]).agg(F.first("value"))
    return parse_intent(questions, prod).join(piv, "q_id", "left")


SHARED = ["__state", "__customer", "__product", "__year"]


def _sums(fact: DataFrame, sets: list[tuple[str, ...]], invoices: bool) -> DataFrame:
    """Sums of the fact over each set of ``SHARED`` columns, one aggregation; ``gid`` tells the sets apart."""
    prod = product_dim(fact)
    f = fact.select(F.col(M.STATE).cast("string").alias("__state"), F.col(M.CUSTOMER).cast("string").alias("__customer"),
                    F.col(prod).cast("string").alias("__product"), F.year(M.DATE).cast("string").alias("__year"), M.AMOUNT, M.QTY, M.INVOICE_NO)
    aggs = ([F.count_distinct(M.INVOICE_NO).cast("double").alias(M.INVOICE_NO)] if invoices else
            [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in (M.AMOUNT, M.QTY)])
    rows = F.count(F.lit(1)).alias("__n")  # the set of no columns has a row even over no lines
    return f.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in SHARED]).agg(*aggs, rows, F.grouping_id().alias("gid")).where("__n > 0")


def _gid(columns: tuple[str, ...]) -> int:
    return sum(1 << (len(SHARED) - 1 - i) for i, c in enumerate(SHARED) if c not in columns)


def _ranked(g: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """``g`` (keys, name, value) with ``rank`` per keys (value desc, name asc), down to ``deepest``."""
    if deepest > WINDOW_K:
        return running_sum(g, "value", "name", None, "rank", partition_cols=tuple(keys)).where(F.col("rank") <= deepest)
    order = [F.col("value").desc(), F.col("name").asc()]
    if not keys:
        top = g.orderBy(*order).limit(deepest)  # at most WINDOW_K rows
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= deepest)


def answer(questions: DataFrame, fact: DataFrame) -> DataFrame:
    """L3: (q_id, rank, name, value). Top-k questions give k ranked rows; totals
    give one row ranked 1 named 'Total'; a question whose filters match no
    fact row gives one row ranked 0 named 'NO DATA' with a NULL value.

    The distinct signatures (filters set, metric, shape, dimension) are
    collected to plan the sets: at most 2^4 x 3 x 2 x 3, a handful in practice."""
    prod = product_dim(fact)
    filters = dict(zip([M.STATE, M.CUSTOMER, "PRODUCT", "YEAR"], SHARED))
    of_dim = {M.STATE: "__state", M.CUSTOMER: "__customer", prod: "__product"}
    sp = materialize(specs(questions, fact).withColumnsRenamed(filters))  # the linked specs feed every branch: written once
    signature = [*[F.col(c).isNotNull().alias(f"has{c}") for c in SHARED], "metric", "shape", "dim"]
    sigs = sp.groupBy(*signature).agg(F.max("k").alias("deepest")).collect()  # bounded (see docstring)
    if not sigs:
        return questions.select("q_id", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("name"),
                                F.lit(None).cast("double").alias("value")).where(F.lit(False))

    def columns(s) -> tuple[str, ...]:
        own = {c for c in SHARED if s[f"has{c}"]} | ({of_dim[s["dim"]]} if s["dim"] else set())
        return tuple(c for c in SHARED if c in own)

    made = {}
    for invoices in (False, True):
        sets = sorted({columns(s) for s in sigs if (s["metric"] == M.INVOICE_NO) == invoices})
        if sets:
            made[invoices] = materialize(_sums(fact, sets, invoices))
    ranked = None
    for i, s in enumerate(sigs):
        keys = [c for c in SHARED if s[f"has{c}"]]
        g = made[s["metric"] == M.INVOICE_NO].where(F.col("gid") == _gid(columns(s)))
        for c in columns(s):
            g = g.where(F.col(c).isNotNull())
        name = F.col(of_dim[s["dim"]]) if s["dim"] else F.lit("Total")
        g = g.select(*keys, name.alias("name"), F.col(s["metric"]).alias("value"))
        g = _ranked(g, keys, s["deepest"]) if s["shape"] == "top" else g.withColumn("rank", F.lit(1))
        g = g.select(F.lit(i).alias("sig"), *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in SHARED],
                     F.col("rank").cast("bigint").alias("rank"), "name", "value")
        ranked = g if ranked is None else ranked.unionByName(g)
    ranked = materialize(ranked)
    longest = ranked.agg(F.coalesce(F.max("rank"), F.lit(1)).alias("__longest"))
    number = None
    for i, s in enumerate(sigs):
        own = (F.col("metric") == s["metric"]) & (F.col("shape") == s["shape"]) & F.col("dim").eqNullSafe(F.lit(s["dim"]))
        for c in SHARED:
            own &= F.col(c).isNotNull() if s[f"has{c}"] else F.col(c).isNull()
        number = F.when(own, i) if number is None else number.when(own, i)
    asked = with_total(sp.withColumn("sig", number), longest)
    last = F.greatest(F.least(F.coalesce("k", F.lit(1)), F.col("__longest")), F.lit(1))
    asked = asked.select("q_id", "sig", *SHARED, F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("rank"))
    on = [asked["sig"] == ranked["sig"], asked["rank"] == ranked["rank"], *[asked[c].eqNullSafe(ranked[c]) for c in SHARED]]
    found = asked.join(ranked, on, "left").select("q_id", asked["rank"], "name", "value")
    nodata = F.col("name").isNull()
    return found.where(~nodata | (F.col("rank") == 1)).select(
        "q_id", F.when(nodata, 0).otherwise(F.col("rank")).cast("int").alias("rank"), F.when(nodata, "NO DATA").otherwise(F.col("name")).alias("name"), "value")
