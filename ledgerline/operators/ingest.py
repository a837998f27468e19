"""Ingest transforms C1–C18: header and value normalisation, enrichment,
calendar, material-group rules and the GST split.

Header work (C1, C2, C14, C17) is schema logic on ``df.columns`` and runs on
the driver with no job. Every row transform is a native Column expression,
so a whole pipeline compiles into one whole-stage-codegen span per scan; the
two lookups (customer master, city map) are joins whose build side is either
fixed-size (broadcast) or left to AQE's measured-size broadcast decision.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..fixed_values import (
    CITY_PLACEHOLDER, CITY_STATE_MAP, EXCLUDE_KEYWORDS, FY_UNKNOWN, HEADER_SYNONYMS, HOME_STATE,
    INTRA_STATE_EXTRA, MATERIAL_GROUP_MAPPINGS, PREFERRED_ORDER, REGION_COLUMNS, STALE_TAX_COLUMNS,
    STATE_PLACEHOLDER, TAX_RATE,
)
from ..functions.scalars import fy_label, fy_start, month_label, month_start, regex_any, strip


# ---------------------------------------------------------------- C1, C2
def normalise_header(name: str) -> str:
    """Strip, upper case, drop dots, spaces to underscores."""
    return name.strip().upper().replace(".", "").replace(" ", "_")


def synonym_renames(columns: Iterable[str], synonyms=HEADER_SYNONYMS) -> dict[str, str]:
    """The rename map, evaluated column by column in order.

    For each column the *first* rule whose substrings match decides (later rules
    are not tried); it renames only if the target name is not present yet.
    ITEMNAME never takes a ``GROUP`` column; INVOICE_NO also takes an exact
    ``NO`` and never a ``DATE`` column.
    """
    current = list(columns)
    renames: dict[str, str] = {}
    for i, col in enumerate(list(current)):
        cu = col.upper()
        for target, words in synonyms:
            hit = any(w in cu for w in words)
            if target == "INVOICE_NO":
                hit = hit or cu in ("NO", "NO.")
            if not hit:
                continue
            allowed = target not in current
            if target == "ITEMNAME":
                allowed = allowed and "GROUP" not in cu
            if target == "INVOICE_NO":
                allowed = allowed and "DATE" not in cu
            if allowed:
                renames[col] = target
                current[i] = target
            break
    return renames


def standardize_headers(df: DataFrame, synonyms=HEADER_SYNONYMS) -> DataFrame:
    """C1 + C2 in one projection. Duplicate names after renaming raise."""
    names = [normalise_header(c) for c in df.columns]
    ren = synonym_renames(names, synonyms)
    final = [ren.get(n, n) for n in names]
    dup = sorted({n for n in final if final.count(n) > 1})
    if dup:
        raise ValueError(f"duplicate columns after header normalisation: {dup}")
    return df.toDF(*final)


# ---------------------------------------------------------------- C3, C4
def upper_strings(df: DataFrame) -> DataFrame:
    """Every string column stripped (NBSP and tabs too) and upper-cased."""
    return df.select(*[
        F.upper(strip(F.col(f.name))).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def coalesce_state(df: DataFrame, placeholder: str = STATE_PLACEHOLDER) -> DataFrame:
    """C4: fill blank / "NOT FOUND" STATE from REGION, PROVINCE, TERRITORY in
    that order, drop those columns, blank -> placeholder (whitespace stripped
    the way Python's ``str.strip`` does: tabs and NBSP too)."""
    regions = [c for c in REGION_COLUMNS if c in df.columns]
    if not regions:
        if M.STATE not in df.columns:
            return df.withColumn(M.STATE, F.lit(placeholder))
        s = strip(F.coalesce(F.col(M.STATE), F.lit("")))
        return df.withColumn(M.STATE, F.when(s == "", F.lit(placeholder)).otherwise(s))
    state = (F.col(M.STATE) if M.STATE in df.columns
             else strip(F.coalesce(F.col(regions[0]).cast("string"), F.lit(""))))
    for rc in regions:
        need = _blank(state) | F.coalesce(F.upper(state).contains("NOT FOUND"), F.lit(False))
        state = F.when(need, strip(F.coalesce(F.col(rc).cast("string"), F.lit("")))).otherwise(state)
    state = strip(F.coalesce(state, F.lit("")))
    state = F.when(state == "", F.lit(placeholder)).otherwise(state)
    return df.withColumn(M.STATE, state).drop(*regions)


# ---------------------------------------------------------------- C5, C6
def dedupe_master(master: DataFrame) -> DataFrame:
    """One master row per CUSTOMER_NAME: the smallest (STATE, CITY), non-NULL first.

    The reference fans out on duplicate master keys; we pick deterministically
    and ``master_duplicates`` reports what was dropped.
    """
    cols = [c for c in (M.STATE, M.CITY) if c in master.columns]
    key = F.struct(*[x for c in cols for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])
    return (master.groupBy(M.CUSTOMER).agg(F.min(key).alias("m"))
                  .select(M.CUSTOMER, *[F.col(f"m.{c}").alias(c) for c in cols]))


def master_duplicates(master: DataFrame) -> DataFrame:
    return master.groupBy(M.CUSTOMER).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def enrich_customers(df: DataFrame, master: DataFrame, keep: str = "geo") -> DataFrame:
    """Left join on CUSTOMER_NAME; master STATE/CITY win, raw is fallback.

    ``keep='all'`` also carries the master's other columns (legacy). The join is
    NULL-safe (a NULL customer matches a NULL master key, as a pandas merge does).
    The master is not broadcast by hint: its size grows with customers, so
    AQE broadcasts it only when its measured size is under the threshold.
    """
    if M.CUSTOMER not in df.columns or M.CUSTOMER not in master.columns:
        return df
    geo = [c for c in (M.STATE, M.CITY) if c in master.columns]
    if not geo:
        return df
    m = dedupe_master(master)
    extra = []
    if keep == "all":
        extra = [c for c in master.columns if c not in (M.CUSTOMER, M.STATE, M.CITY) and c not in df.columns]
        if extra:
            first = master.groupBy(M.CUSTOMER).agg(*[F.min(c).alias(c) for c in extra])
            m = m.join(first, m[M.CUSTOMER].eqNullSafe(first[M.CUSTOMER]), "left").drop(first[M.CUSTOMER])
    m = m.select(F.col(M.CUSTOMER).alias("__mkey"), *[F.col(c).alias(f"__m_{c}") for c in geo],
                 *[F.col(c) for c in extra])
    j = df.join(m, df[M.CUSTOMER].eqNullSafe(m["__mkey"]), "left")
    out = j
    for c in geo:
        out = out.withColumn(c, F.coalesce(F.col(f"__m_{c}"), F.col(c)) if c in df.columns else F.col(f"__m_{c}"))
    return out.drop("__mkey", *[f"__m_{c}" for c in geo])


def city_map_frame(spark, pairs=CITY_STATE_MAP) -> DataFrame:
    return spark.createDataFrame(pairs, "CITY_KEY string, MAPPED_STATE string")


def fill_state_from_city(df: DataFrame, city_map: DataFrame | None = None,
                         placeholder: str = STATE_PLACEHOLDER) -> DataFrame:
    """When STATE is NULL, blank or "NOT FOUND", look the upper-cased trimmed
    CITY up in the map; an unknown city gives the placeholder.

    ``city_map`` has columns (CITY_KEY, MAPPED_STATE); the default is the fixed
    31-entry table, broadcast (bounded size).
    """
    if city_map is None:
        city_map = city_map_frame(df.sparkSession)
    if M.STATE not in df.columns:
        df = df.withColumn(M.STATE, F.lit(None).cast("string"))
    if M.CITY not in df.columns:
        return df.withColumn(M.STATE, F.coalesce(F.col(M.STATE), F.lit(placeholder)))
    cm = F.broadcast(city_map.select(F.col("CITY_KEY").alias("__ck"), F.col("MAPPED_STATE").alias("__ms")))
    key = F.upper(strip(F.col(M.CITY).cast("string")))
    j = df.withColumn("__ck_in", key).join(cm, F.col("__ck_in") == F.col("__ck"), "left")
    s = F.col(M.STATE)
    need = s.isNull() | (F.trim(s) == "") | F.upper(s).contains("NOT FOUND")
    return (j.withColumn(M.STATE, F.when(need, F.coalesce(F.col("__ms"), F.lit(placeholder))).otherwise(s))
             .drop("__ck_in", "__ck", "__ms"))


# ---------------------------------------------------------------- C7–C10
# FIXED VALUES: accepted date formats for text dates, tried in order; between them the ones with
# figures only, whose order of day and month is a parameter (month first by default).
ISO_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]
MONTH_FIRST = ["M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "M-d-yyyy HH:mm:ss", "M-d-yyyy", "M.d.yyyy", "M/d/yy"]
DAY_FIRST = ["d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy HH:mm:ss", "d-M-yyyy", "d.M.yyyy", "d/M/yy"]
NAMED_FORMATS = ["d-MMM-yyyy", "d MMM yyyy", "d-MMM-yy", "d MMM yy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy"]


def date_formats(day_first: bool = False) -> list[str]:
    """All formats; figures read in the preferred order, and in the other one where that gives no date."""
    first, second = (DAY_FIRST, MONTH_FIRST) if day_first else (MONTH_FIRST, DAY_FIRST)
    return [*ISO_FORMATS, *first, *second, *NAMED_FORMATS]


def parse_date(c, formats: list[str] | None = None, day_first: bool = False) -> Column:
    """Text -> timestamp, unparsable -> NULL (never raises; ``unparsed_dates`` counts them)."""
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats or date_formats(day_first)])


def unparsed_dates(df: DataFrame, date_col: str = M.DATE, day_first: bool = False) -> DataFrame:
    """One row: non-blank text dates, and how many of them no format reads."""
    text = F.trim(F.col(date_col)) != ""
    bad = text & parse_date(date_col, day_first=day_first).isNull()
    return df.agg(F.count(F.when(text, 1)).alias("dates"), F.count(F.when(bad, 1)).alias("unparsed"))


def add_calendar(df: DataFrame, date_col: str = M.DATE) -> DataFrame:
    """DATE as timestamp (text parsed, bad -> NULL), FINANCIAL_YEAR,
    MONTH labels and the sortable ``fy_start`` / ``month_start``."""
    if date_col not in df.columns:
        return df
    dt = df.schema[date_col].dataType
    d = parse_date(F.col(date_col)) if isinstance(dt, T.StringType) else F.col(date_col).cast("timestamp")
    out = df.withColumn(date_col, d)
    d = F.col(date_col)
    return (out.withColumn(M.FY, F.when(d.isNull(), F.lit(FY_UNKNOWN)).otherwise(fy_label(d)))
               .withColumn(M.MONTH, month_label(d))
               .withColumn(M.FY_START, fy_start(d))
               .withColumn(M.MONTH_START, month_start(d)))


def default_columns(df: DataFrame) -> DataFrame:
    """CITY / STATE placeholders when the columns are absent."""
    if M.CITY not in df.columns:
        df = df.withColumn(M.CITY, F.lit(CITY_PLACEHOLDER))
    if M.STATE not in df.columns:
        df = df.withColumn(M.STATE, F.lit(STATE_PLACEHOLDER))
    return df


# ---------------------------------------------------------------- C11, C12
def map_groups(df: DataFrame, rules=MATERIAL_GROUP_MAPPINGS, col: str | None = None) -> DataFrame:
    """C11: ordered case-insensitive regex rules; a match replaces the whole
    value and later rules see the result. NULL never matches."""
    col = col or M.material_group_col(df)
    if col is None:
        return df
    # one projection per rule: nesting the rules in one expression would repeat
    # the earlier regexes in every later branch (2^rules evaluations)
    for pattern, replacement in rules:
        c = F.col(col)
        df = df.withColumn(col, F.when(F.coalesce(c.rlike("(?i)" + pattern), F.lit(False)), F.lit(replacement)).otherwise(c))
    return df


def group_norm(c: Column) -> Column:
    """NBSP -> space, whitespace runs collapsed, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " ")))


def exclude_groups(df: DataFrame, keywords=EXCLUDE_KEYWORDS, col: str | None = None) -> DataFrame:
    """Drop rows whose normalised group contains any keyword (substring,
    case-insensitive, one alternation regex); NULL groups are kept."""
    col = col or M.material_group_col(df)
    if col is None or not keywords:
        return df
    pattern = "(?i)(" + regex_any(keywords) + ")"
    return df.where(~F.coalesce(group_norm(F.col(col)).rlike(pattern), F.lit(False)))


# ---------------------------------------------------------------- C13, C14
def add_taxes(df: DataFrame, home_state: str = HOME_STATE, rate: str = TAX_RATE) -> DataFrame:
    """Drop stale tax columns, then the GST split.

    Intra-state (home state, UNKNOWN, STATE NOT FOUND after upper/trim,
    NULL -> Unknown): CGST = SGST = AMOUNT * rate/2; otherwise IGST = AMOUNT * rate.
    Money stays decimal (rate is an exact decimal literal).
    """
    if M.AMOUNT not in df.columns:
        return df
    df = df.drop(*[c for c in STALE_TAX_COLUMNS if c in df.columns])
    st = (F.upper(F.trim(F.coalesce(F.col(M.STATE), F.lit("Unknown")))) if M.STATE in df.columns
          else F.lit("UNKNOWN"))
    intra = st.isin([home_state.upper().strip(), *INTRA_STATE_EXTRA])
    from decimal import Decimal

    r = F.lit(Decimal(rate))
    half = F.lit(Decimal(rate) / 2)
    amt = F.col(M.AMOUNT)
    zero = F.lit(Decimal("0"))
    out = (df.withColumn("IGST", F.when(intra, zero).otherwise(amt * r))
             .withColumn("CGST", F.when(intra, amt * half).otherwise(zero))
             .withColumn("SGST", F.when(intra, amt * half).otherwise(zero)))
    out = out.withColumn("TAX", F.col("IGST") + F.col("CGST") + F.col("SGST"))
    return out.withColumn("TOTALAMOUNT", amt + F.col("TAX"))


# ---------------------------------------------------------------- C15–C17
def surrogate_invoice(df: DataFrame) -> DataFrame:
    """When the column is absent, each line is an invoice of its own.

    The number is the hash of the row and its number among equal rows, so
    identical lines stay apart and a re-read upload gets the same numbers. The
    window is per (row hash, part of the input), counted up by the parts before:
    equal rows that make up a third of the upload are numbered part by part.
    Rows are dealt to as many tasks as they ask for.
    """
    if M.INVOICE_NO in df.columns:
        return df
    cols = [F.col(f"`{c}`") for c in df.columns]
    from ..plans.common import materialize, tasks_for

    rows = materialize(df.select(*cols, F.xxhash64(*cols).alias("__hash"), F.monotonically_increasing_id().alias("__at")))
    n = tasks_for(df.sparkSession, rows.count())
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).repartition(n, "__hash", "__part")
    parts = rows.groupBy("__hash", "__part").agg(F.count(F.lit(1)).alias("__n")).repartition(n, "__hash")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__hash").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("__hash", "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__hash", "__part").orderBy("__at")) + F.col("__before")
    out = rows.join(offsets, ["__hash", "__part"]).withColumn(M.INVOICE_NO, F.concat_ws("-", F.col("__hash").cast("string"), nth.cast("string")))
    return out.select(*cols, M.INVOICE_NO)


def tag_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """C16."""
    return df.withColumn(M.TENANT, F.lit(tenant_id))


def order_columns(df: DataFrame, preferred=PREFERRED_ORDER) -> DataFrame:
    """C17: preferred columns first (those present), then the rest in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


# ---------------------------------------------------------------- C18
@dataclass(frozen=True)
class IngestConfig:
    home_state: str = HOME_STATE
    tax_rate: str = TAX_RATE
    mappings: list = field(default_factory=lambda: list(MATERIAL_GROUP_MAPPINGS))
    keywords: list = field(default_factory=lambda: list(EXCLUDE_KEYWORDS))
    master_keep: str = "geo"
    normalise_values: bool = False


def ingest(raw: DataFrame, master: DataFrame | None = None, cfg: IngestConfig = IngestConfig(),
           city_map: DataFrame | None = None, coerce=None, tenant_id: str | None = None) -> DataFrame:
    """C18, API order: headers -> (type coercion for text uploads) -> state
    coalesce -> master -> city fallback -> calendar -> defaults -> map ->
    exclude -> taxes. One lazy plan. ``tenant_id`` (C16) replaces a tenant column of the upload."""
    df = standardize_headers(raw)
    if tenant_id is not None:
        df = tag_tenant(df.drop(*[c for c in df.columns if c.upper() == M.TENANT.upper()]), tenant_id)
    if coerce is not None:
        df = coerce(df)
    if cfg.normalise_values:
        df = upper_strings(df)
    df = coalesce_state(df)
    if master is not None:
        df = enrich_customers(df, master, cfg.master_keep)
    if city_map is not None:
        df = fill_state_from_city(df, city_map)
    df = add_calendar(df)
    df = default_columns(df)
    df = map_groups(df, cfg.mappings)
    df = exclude_groups(df, cfg.keywords)
    return add_taxes(df, cfg.home_state, cfg.tax_rate)
