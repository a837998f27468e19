"""Filters and option lists (D1–D7, and the row filters of A3/A4/A6).

All filters are plain ``where`` clauses on fact columns, so Catalyst pushes
them into the Parquet scan (and prunes ``tenant_id=`` partitions).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..model import Filters

# FIXED VALUES: month abbreviations in calendar order (label parsing).
MONTH_ABBR = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
# FIXED VALUES: two-digit-year pivot of the label parser (69..99 -> 19xx).
YY_PIVOT = 69


def _ts(s: str) -> Column:
    return F.to_timestamp(F.lit(s))


def date_only(s: str | None) -> bool:
    """An end bound of at most 10 characters is a date and includes that whole day."""
    return s is not None and len(str(s).strip()) <= 10


def end_exclusive(end: str) -> _dt.datetime:
    return _dt.datetime.fromisoformat(end.strip()) + _dt.timedelta(days=1)


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date_col: str = M.DATE) -> DataFrame:
    """``>= start``; date-only end includes the whole day (``< end + 1 day``),
    an end with a time is inclusive (``<= end``). NULL dates drop out as soon
    as a bound is given."""
    d = F.col(date_col)
    if start:
        df = df.where(d >= _ts(str(start).strip()))
    if end:
        if date_only(end):
            df = df.where(d < F.lit(end_exclusive(end)))
        else:
            df = df.where(d <= _ts(str(end).strip()))
    return df


def rolling_years(df: DataFrame, years: int, asof: str, date_col: str = M.DATE) -> DataFrame:
    """A4: keep ``date >= asof - years``; off when ``years <= 0``."""
    if years is None or years <= 0:
        return df
    return df.where(F.col(date_col) >= F.add_months(F.to_date(F.lit(asof)), -12 * years))


def tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """A3: one tenant; a partition filter when the table is partitioned by tenant_id."""
    return df if tenant_id is None else df.where(F.col(M.TENANT) == tenant_id)


def _clean(values) -> list[str]:
    return [v.strip() for v in (values or []) if v is not None and str(v).strip()]


def fy_spellings(values) -> list[str]:
    """``FY25-26`` and ``25-26`` select the same year."""
    out: list[str] = []
    for f in _clean(values):
        out.append(f)
        if f.upper().startswith("FY") and len(f) > 2:
            out.append(f[2:].strip())
        else:
            out.append("FY" + f)
    return sorted(set(out))


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    """D1/D2 plus tenant and date bounds: exact, case-sensitive ``IN`` per
    dimension, ANDed; a filter on a column the frame lacks is ignored."""
    df = tenant(df, f.tenant_id) if M.TENANT in df.columns else df
    df = date_range(df, f.start_date, f.end_date) if M.DATE in df.columns else df
    grp = M.material_group_col(df)
    for col, values in ((M.STATE, f.states), (M.CITY, f.cities), (M.CUSTOMER, f.customers),
                        (grp, f.material_groups), (M.MONTH, f.months)):
        vals = _clean(values)
        if col is not None and col in df.columns and vals:
            df = df.where(F.col(col).isin(vals))
    fys = fy_spellings(f.fiscal_years)
    if fys and M.FY in df.columns:
        df = df.where(F.trim(F.col(M.FY)).isin(fys))
    return df


# D3: report axis -> fact column
REPORT_AXIS = {
    "customer": M.CUSTOMER, "city": M.CITY, "state": M.STATE, "material": M.ITEM,
    "group": M.ITEM_GROUP, "month": M.MONTH,
}


def entity_filter(df: DataFrame, report_type: str, entity: str | None = None, customer: str | None = None,
                  state: str | None = None, group: str | None = None) -> DataFrame:
    """D3: primary entity of the report axis plus secondary filters; "All" = none."""
    def pick(d: DataFrame, col: str | None, v: str | None) -> DataFrame:
        if v is None or v == "All" or col is None or col not in d.columns:
            return d
        return d.where(F.col(col) == v)

    df = pick(df, REPORT_AXIS.get(report_type), entity)
    df = pick(df, M.CUSTOMER, customer)
    df = pick(df, M.STATE, state)
    return pick(df, M.dashboard_group_col(df), group)


def select_entity(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """Single entity, or everything for ``None`` / ``"All ..."``."""
    if value is None or str(value).startswith("All"):
        return df
    return df.where(F.col(col) == value)


def month_label_start(label) -> Column:
    """Parse an ``MMM-yy`` label (first three letters, last two digits) to the
    first day of its month with an explicit century pivot. Spark's ``yy``
    maps every label to 20xx; the reference's parser pivots at 69."""
    lab = F.upper(F.trim(label if isinstance(label, Column) else F.col(label)))
    pos = F.instr(F.lit(MONTH_ABBR), F.substring(lab, 1, 3))
    mon = F.when((F.length(lab) >= 3) & (pos > 0) & (pos % 3 == 1), F.floor((pos - 1) / 3) + 1)
    tail = F.substring(lab, -2, 2)
    yy = F.when(tail.rlike("^[0-9]{2}$"), tail.cast("int"))
    year = F.when(yy >= YY_PIVOT, yy + 1900).otherwise(yy + 2000)
    return F.when(mon.isNotNull() & yy.isNotNull(), F.make_date(year, mon.cast("int"), F.lit(1)))


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted distinct values per dimension as rows (dim, value, ord).

    One scan: rows are first reduced to the distinct combinations of the
    dimensions (map-side partial distinct), and only these are unpivoted; a large
    customer list never lands in one task. MONTH's ``ord`` is yyyymm of the
    label; others 0 (sort by value).
    """
    grp = M.material_group_col(df)
    dims = [(M.STATE, "states"), (M.CITY, "cities"), (M.CUSTOMER, "customers"),
            (grp, "material_groups"), (M.FY, "fiscal_years"), (M.MONTH, "months")]
    dims = [(c, n) for c, n in dims if c is not None and c in df.columns]
    stacked = df.select(*[F.col(c) for c, _ in dims]).distinct().select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dim"), F.col(c).cast("string").alias("value")) for c, n in dims
    ])).alias("s")).select("s.dim", "s.value")
    up = F.upper(F.col("value"))
    keep = (F.col("value").isNotNull()
            & ~((F.col("dim") == "states") & ((F.trim(F.col("value")) == "") | up.contains("NOT FOUND")))
            & ~((F.col("dim") == "cities") & (up.contains("NOT FOUND") | up.contains("UNKNOWN"))))
    out = stacked.where(keep).distinct()
    ms = month_label_start(F.col("value"))
    ordc = F.when(F.col("dim") == "months",
                  F.coalesce(F.year(ms) * 100 + F.month(ms), F.lit(999999))).otherwise(F.lit(0))
    return out.withColumn("ord", ordc.cast("int"))


def page(df: DataFrame, term: str | None, keys: list[str], sort: str | None, ascending: bool = True,
         page_no: int = 0, size: int = 10, tiebreak: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring search over ``keys``, sort, page.

    ``offset`` + ``limit`` after a sort: the engine keeps only offset+size rows
    per partition (TakeOrderedAndProject), so a page never needs a full sort.
    """
    if term:
        t = term.lower()
        cond = None
        for k in keys:
            c = F.coalesce(F.lower(F.col(k).cast("string")).contains(t), F.lit(False))
            cond = c if cond is None else cond | c
        df = df.where(cond)
    order = []
    if sort:
        order.append(F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last())
    order += [F.col(c).asc() for c in (tiebreak or df.columns)]
    return df.orderBy(*order).offset(page_no * size).limit(size)


def preset(name: str, asof: str) -> tuple[str | None, str | None]:
    """Relative ranges as (start, end) ISO dates, end = asof (inclusive day);
    "all" (all time) has no bounds."""
    if name in ("all", "all_time"):
        return None, None
    a = _dt.date.fromisoformat(asof[:10])
    if name in ("7d", "last_7_days"):
        s = a - _dt.timedelta(days=7)
    elif name in ("30d", "last_30_days"):
        s = a - _dt.timedelta(days=30)
    elif name in ("90d", "last_90_days"):
        s = a - _dt.timedelta(days=90)
    elif name in ("ytd", "year_to_date"):
        s = _dt.date(a.year, 1, 1)
    else:
        raise ValueError(f"unknown preset {name!r}")
    return s.isoformat(), a.isoformat()
