"""Scalar Column functions (M1–M4). All native expressions, codegen-friendly."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CRORE, FY_UNKNOWN, LAKH, THOUSAND

_EDGE_WS = r"^[\s ]+|[\s ]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Strip edge whitespace including NBSP and tabs (``trim`` removes only spaces)."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def norm_upper(c) -> Column:
    return F.upper(strip(c))


def fy_start(date) -> Column:
    """First calendar year of the April–March fiscal year."""
    d = _c(date)
    return (F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)).cast("int")


def fy_label(date) -> Column:
    """``FY{yy}-{yy+1}`` without zero padding; NULL date -> UNKNOWN."""
    s = fy_start(date)
    label = F.concat(F.lit("FY"), (s % 100).cast("string"), F.lit("-"), ((s + 1) % 100).cast("string"))
    return F.when(_c(date).isNull(), F.lit(FY_UNKNOWN)).otherwise(label)


def month_label(date) -> Column:
    """Upper-case ``MMM-yy`` label, e.g. APR-24."""
    return F.upper(F.date_format(_c(date), "MMM-yy"))


def month_start(date) -> Column:
    return F.trunc(F.to_date(_c(date)), "month")


def inr(c, prefix: str = "₹", dp: int = 2, thousand_dp: int | None = None, by_magnitude: bool = False) -> Column:
    """M1: Indian currency text — Cr / L / K with ``dp`` decimals (``thousand_dp`` for K)
    at or above 1 000, a grouped whole number below. ``by_magnitude`` scales negative
    amounts too; else they are written out. Scaling multiplies exact decimals, so
    rounding is half-up on the exact value."""
    v = _c(c).cast("decimal(20,4)")
    size = F.abs(v) if by_magnitude else v
    sym = f"{prefix} " if prefix else ""

    def unit(scale: int, suffix: str, places: int) -> Column:
        factor = F.lit(Decimal(1) / Decimal(scale)).cast("decimal(9,8)")
        return F.concat(F.lit(sym), F.round(v * factor, places).cast(f"decimal(38,{places})").cast("string"), F.lit(f" {suffix}"))

    small = F.concat(F.lit(sym), F.format_number(F.round(v, 0), 0))
    return (F.when(size >= CRORE, unit(CRORE, "Cr", dp))
            .when(size >= LAKH, unit(LAKH, "L", dp))
            .when(size >= THOUSAND, unit(THOUSAND, "K", dp if thousand_dp is None else thousand_dp))
            .otherwise(small))


def inr_signed(c) -> Column:
    """M1 for documents: "Rs.", scaled by magnitude with the sign kept, one decimal for K."""
    return inr(c, "Rs.", thousand_dp=1, by_magnitude=True)


def inr_compact(c) -> Column:
    """M1 for chart axes: the magnitude without currency, one decimal for Cr and L, none for K."""
    return inr(F.abs(_c(c)), "", dp=1, thousand_dp=0)


def regex_literal(word: str) -> str:
    """Escape regex metacharacters only (spaces stay plain, valid in Java and RE2)."""
    import re

    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", word)


def regex_any(words: list[str]) -> str:
    """One alternation regex over literal words."""
    return "|".join(regex_literal(w) for w in words)


def json_text(*columns: str) -> Column:
    """M5: the columns as one JSON object, NULLs kept, timestamps as ISO text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": iso, "timestampNTZFormat": iso})
