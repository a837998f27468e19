"""Data model: canonical column names and schema-level column resolution.

Column resolution is pure schema logic on ``df.columns`` (driver side, no job).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .fixed_values import MATERIAL_GROUP_CANDIDATES

DATE = "DATE"
INVOICE_NO = "INVOICE_NO"
CUSTOMER = "CUSTOMER_NAME"
ITEM = "ITEMNAME"
ITEM_GROUP = "ITEM_NAME_GROUP"
MATERIAL = "MATERIALGROUP"
CITY = "CITY"
STATE = "STATE"
QTY = "QTY"
AMOUNT = "AMOUNT"
TENANT = "tenant_id"
FY = "FINANCIAL_YEAR"
MONTH = "MONTH"
FY_START = "fy_start"
MONTH_START = "month_start"

# Money is exact decimal inside the engine and double only at the edge.
MONEY = T.DecimalType(26, 4)

SALES_SCHEMA = T.StructType([
    T.StructField(DATE, T.TimestampNTZType()),
    T.StructField(INVOICE_NO, T.StringType()),
    T.StructField(CUSTOMER, T.StringType()),
    T.StructField(ITEM, T.StringType()),
    T.StructField(ITEM_GROUP, T.StringType()),
    T.StructField(MATERIAL, T.StringType()),
    T.StructField(CITY, T.StringType()),
    T.StructField(STATE, T.StringType()),
    T.StructField(QTY, T.DoubleType()),
    T.StructField(AMOUNT, MONEY),
    T.StructField(TENANT, T.StringType()),
])


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_ci(df: DataFrame, name: str) -> str | None:
    """Case-insensitive column lookup (AMOUNT / DATE may arrive lower case)."""
    return next((c for c in df.columns if c.upper() == name.upper()), None)


def material_group_col(df: DataFrame) -> str | None:
    """First present of the material-group candidates (filters, mapping, exclusion)."""
    return next((c for c in MATERIAL_GROUP_CANDIDATES if c in df.columns), None)


def dashboard_group_col(df: DataFrame) -> str:
    """Dashboards use ITEM_NAME_GROUP when present, else MATERIALGROUP."""
    return ITEM_GROUP if ITEM_GROUP in df.columns else MATERIAL


def item_col(df: DataFrame) -> str:
    return ITEM if ITEM in df.columns else MATERIAL


def qty_col(df: DataFrame) -> str | None:
    if "QTY" in df.columns:
        return "QTY"
    if "QUANTITY" in df.columns:
        return "QUANTITY"
    return None


def city_col(df: DataFrame) -> str:
    return CITY if CITY in df.columns else STATE


@dataclass(frozen=True)
class Filters:
    """The filter set every report takes (Python lists, so names may contain commas)."""

    tenant_id: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    states: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    customers: list[str] = field(default_factory=list)
    material_groups: list[str] = field(default_factory=list)
    fiscal_years: list[str] = field(default_factory=list)
    months: list[str] = field(default_factory=list)
