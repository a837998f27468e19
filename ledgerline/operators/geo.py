"""Geography J1–J4: coordinates by broadcast lookup, state drill-down, summary.

Coordinate tables are fixed-size dimensions (tens of rows): broadcast joins
on a normalised name, so the fact side is never shuffled for them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..fixed_values import CITY_COORDS, CRORE, DEFAULT_COORDS, LAKH, STATE_COORDS
from ..functions.scalars import strip
from ..plans.common import keyed, top_k, with_total


def coords_frame(spark: SparkSession, rows=STATE_COORDS) -> DataFrame:
    return spark.createDataFrame(rows, "name string, lat double, lon double")


def _key(c) -> F.Column:
    return F.upper(strip(F.col(c) if isinstance(c, str) else c))


def add_state_coords(df: DataFrame, coords: DataFrame | None = None, dim: str = M.STATE,
                     default=DEFAULT_COORDS) -> DataFrame:
    """lat/lon by state name (matched on upper-cased stripped names, as
    title-casing both sides would), else the country centroid."""
    coords = coords if coords is not None else coords_frame(df.sparkSession, STATE_COORDS)
    c = F.broadcast(coords.select(_key("name").alias("__k"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon")))
    j = df.withColumn("__dk", _key(dim)).join(c, F.col("__dk") == F.col("__k"), "left")
    return (j.withColumn("lat", F.coalesce(F.col("__lat"), F.lit(float(default[0]))))
             .withColumn("lon", F.coalesce(F.col("__lon"), F.lit(float(default[1]))))
             .drop("__dk", "__k", "__lat", "__lon"))


def add_city_coords(df: DataFrame, coords: DataFrame | None = None, dim: str = M.CITY) -> DataFrame:
    """lat/lon by upper-cased city; cities without coordinates are dropped."""
    coords = coords if coords is not None else coords_frame(df.sparkSession, CITY_COORDS)
    c = F.broadcast(coords.select(F.upper(F.col("name")).alias("__k"), "lat", "lon"))
    return df.join(c, F.upper(F.col(dim).cast("string")) == F.col("__k"), "inner").drop("__k")


def city_drill(df: DataFrame, state: str, n: int = 15) -> DataFrame:
    """The cities of one state (city column = first of CITY, DISTRICT, TOWN)
    with revenue, distinct invoices and revenue in lakh (1 dp); top ``n``."""
    col = next((c for c in (M.CITY, "DISTRICT", "TOWN") if c in df.columns), None)
    d = df.where(F.col(M.STATE) == state)
    g = keyed(d, col).groupBy(col).agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"),
                                       F.count_distinct(M.INVOICE_NO).alias("Invoices"))
    g = g.select(F.col(col).alias("city"), F.col("__v").cast("double").alias("Revenue"), "Invoices",
                 F.round(F.col("__v") / F.lit(Decimal(LAKH)), 1).cast("double").alias("Revenue_L"))
    return top_k(g, n, F.col("Revenue").desc(), F.col("city").asc())


def geo_summary(df: DataFrame) -> DataFrame:
    """Top state (ties -> smallest name), active states, mean revenue per
    state in crore (2 dp), and the top city."""
    s = keyed(df, M.STATE).groupBy(M.STATE).agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__v"))
    a = s.agg(F.min_by(M.STATE, F.struct(-F.col("__v"), F.col(M.STATE))).alias("top_state"),
              F.count(F.lit(1)).alias("active_states"), F.sum("__v").alias("__t"))
    c = keyed(df, M.CITY).groupBy(M.CITY).agg(F.coalesce(F.sum(M.AMOUNT), F.lit(0)).alias("__c"))
    tc = c.agg(F.min_by(M.CITY, F.struct(-F.col("__c"), F.col(M.CITY))).alias("top_city"))
    j = with_total(a, tc)
    avg = F.round(F.col("__t") / F.col("active_states") / F.lit(Decimal(CRORE)), 2).cast("double")
    return j.select("top_state", "active_states", avg.alias("avg_revenue_cr"), "top_city")
