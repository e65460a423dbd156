"""Longitude, weighting and projection expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.constants import LUNAR_RADIUS_M


def wrap_lon(lon: Column) -> Column:
    """0..360 to -180..180; exactly 180 stays and so falls off the grid."""
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def illumination_weight(incidence: Column) -> Column:
    return F.cos(F.radians(incidence))


def ring_to_metres(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Bring polygon rings to projected metres centred on longitude 0.

    Whether the layer is already projected, and whether it runs 0..360, is a property of
    the whole layer, so both come from one aggregate read as a scalar subquery.
    """
    bounds = rings.select(
        F.array_min(F.transform(ring, lambda p: p["x"])).alias("lo"),
        F.array_max(F.transform(ring, lambda p: p["x"])).alias("hi"),
    ).agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("b"))
    b = bounds.scalar()
    half = math.pi * LUNAR_RADIUS_M
    metres = math.pi / 180.0 * LUNAR_RADIUS_M
    flagged = rings.withColumn("_b", b)
    projected = F.abs(F.col("_b.hi")) > 1000
    span = F.when(
        projected, F.when((F.col("_b.lo") >= 0) & (F.col("_b.hi") > half), F.lit(half))
    ).otherwise(F.when(F.col("_b.hi") > 180, F.lit(180.0)))
    unit = F.when(projected, F.lit(1.0)).otherwise(F.lit(metres))
    flagged = flagged.withColumn("_span", span).withColumn("_unit", unit)

    def place(p: Column) -> Column:
        over = F.col("_span").isNotNull() & (p["x"] > F.col("_span"))
        x = F.when(over, p["x"] - 2 * F.col("_span")).otherwise(p["x"])
        return F.struct((x * F.col("_unit")).alias("x"), (p["y"] * F.col("_unit")).alias("y"))

    return flagged.withColumn(ring, F.transform(ring, place)).drop("_b", "_span", "_unit")
