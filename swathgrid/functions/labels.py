"""Label expressions on unit names and patch centres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathgrid.constants import AGE_PREFIXES, MARE_PREFIXES


def is_mare(unit: Column) -> Column:
    """1/0, NULL where there is no unit."""
    return F.when(unit.isNotNull(), unit.rlike("^(" + "|".join(MARE_PREFIXES) + ")").cast("int"))


def age_class(unit: Column) -> Column:
    """Age class by name prefix, tested in the listed order; -1 if none fits."""
    tests = F.coalesce(
        *[F.when(unit.startswith(prefix), F.lit(cls)) for prefix, cls in AGE_PREFIXES], F.lit(-1)
    )
    return tests.cast("int")


def terrain_category(lat: Column, mare: Column | None) -> Column:
    """0 highlands, 1 mixed, 2 mare, 3 polar. Without geology every patch has fraction 0.5."""
    fraction = F.lit(0.5) if mare is None else mare
    return (
        F.when(F.abs(lat) > 80, 3).when(fraction > 0.7, 2).when(fraction > 0.3, 1).otherwise(0)
    ).cast("int")


def latitude_split(lat: Column) -> Column:
    """train up to 60, val up to 70, test up to 80 degrees; NULL beyond."""
    a = F.abs(lat)
    return F.when(a <= 60, "train").when(a <= 70, "val").when(a <= 80, "test")
