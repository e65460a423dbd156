"""Cell value expressions. NULL is the only nodata; NaN is converted at ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathgrid.constants import CHANNEL_STATS


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def rescale(v: Column, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> Column:
    """``v * scale + offset``; the nodata test sees the value before scaling."""
    scaled = v * F.lit(float(scale)) + F.lit(float(offset))
    return scaled if nodata is None else F.when(v != nodata, scaled)


def radar_valid(v: Column, channel: str) -> Column:
    """Radar products: non-positive and absurdly large values are nodata."""
    ok = (v > 0) & (v <= 1e6)
    if channel == "minirf_cpr":
        ok = ok & (v <= 50)
    return F.when(ok, v)


def reflectance_valid(v: Column, nodata: float | None) -> Column:
    """Photometric band tiles: declared nodata (with 10 % slack), negative and > 2 are nodata."""
    ok = (v >= 0) & (v <= 2.0)
    if nodata is not None:
        ok = ok & (v > nodata * 0.9)
    return F.when(ok, v)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (v - mean) / std).otherwise(v)


def zscore_zero_filled(v: Column, mean: Column, std: Column) -> Column:
    """Variant in which nodata becomes 0 first, and so ends at ``-mean / std``."""
    return zscore(F.coalesce(v, F.lit(0.0)), mean, std)


def published_zscore(v: Column, channel: str) -> Column:
    mean, std = CHANNEL_STATS[channel]
    return zscore(v, F.lit(mean), F.lit(std))


def log1p_compress(v: Column) -> Column:
    """``log1p`` of non-zero values; negative results are raised to 0, undefined ones are NULL."""
    return F.when(v > 0, F.log1p(v)).when((v <= 0) & (v >= -1), F.lit(0.0))


def narrow_count(v: Column) -> Column:
    """Observation counts clipped to one byte."""
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("smallint")


def argmax(scores: Column) -> Column:
    """0-based position of the largest score (first one on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
