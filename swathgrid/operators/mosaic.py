"""Quality filter, gridding and weighted mosaics of observation strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.constants import MAX_EMISSION_DEG, MAX_INCIDENCE_DEG, NODATA
from swathgrid.functions.geo import illumination_weight, wrap_lon
from swathgrid.functions.values import finite
from swathgrid.grid import Grid

ANGLES = ["incidence", "emission", "phase"]


def usable(bands: list[Column]) -> Column:
    """Sun and view angles inside their limits and every selected band in (0, 1)."""
    ok = (
        (F.col("incidence") > 0)
        & (F.col("incidence") < MAX_INCIDENCE_DEG)
        & (F.col("emission") > 0)
        & (F.col("emission") < MAX_EMISSION_DEG)
    )
    for band in bands:
        ok = ok & (band > 0) & (band < 1) & (band != NODATA)
    return ok


def geolocate(df: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``row``/``col`` of finite positions that fall on the grid; others are dropped."""
    wrapped = wrap_lon(finite(F.col(lon)))
    return (
        df.withColumn("row", grid.row_of(finite(F.col(lat))))
        .withColumn("col", grid.col_of(wrapped))
        .where(grid.contains(F.col("row"), F.col("col")))
    )


def usable_observations(
    strips: DataFrame, grid: Grid, bands: list[str], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    return geolocate(strips.where(usable([F.col(b) for b in bands])), grid, lat, lon)


def weighted_sums(obs: DataFrame, bands: list[str], keys: list[str] = ("row", "col")) -> DataFrame:
    """Per-cell weighted sums. All sums merge by adding, so Spark combines before the shuffle."""
    w = illumination_weight(F.col("incidence"))
    sums = [F.sum(w * F.col(c)).alias(f"sum_{c}") for c in [*bands, *ANGLES]]
    return obs.groupBy(*keys).agg(*sums, F.sum(w).alias("sum_w"), F.count(F.lit(1)).alias("n_obs"))


def merge_sums(partials: DataFrame, keys: list[str] = ("row", "col")) -> DataFrame:
    """Add up partial sums, such as those written by successive stream batches."""
    adds = [c for c in partials.columns if c.startswith("sum_") or c == "n_obs"]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in adds])


def finalise(sums: DataFrame, bands: list[str], keys: list[str] = ("row", "col")) -> DataFrame:
    """Weighted means; cells whose total weight is not positive carry NULL everywhere."""
    lit = F.col("sum_w") > 0

    def mean(c):
        return F.when(lit, F.col(f"sum_{c}") / F.col("sum_w"))

    return sums.select(
        *keys,
        *[mean(b).alias(b) for b in bands],
        F.when(lit, F.col("n_obs")).alias("n_obs"),
        *[mean(a).alias(f"mean_{a}") for a in ANGLES],
    )


def mosaic(
    strips: DataFrame, grid: Grid, bands: list[str], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    obs = usable_observations(strips, grid, bands, lat, lon)
    return finalise(weighted_sums(obs, bands), bands)


def coverage(mosaicked: DataFrame, grid: Grid, band: str) -> DataFrame:
    """Covered cells, share of the grid in percent, and range of one band."""
    return mosaicked.where(F.col(band).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_cells"),
        (F.count(F.lit(1)) * 100.0 / (grid.width * grid.height)).alias("coverage_pct"),
        F.min(band).alias("min_value"),
        F.max(band).alias("max_value"),
        F.avg(band).alias("mean_value"),
    )


def strip_bounds(obs: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounding box and number of usable pixels per strip."""
    wrapped = wrap_lon(F.col(lon))
    return obs.groupBy("strip_id").agg(
        F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.min(wrapped).alias("min_lon"),
        F.max(wrapped).alias("max_lon"),
        F.count(F.lit(1)).alias("n_valid"),
    )


def sampled_lines(pixels: DataFrame, strips: DataFrame) -> DataFrame:
    """Pixels on the first, middle and last line of each strip (``strips``: strip_id, lines)."""
    n = F.col("lines")
    three = F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n.cast("int") - 1))
    wanted = strips.select("strip_id", F.explode(three).alias("line"))
    return pixels.join(wanted, ["strip_id", "line"], "left_semi")


def daylight(samples: DataFrame, strips: DataFrame) -> DataFrame:
    """Strip is daytime if any sampled incidence is usable; unreadable strips count as daytime."""
    valid = (F.col("incidence") > 0) & (F.col("incidence") < MAX_INCIDENCE_DEG)
    seen = samples.groupBy("strip_id").agg(
        F.count("incidence").alias("n_samples"),
        F.count_if(valid).alias("n_valid"),
        F.min("incidence").alias("inc_min"),
        F.max("incidence").alias("inc_max"),
    )
    joined = strips.select("strip_id").join(seen, "strip_id", "left")
    n = F.coalesce(F.col("n_samples"), F.lit(0))
    return joined.select(
        "strip_id",
        n.alias("n_samples"),
        F.coalesce(F.col("n_valid"), F.lit(0)).alias("n_valid"),
        F.when(n > 0, F.col("n_valid") * 100.0 / n).otherwise(0.0).alias("pct_valid"),
        "inc_min",
        "inc_max",
        F.when(n == 0, "error")
        .when(F.col("n_valid") > 0, "day")
        .otherwise("night")
        .alias("status"),
        ((n == 0) | (F.col("n_valid") > 0)).alias("is_daytime"),
    )


def complete_files(files: DataFrame, share: float = 0.9) -> DataFrame:
    """Drop image files shorter than ``share`` of what their header promises."""
    expected = F.col("lines").cast("bigint") * F.col("bands") * F.col("samples") * F.col("item_bytes")
    return files.where(F.col("length") >= expected * share)
