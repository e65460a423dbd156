"""Channel statistics, distribution reports, range validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.operators.ranking import quantiles, settle, small_join
from swathgrid.operators.tiles import with_registry

DISTRIBUTION_PERCENTILES = [0.1, 1, 5, 25, 50, 75, 95, 99, 99.9]


def moments(cells: DataFrame, keys: list[str] = ("channel",), value: str = "value") -> DataFrame:
    v = F.col(value)
    return cells.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (1 - F.count(v) / F.count(F.lit(1))).alias("nodata_fraction"),
    )


def pivoted(q: DataFrame, names: dict[float, str], keys: list[str]) -> DataFrame:
    """Quantile rows to one column per probability."""
    return q.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for p, name in names.items()
        ]
    )


def global_stats(cells: DataFrame) -> DataFrame:
    """Per channel: count, range, mean, population deviation, p01, p99 and nodata share."""
    q = pivoted(quantiles(cells, "value", [0.01, 0.99], ["channel"]), {0.01: "p01", 0.99: "p99"}, ["channel"])
    return moments(cells).join(q, "channel", "left")


def distribution(cells: DataFrame, keys: list[str] = ("channel",), value: str = "value") -> DataFrame:
    """Nine percentiles, moments, and the shares above 5 and 10, over valid non-zero cells."""
    valid = cells.where(F.col(value).isNotNull() & (F.col(value) != 0))
    names = {p / 100: "p" + str(p).replace(".", "_") for p in DISTRIBUTION_PERCENTILES}
    q = pivoted(quantiles(valid, value, list(names), keys), names, keys)
    tail = valid.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.avg((F.col(value) > 5).cast("int")) * 100).alias("pct_gt_5"),
        (F.avg((F.col(value) > 10).cast("int")) * 100).alias("pct_gt_10"),
    )
    return tail.join(q, list(keys))


def mean_std(cells: DataFrame, skip_zero: bool = False) -> DataFrame:
    """(mean, deviation) per channel; a channel without data gets (0, 1)."""
    v = F.when(F.col("value") != 0, F.col("value")) if skip_zero else F.col("value")
    return cells.groupBy("channel").agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(v), F.lit(1.0)).alias("std"),
    )


def upsert_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the rows of the channels in ``new`` and keep all others."""
    return old.join(new, "channel", "left_anti").unionByName(new)


def stats_report(stats: DataFrame) -> DataFrame:
    """The report table: six decimals."""
    names = ["min", "max", "mean", "std", "p01", "p99", "nodata_fraction"]
    return stats.select("channel", *[F.round(c, 6).alias(c) for c in names])


def display_range(cells: DataFrame, keys: list[str]) -> DataFrame:
    """2nd and 98th percentile and median of valid cells; (-2, 2) with ten cells or fewer."""
    valid = cells.where(F.col("value").isNotNull() & (F.col("value") != 0))
    names = {0.02: "p02", 0.5: "median", 0.98: "p98"}
    q = quantiles(valid, "value", list(names), keys)
    out = pivoted(q, names, [*keys, "n"])
    few = F.col("n") <= 10
    return out.select(
        *keys,
        F.when(few, -2.0).otherwise(F.col("p02")).alias("vmin"),
        F.when(few, 2.0).otherwise(F.col("p98")).alias("vmax"),
        "median",
    )


def range_validation(patch_stats: DataFrame) -> DataFrame:
    """Status per channel from patch rows (channel, min, max, mean, nan_fraction).

    Sparse overrides high, high overrides low, a channel without a range is '?'.
    """
    per_channel = patch_stats.groupBy("channel").agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.avg("mean").alias("mean"),
        (F.avg("nan_fraction") * 100).alias("nan_pct"),
    )
    rated = with_registry(per_channel.withColumnRenamed("mean", "patch_mean"), "left")
    lo, hi = F.col("min_valid"), F.col("max_valid")
    status = (
        F.when(F.col("idx").isNull(), "?")
        .when(F.col("nan_pct") > 90, "WARN (sparse)")
        .when(F.col("max") > hi * 1.5, "WARN (high)")
        .when((F.col("min") < lo * 1.5) & (F.col("min") < lo * 0.5), "WARN (low)")
        .otherwise("OK")
    )
    return rated.select(
        "channel", "min", "max", F.col("patch_mean").alias("mean"), "nan_pct", status.alias("status")
    )


def patch_stats(tiled: DataFrame) -> DataFrame:
    v = F.col("value")
    return tiled.groupBy("channel", "tile_row", "tile_col").agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        (1 - F.count(v) / F.count(F.lit(1))).alias("nan_fraction"),
    )


def quality_issues(patches: DataFrame) -> DataFrame:
    """One row per broken rule and patch, with severity."""
    rules = [
        ("ERROR", "latitude out of range", ~F.col("center_lat").between(-90, 90)),
        ("ERROR", "longitude out of range", ~F.col("center_lon").between(-180, 180)),
        ("WARNING", "no valid cell", F.coalesce(F.col("valid_fraction"), F.lit(0.0)) <= 0),
        ("WARNING", "mostly nodata", (F.col("valid_fraction") > 0) & (F.col("valid_fraction") < 0.1)),
    ]
    hits = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(text).alias("issue")))
                for sev, text, cond in rules
            ]
        )
    )
    return patches.select("patch_id", F.explode(hits).alias("h")).select("patch_id", "h.*")


def raster_summary(cells: DataFrame, keys: list[str] = ("channel",), rows: list[int] | None = None) -> DataFrame:
    """Shape, validity and range of rasters, over all rows or over named ones."""
    part = cells if rows is None else cells.where(F.col("row").isin(rows))
    return part.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("value").alias("n_valid"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )


def robust_location(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Median, or where the spread is at least half a unit the mean without outliers.

    The spread is the median absolute deviation; outliers lie three or more spreads away.
    """
    keys = list(keys)
    keyed = df if keys else df.withColumn("_one", F.lit(0))
    k = keys or ["_one"]
    med = quantiles(keyed, value, [0.5], k).select(*k, F.col("quantile").alias("med"))
    med, n = settle(med)
    dev = small_join(keyed, med, n, k).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = quantiles(dev, "dev", [0.5], k).select(*k, F.col("quantile").alias("mad"))
    both, n = settle(med.join(mad, k))
    near = F.when(F.abs(F.col(value) - F.col("med")) < 3 * F.col("mad"), F.col(value))
    kept = (
        small_join(keyed, both, n, k)
        .groupBy(*k, "med", "mad")
        .agg(F.avg(near).alias("trimmed"), F.count(value).alias("n"))
    )
    location = F.when(F.col("mad") < 0.5, F.col("med")).otherwise(
        F.coalesce(F.col("trimmed"), F.col("med"))
    )
    return kept.select(*keys, F.col("med").alias("median"), "mad", location.alias("location"), "n")
