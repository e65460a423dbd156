"""Class statistics per tile, block votes, splits and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.functions.hashing import digest
from swathgrid.functions.labels import is_mare
from swathgrid.operators.ranking import counted_join, hash_rank


def zonal_units(cells: DataFrame, zone=("tile_row", "tile_col"), unit="unit_id", order="idx") -> DataFrame:
    """Dominant unit (ties: first seen), number of units and mare share per zone.

    Counts per (zone, unit) combine before the shuffle, so a unit that covers a third of the
    grid costs nothing extra. Zones without units get id 0.
    """
    per_unit = cells.groupBy(*zone, unit).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("seen"),
        F.sum("mare").alias("mare"),
        F.count("mare").alias("mare_n"),
    )
    valid = F.col(unit).isNotNull()
    best = F.max(F.when(valid, F.struct("n", (-F.col("seen")).alias("s"), F.col(unit).alias("u"))))
    return per_unit.groupBy(*zone).agg(
        F.coalesce(best["u"], F.lit(0)).alias("dominant_unit_id"),
        F.count_if(valid).cast("int").alias("n_geo_units"),
        (F.sum("mare") / F.when(F.sum("mare_n") > 0, F.sum("mare_n"))).alias("mare_fraction"),
    )


def with_mare(cells: DataFrame, unit: str = "unit") -> DataFrame:
    return cells.withColumn("mare", is_mare(F.col(unit)))


def name_units(zones: DataFrame, units: DataFrame) -> DataFrame:
    """Unit id to name: 'none' for id 0, 'unknown' for ids without a name."""
    legend = units.select(F.col("unit_id").alias("dominant_unit_id"), "unit")
    name = F.when(F.col("dominant_unit_id") == 0, "none").otherwise(
        F.coalesce(F.col("unit"), F.lit("unknown"))
    )
    return (
        counted_join(zones, legend, "dominant_unit_id", "left")
        .withColumn("dominant_unit_name", name)
        .drop("unit")
    )


def geology_summary(zones: DataFrame) -> DataFrame:
    return zones.agg(
        F.avg("mare_fraction").alias("mean_mare_fraction"),
        F.count_if(F.col("mare_fraction") > 0.5).alias("n_mare"),
        F.count_if(F.col("mare_fraction") < 0.5).alias("n_highlands"),
        F.avg("n_geo_units").alias("mean_units"),
        F.count(F.lit(1)).alias("n_patches"),
    )


def label_counts(df: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The k most frequent labels, a top-k report."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(k)


def block_id(block: int, tile_cols: int) -> Column:
    per_row = -(-tile_cols // block)
    return (
        F.floor(F.col("tile_row") / block) * per_row + F.floor(F.col("tile_col") / block)
    ).cast("int")


def block_votes(patches: DataFrame, order: str = "patch_id") -> DataFrame:
    """Majority category per block, ties to the category seen first."""
    counts = patches.groupBy("block_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("seen")
    )
    best = F.max(F.struct("n", (-F.col("seen")).alias("s"), "category"))
    return counts.groupBy("block_id").agg(
        best["category"].alias("category"), F.sum("n").alias("n_patches")
    )


def split_blocks(
    blocks: DataFrame, seed=42, val_fraction: float = 0.1, test_fraction: float = 0.1
) -> DataFrame:
    """Within each category the shuffled blocks go to test, then val, then train."""
    order = digest(seed, F.col("block_id"))
    ranked = hash_rank(blocks.withColumn("_h", order), ["category"], "_h", tie="block_id")
    n = F.col("n_in_key")
    n_test = F.greatest(F.lit(1), F.floor(n * F.lit(test_fraction)))
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(val_fraction)))
    split = (
        F.when(F.col("rank") <= n_test, "test")
        .when(F.col("rank") <= n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.select("block_id", "category", split.alias("split"))


def split_report(patches: DataFrame) -> DataFrame:
    """Size, extent, latitude bands and mean mare share per split."""
    a = F.abs("center_lat")
    total = patches.agg(F.count(F.lit(1)).alias("n")).scalar()
    return patches.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("center_lat").alias("min_lat"),
        F.max("center_lat").alias("max_lat"),
        F.min("center_lon").alias("min_lon"),
        F.max("center_lon").alias("max_lon"),
        F.count_if(a <= 30).alias("lat_0_30"),
        F.count_if((a > 30) & (a <= 60)).alias("lat_30_60"),
        F.count_if((a > 60) & (a <= 80)).alias("lat_60_80"),
        F.count_if(a > 80).alias("lat_80_90"),
        F.avg("mare_fraction").alias("mean_mare"),
    ).withColumn("pct", F.col("n") * 100.0 / total)
