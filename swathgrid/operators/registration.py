"""Offsets between two rasters from phase correlation in sample regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.constants import METRES_PER_PIXEL, REGISTRATION_REGIONS, REGISTRATION_WINDOW
from swathgrid.grid import Grid
from swathgrid.operators.raster import shift
from swathgrid.operators.stats import robust_location
from swathgrid.sources.workspace import checkpointed


def named_regions(spark: SparkSession, grid: Grid, size: int = REGISTRATION_WINDOW) -> DataFrame:
    """The 20 check regions as windows (region, r0, c0, r1, c1), clipped to the grid.

    Windows with less than half the size along a side are left out.
    """
    rows = ", ".join(f"('{name}', {lat!r}D, {lon!r}D)" for name, lat, lon in REGISTRATION_REGIONS)
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(region, lat, lon)")
    r0 = F.greatest(grid.row_of(F.col("lat")) - size // 2, F.lit(0))
    c0 = F.greatest(grid.col_of(F.col("lon")) - size // 2, F.lit(0))
    w = df.withColumn("r0", r0).withColumn("c0", c0)
    w = w.withColumn("r1", F.least(F.col("r0") + size, F.lit(grid.height)))
    w = w.withColumn("c1", F.least(F.col("c0") + size, F.lit(grid.width)))
    return w.where(
        (F.col("r1") - F.col("r0") >= size // 2) & (F.col("c1") - F.col("c0") >= size // 2)
    ).select("region", "r0", "c0", "r1", "c1")


def lattice_regions(spark: SparkSession, grid: Grid, size: int) -> DataFrame:
    """Non-overlapping square windows over the whole grid."""
    across = grid.width // size
    i = F.col("id")
    return spark.range((grid.height // size) * across).select(
        i.cast("string").alias("region"),
        (F.floor(i / across) * size).cast("int").alias("r0"),
        (i % across * size).cast("int").alias("c0"),
        ((F.floor(i / across) + 1) * size).cast("int").alias("r1"),
        ((i % across + 1) * size).cast("int").alias("c1"),
    )


def phase_offset(ref: np.ndarray, tgt: np.ndarray) -> tuple[float, float, float] | None:
    """Integer displacement to add to ``tgt``, and the correlation peak; None if undefined."""
    ok = np.isfinite(ref) & np.isfinite(tgt)
    if ok.sum() < ref.size * 0.3:
        return None
    spread = [a[ok].std() for a in (ref, tgt)]
    if min(spread) < 1e-10:
        return None
    spectra = [
        np.fft.fft2(np.where(ok, (a - a[ok].mean()) / s, 0.0))
        for a, s in zip((ref, tgt), spread, strict=True)
    ]
    cross = spectra[0] * spectra[1].conj()
    peaks = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-10)).real
    at = np.unravel_index(peaks.argmax(), peaks.shape)
    signed = [int(p) - n if p > n // 2 else int(p) for p, n in zip(at, peaks.shape, strict=True)]
    return float(signed[0]), float(signed[1]), float(peaks[at])


def region_offsets(reference: DataFrame, target: DataFrame, regions: DataFrame, block: int = 256) -> DataFrame:
    """Offset per region: (region, dy, dx, peak). Regions are worked on in parallel.

    Cells meet regions through coarse blocks, an equi-join. Both rasters are stacked instead of
    joined, and a region's window bounds what one call receives.
    """
    spans = regions.withColumn(
        "br", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor((F.col("r1") - 1) / block)))
    ).withColumn(
        "bc", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor((F.col("c1") - 1) / block)))
    )

    def side(df, flag):
        return df.where(F.col("value").isNotNull()).select(
            "row", "col", F.col("value").cast("double").alias("value"), F.lit(flag).alias("is_ref")
        )

    cells = side(reference, True).unionByName(side(target, False))
    cells = cells.withColumn("br", F.floor(F.col("row") / block)).withColumn("bc", F.floor(F.col("col") / block))
    inside = (
        (F.col("row") >= F.col("r0"))
        & (F.col("row") < F.col("r1"))
        & (F.col("col") >= F.col("c0"))
        & (F.col("col") < F.col("c1"))
    )
    hits = cells.join(spans, ["br", "bc"]).where(inside)

    def run(key, table):
        r0, c0, r1, c1 = (table[n][0].as_py() for n in ("r0", "c0", "r1", "c1"))
        sides = np.full((2, r1 - r0, c1 - c0), np.nan)
        which = table["is_ref"].to_numpy().astype(int)
        sides[which, table["row"].to_numpy() - r0, table["col"].to_numpy() - c0] = table["value"].to_numpy()
        found = phase_offset(sides[1], sides[0])
        rows = [] if found is None else [found]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table(
            {
                "region": pa.array([key[0].as_py()] * len(rows), pa.string()),
                "dy": pa.array(cols[0], pa.float64()),
                "dx": pa.array(cols[1], pa.float64()),
                "peak": pa.array(cols[2], pa.float64()),
            }
        )

    return (
        hits.select("region", "r0", "c0", "r1", "c1", "row", "col", "value", "is_ref")
        .groupBy("region")
        .applyInArrow(run, "region string, dy double, dx double, peak double")
    )


def summarise_offsets(offsets: DataFrame) -> DataFrame:
    """Robust offset in pixels and metres, total length, and number of regions."""
    axes = offsets.select(
        F.explode(
            F.array(
                F.struct(F.lit("dy").alias("axis"), F.col("dy").alias("d")),
                F.struct(F.lit("dx").alias("axis"), F.col("dx").alias("d")),
            )
        ).alias("a")
    ).select("a.*")
    # Two rows per region: kept, since the robust location reads them several times.
    per_axis = robust_location(checkpointed(axes), "d", ["axis"])

    def axis(name, col):
        return F.max(F.when(F.col("axis") == name, F.col(col)))

    px = per_axis.agg(
        axis("dy", "location").alias("dy_pixels"),
        axis("dx", "location").alias("dx_pixels"),
        F.max("n").alias("n_regions"),
    )
    return px.select(
        "dy_pixels",
        "dx_pixels",
        (F.col("dy_pixels") * METRES_PER_PIXEL).alias("dy_meters"),
        (F.col("dx_pixels") * METRES_PER_PIXEL).alias("dx_meters"),
        (F.hypot("dy_pixels", "dx_pixels") * METRES_PER_PIXEL).alias("total_offset_m"),
        "n_regions",
    )


def register(reference: DataFrame, target: DataFrame, regions: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Corrected target and the offsets that remain after the correction.

    The robust offset is one row and is read by the driver, as the shift is a parameter.
    """
    found = summarise_offsets(region_offsets(reference, target, regions)).first()
    if found is None or found["dy_pixels"] is None:
        return target, region_offsets(reference, target, regions)
    fixed = shift(target, grid.width, grid.height, found["dy_pixels"], found["dx_pixels"])
    return fixed, region_offsets(reference, fixed, regions)
