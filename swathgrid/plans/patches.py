"""Queries on tiles and patches: metadata, flags, stacking, zonal statistics, splits, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathgrid.functions import labels as L
from swathgrid.operators import mosaic as M
from swathgrid.operators import sampling as P
from swathgrid.operators import tiles as T
from swathgrid.operators import vector
from swathgrid.operators import zonal as Z
from swathgrid.operators.ranking import counted_join, settle, small_join
from swathgrid.operators.stats import patch_stats, quality_issues
from swathgrid.plans import composites as PL
from swathgrid.plans.fixtures import LAYER_CHANNELS, LAYERS_SQL, OBS_GRID, dem_grid, fixture, table
from swathgrid.plans.observations import BANDS, GRIDDED
from swathgrid.plans.rasters import layers, off_tie, rounded
from swathgrid.plans.registry import query
from swathgrid.sources import tables as IO
from swathgrid.sources.workspace import scratch

TR, TC = "CAST(FLOOR(row / 5e0) AS INT)", "CAST(FLOOR(col / 5e0) AS INT)"
WHOLE = "row < FLOOR((SELECT max(row) + 1 FROM rasters) / 5e0) * 5"
TILED = f"SELECT *, {TR} AS tile_row, {TC} AS tile_col FROM ({LAYERS_SQL}) l WHERE {WHOLE}"


@query(
    "patch_tiling",
    "P22 P7",
    f"""SELECT tile_row, tile_col, CAST(count(*) AS BIGINT) AS n, CAST(min((row % 5) * 5 + col % 5) AS INT) AS first_idx,
    CAST(max((row % 5) * 5 + col % 5) AS INT) AS last_idx, round(90e0 - (tile_row + 5e-1) * 75e-1, 6) AS center_lat,
    round(-180e0 + (tile_col + 5e-1) * 75e-1, 6) AS center_lon FROM ({TILED}) t WHERE channel = 'elevation' GROUP BY tile_row, tile_col""",
)
def patch_tiling(spark, sf):
    grid = dem_grid(spark, sf)
    cells = T.add_tile(fixture(spark, sf, "rasters").select("row", "col"), grid)
    out = cells.groupBy("tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )
    return out.withColumn("center_lat", F.round(grid.tile_lat(F.col("tile_row")), 6)).withColumn(
        "center_lon", F.round(grid.tile_lon(F.col("tile_col")), 6)
    )


@query(
    "patch_metadata",
    "A3 P22",
    f"""SELECT tile_row, tile_col, round(90e0 - (tile_row + 5e-1) * 75e-1, 6) AS center_lat, round(-180e0 + (tile_col + 5e-1) * 75e-1, 6) AS center_lon,
    round(avg(CASE WHEN n = 8 THEN 1e0 ELSE 0e0 END), 6) AS valid_fraction, round(avg(elevation) + 17e-9, 6) AS mean_elevation,
    round(max(elevation) - min(elevation), 6) AS elevation_range
    FROM (SELECT tile_row, tile_col, row, col, count(value) AS n, max(value) FILTER (WHERE channel = 'elevation') AS elevation
          FROM ({TILED}) t GROUP BY tile_row, tile_col, row, col) c GROUP BY tile_row, tile_col""",
)
def patch_metadata(spark, sf):
    out = T.patch_metadata(layers(spark, sf), dem_grid(spark, sf), len(LAYER_CHANNELS))
    out = off_tie(out, "mean_elevation")
    return rounded(out, "center_lat", "center_lon", "valid_fraction", "elevation_range")


@query(
    "patch_validity",
    "F2 F3",
    f"""SELECT tile_row, tile_col, round(count(value) / 25e0, 6) AS valid_fraction FROM ({TILED}) t WHERE channel = 'roughness'
    GROUP BY tile_row, tile_col HAVING count(value) / 25e0 >= 5e-1""",
)
def patch_validity(spark, sf):
    return rounded(T.usable_tiles(layers(spark, sf), dem_grid(spark, sf), "roughness"), "valid_fraction")


@query(
    "channel_flags",
    "A4",
    f"SELECT tile_row, tile_col, channel, count(value) > 0 AS has_channel FROM ({TILED}) t GROUP BY 1, 2, 3",
)
def channel_flags(spark, sf):
    return T.channel_flags(layers(spark, sf), dem_grid(spark, sf))


GROUP_CASE = """CASE channel WHEN 'elevation' THEN 'surface' WHEN 'roughness' THEN 'surface' WHEN 'm3_750' THEN 'spectral_m3'
  WHEN 'minirf_s1' THEN 'radar' ELSE 'composition' END"""


@query(
    "group_flags",
    "A4 J17 S18",
    f"""SELECT tile_row, tile_col, {GROUP_CASE} AS group_name, count(value) > 0 AS has_group FROM ({TILED}) t
    WHERE channel <> 'mystery' GROUP BY 1, 2, 3""",
)
def group_flags(spark, sf):
    return T.group_flags(T.channel_flags(layers(spark, sf), dem_grid(spark, sf)))


@query(
    "channel_registry",
    "S18 J17 U5",
    f"""SELECT channel, {GROUP_CASE} AS group_name, CAST(count(*) AS BIGINT) AS n FROM ({LAYERS_SQL}) l
    WHERE channel <> 'mystery' GROUP BY channel""",
)
def channel_registry(spark, sf):
    return T.with_registry(layers(spark, sf)).groupBy("channel", "group_name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "channel_coverage",
    "A12",
    f"""SELECT channel, round(avg(CASE WHEN f THEN 1e0 ELSE 0e0 END) * 100, 6) AS coverage_pct, CAST(count(*) AS BIGINT) AS n_patches
    FROM (SELECT channel, tile_row, tile_col, count(value) > 0 AS f FROM ({TILED}) t GROUP BY 1, 2, 3) s GROUP BY channel""",
)
def channel_coverage(spark, sf):
    flags = T.channel_flags(layers(spark, sf), dem_grid(spark, sf))
    return rounded(T.coverage_by_channel(flags), "coverage_pct")


@query(
    "spectral_coverage",
    "A12 P13",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_patches, round(avg(CASE WHEN a THEN 1e0 ELSE 0e0 END) * 100, 6) AS any_pct,
    round(avg(f) FILTER (WHERE f > 0), 6) AS mean_covered FROM (
      SELECT tile_row, tile_col, count(value) > 0 AS a, count(value) FILTER (WHERE channel = 'm3_750') / 25e0 AS f
      FROM ({TILED}) t WHERE channel IN ('m3_750', 'minirf_s1') GROUP BY 1, 2) s""",
)
def spectral_coverage(spark, sf):
    c = T.spectral_coverage(layers(spark, sf), dem_grid(spark, sf), ["m3_750", "minirf_s1"])
    f = F.col("first_valid_fraction")
    return c.agg(
        F.count(F.lit(1)).alias("n_patches"),
        F.round(F.avg(F.col("any_valid").cast("int")) * 100, 6).alias("any_pct"),
        F.round(F.avg(F.when(f > 0, f)), 6).alias("mean_covered"),
    )


@query(
    "channel_stack",
    "J4 U5 A4",
    f"""SELECT channel, row, col, value FROM ({LAYERS_SQL}) l WHERE channel IN ('elevation', 'm3_750', 'minirf_s1') UNION ALL
    SELECT 'roughness' AS channel, row, col, elevation * 2 AS value FROM rasters""",
)
def channel_stack(spark, sf):
    """Base channels, new channels, and one base channel overridden by a re-read raster."""
    r = fixture(spark, sf, "rasters")
    base = T.stack_columns(r, {"elevation": "elevation", "roughness": "roughness"})
    new = T.stack_columns(r, {"m3_750": "m3_750", "minirf_s1": "minirf_s1"})
    fixed = r.select(F.lit("roughness").alias("channel"), "row", "col", (F.col("elevation") * 2).alias("value"))
    return T.stack_channels(base, new, fixed)


FLOAT_LAYERS = f"SELECT channel, row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM ({LAYERS_SQL}) l"


@query(
    "tile_store",
    "K1 K2 S15",
    f"SELECT channel, row, col, round(value, 4) AS value FROM ({FLOAT_LAYERS}) f",
)
def tile_store(spark, sf):
    """Cells to dense tiles, written by channel, read back."""
    grid = dem_grid(spark, sf)
    path = scratch(spark, "tiles")
    IO.write_tiles(T.pack_tiles(layers(spark, sf), grid), path)
    cells = T.unpack_tiles(IO.read_tiles(spark, path), grid)
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(
    "windowed_read",
    "S14 S17",
    f"""SELECT channel, row, col, round(value, 4) AS value FROM ({FLOAT_LAYERS}) f
    WHERE channel = 'roughness' AND row BETWEEN 3 AND 9 AND col BETWEEN 17 AND 88""",
)
def windowed_read(spark, sf):
    """A row and column window of one channel, which is what a windowed read is."""
    grid = dem_grid(spark, sf)
    path = scratch(spark, "tiles")
    IO.write_tiles(T.pack_tiles(layers(spark, sf), grid), path)
    one = IO.read_tiles(spark, path).where(F.col("channel") == "roughness")
    cells = T.read_window(one, grid, 3, 17, 7, 72)
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(
    "normalised_store",
    "K3 P9 C19 S18",
    f"""SELECT channel, row, col, round(CAST(CAST(CASE channel WHEN 'elevation' THEN (value + 456.82745361328125e0) / 2291.07861328125e0
      ELSE (value - 0.07985502481460571e0) / 0.026131946593523026e0 END AS FLOAT) AS DOUBLE), 2) AS z FROM ({FLOAT_LAYERS}) f WHERE channel IN ('elevation', 'm3_750')""",
)
def normalised_store(spark, sf):
    grid = dem_grid(spark, sf)
    two = layers(spark, sf).where(F.col("channel").isin("elevation", "m3_750"))
    path = scratch(spark, "normalised")
    IO.write_tiles(T.normalise_tiles(T.pack_tiles(two, grid)), path)
    cells = T.unpack_tiles(IO.read_tiles(spark, path), grid)
    return cells.select("channel", "row", "col", F.round(F.col("value").cast("double"), 2).alias("z"))


@query(
    "patch_scan",
    "S15 S16 S17",
    f"""SELECT split, channel, CAST(count(*) AS BIGINT) AS n_tiles, CAST(sum(n) AS BIGINT) AS n_valid FROM (
      SELECT CASE WHEN abs(90e0 - (tile_row % 24 + 5e-1) * 75e-1) <= 60 THEN 'train' WHEN abs(90e0 - (tile_row % 24 + 5e-1) * 75e-1) <= 70 THEN 'val'
        WHEN abs(90e0 - (tile_row % 24 + 5e-1) * 75e-1) <= 80 THEN 'test' END AS split, channel, count(value) AS n
      FROM ({TILED}) t GROUP BY tile_row, tile_col, channel) s WHERE split IS NOT NULL GROUP BY split, channel""",
)
def patch_scan(spark, sf):
    """Patches of each latitude split joined to their tiles."""
    grid = dem_grid(spark, sf)
    tiles = T.pack_tiles(layers(spark, sf), grid)
    patches = fixture(spark, sf, "rasters").select("row", "col").transform(lambda d: T.add_tile(d, grid))
    patches = patches.select("tile_row", "tile_col").distinct()
    lat = F.lit(90.0) - (F.col("tile_row") % 24 + 0.5) * 7.5
    patches = patches.withColumn("split", L.latitude_split(lat)).where(F.col("split").isNotNull())
    valid = F.size(F.array_compact("data"))
    return (
        patches.join(tiles, ["tile_row", "tile_col"])
        .groupBy("split", "channel")
        .agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(valid).cast("bigint").alias("n_valid"))
    )


@query(
    "channel_sample_maps",
    "DM12 S16 A4",
    f"""SELECT tile_row, tile_col, count(*) FILTER (WHERE f) AS n_available, bool_or(f AND channel = 'minirf_s1') AS has_s1
    FROM (SELECT channel, tile_row, tile_col, count(value) > 0 AS f FROM ({TILED}) t GROUP BY 1, 2, 3) s GROUP BY 1, 2""",
)
def channel_sample_maps(spark, sf):
    maps = T.flag_maps(T.channel_flags(layers(spark, sf), dem_grid(spark, sf)))
    m = F.col("has_channel")
    return maps.select(
        "tile_row",
        "tile_col",
        F.size(F.map_filter(m, lambda k, v: v)).cast("bigint").alias("n_available"),
        m["minirf_s1"].alias("has_s1"),
    )


@query(
    "multiangle_store",
    "K9 P13 C16",
    f"""SELECT CAST(FLOOR(row / 4e0) AS INT) AS tile_row, CAST(FLOOR(col / 4e0) AS INT) AS tile_col, CAST((row % 4) * 4 + col % 4 AS INT) AS idx,
    CAST(least(count(*), 255) AS INT) AS n_obs, """
    + ", ".join(
        f"round(CAST(CAST(sum(w * {a}) / sum(w) AS FLOAT) AS DOUBLE), 2) AS mean_{a}" for a in M.ANGLES
    )
    + f" FROM ({GRIDDED}) g GROUP BY row, col",
)
def multiangle_store(spark, sf):
    """Geometry layers of the mosaic by patch: counts in one byte, angles in single precision."""
    path = scratch(spark, "angles")
    PL.write_multiangle(M.mosaic(fixture(spark, sf, "obs"), OBS_GRID, BANDS), OBS_GRID, path)
    back = spark.read.parquet(path)
    angles = [F.round(F.col(f"mean_{a}").cast("double"), 2).alias(f"mean_{a}") for a in M.ANGLES]
    return back.select("tile_row", "tile_col", "idx", F.col("n_obs").cast("int").alias("n_obs"), *angles)


@query(
    "patchify",
    "P23",
    """SELECT CAST(FLOOR((row % 5) / 1e0) * 5 + col % 5 AS INT) AS patch, channel, CAST(CASE channel WHEN 'elevation' THEN 0 ELSE 1 END AS INT) AS pos,
    CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(value, 0)), 3) AS total
    FROM (SELECT 'elevation' AS channel, row, col, elevation AS value FROM rasters UNION ALL SELECT 'roughness', row, col, roughness FROM rasters) l GROUP BY 1, 2, 3""",
)
def patchify(spark, sf):
    two = T.stack_columns(fixture(spark, sf, "rasters"), {c: c for c in ("elevation", "roughness")})
    local = two.withColumn("row", F.col("row") % 5).withColumn("col", F.col("col") % 5)
    index = F.when(F.col("channel") == "elevation", 0).otherwise(1)
    return T.patchify(local, 1, 5, index).groupBy("patch", "channel", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 3).alias("total")
    )


@query(
    "unpatchify",
    "P23",
    "SELECT CAST(FLOOR(row / 25e0) AS INT) AS image, CAST(row % 25 AS INT) AS row, CAST(col AS INT) AS col, elevation AS value FROM rasters",
)
def unpatchify(spark, sf):
    """Image blocks to patch vectors and back."""
    r = fixture(spark, sf, "rasters").select(
        F.floor(F.col("row") / 25).cast("int").alias("image"), (F.col("row") % 25).alias("row"), "col",
        F.col("elevation").alias("value"),
    )
    vectors = T.patchify(r, 5, 25, F.lit(0)).drop("row", "col")
    return T.unpatchify(vectors, 5, 25, 0)


# ---- geology -------------------------------------------------------------------------------


@query(
    "unit_ids",
    "P15",
    """SELECT unit, CAST(dense_rank() OVER (ORDER BY unit) AS INT) AS unit_id FROM (SELECT DISTINCT unit FROM units WHERE unit IS NOT NULL) u""",
)
def unit_ids(spark, sf):
    return vector.unit_ids(fixture(spark, sf, "units"))


MARE = "CASE WHEN unit IS NOT NULL THEN CASE WHEN regexp_matches(unit, '^(Em|Im|lIm|Cm)') THEN 1 ELSE 0 END END"


@query("mare_flag", "P16 U3", f"SELECT row, col, CAST({MARE} AS INT) AS mare FROM units")
def mare_flag(spark, sf):
    return Z.with_mare(fixture(spark, sf, "units")).select("row", "col", "mare")


@query("mare_fraction", "A16 P16", f"SELECT round(avg({MARE}), 6) AS mare_fraction FROM units")
def mare_fraction(spark, sf):
    return Z.with_mare(fixture(spark, sf, "units")).agg(F.round(F.avg("mare"), 6).alias("mare_fraction"))


UNIT_TILES = f"""SELECT {TR} AS tile_row, {TC} AS tile_col, unit, {MARE} AS mare, (row % 5) * 5 + col % 5 AS idx FROM units
    WHERE row < FLOOR((SELECT max(row) + 1 FROM units) / 5e0) * 5"""

ZONAL_SQL = f"""
SELECT tile_row, tile_col, coalesce(d.unit, 'none') AS dominant_unit_name, coalesce(i.unit_id, 0) AS dominant_unit_id, n_geo_units, mare_fraction
FROM (SELECT tile_row, tile_col, CAST(count(DISTINCT unit) AS INT) AS n_geo_units, round(avg(mare), 6) AS mare_fraction FROM ({UNIT_TILES}) u GROUP BY 1, 2) z
LEFT JOIN (SELECT tile_row, tile_col, unit FROM (SELECT *, row_number() OVER (PARTITION BY tile_row, tile_col ORDER BY n DESC, seen) AS k
    FROM (SELECT tile_row, tile_col, unit, count(*) AS n, min(idx) AS seen FROM ({UNIT_TILES}) u WHERE unit IS NOT NULL GROUP BY 1, 2, 3) c) r WHERE k = 1) d
  USING (tile_row, tile_col)
LEFT JOIN (SELECT unit, CAST(dense_rank() OVER (ORDER BY unit) AS INT) AS unit_id FROM (SELECT DISTINCT unit FROM units WHERE unit IS NOT NULL) q) i ON i.unit = d.unit"""


def zones(spark, sf):
    units = fixture(spark, sf, "units")
    ids, n = settle(vector.unit_ids(units))
    cells = T.add_tile(small_join(units, ids, n, "unit", "left"), dem_grid(spark, sf))
    return Z.name_units(Z.zonal_units(Z.with_mare(cells)), ids)


@query("zonal_dominant_unit", "A5 J7 J12", ZONAL_SQL)
def zonal_dominant_unit(spark, sf):
    return rounded(zones(spark, sf), "mare_fraction")


@query(
    "geology_summary",
    "A31",
    f"""SELECT round(avg(mare_fraction), 5) AS mean_mare_fraction, CAST(count(*) FILTER (WHERE mare_fraction > 5e-1) AS BIGINT) AS n_mare,
    CAST(count(*) FILTER (WHERE mare_fraction < 5e-1) AS BIGINT) AS n_highlands, round(avg(n_geo_units), 6) AS mean_units, CAST(count(*) AS BIGINT) AS n_patches FROM ({ZONAL_SQL}) z""",
)
def geology_summary(spark, sf):
    out = Z.geology_summary(zones(spark, sf))
    return rounded(rounded(out, "mean_units"), "mean_mare_fraction", digits=5)


@query(
    "label_top10",
    "A31 O2",
    f"""SELECT dominant_unit_name, CAST(count(*) AS BIGINT) AS n FROM ({ZONAL_SQL}) z GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
)
def label_top10(spark, sf):
    return Z.label_counts(zones(spark, sf), "dominant_unit_name", 10)


# ---- labels and splits ---------------------------------------------------------------------


@query(
    "age_labels",
    "P17 F7",
    """SELECT * FROM (SELECT patch_id, CASE WHEN starts_with(unit_name, 'pN') THEN 0 WHEN starts_with(unit_name, 'EI') THEN 2 WHEN starts_with(unit_name, 'N') THEN 1
      WHEN starts_with(unit_name, 'I') THEN 2 WHEN starts_with(unit_name, 'E') THEN 3 WHEN starts_with(unit_name, 'C') THEN 4 ELSE -1 END AS age FROM patches) a WHERE age >= 0""",
)
def age_labels(spark, sf):
    aged = fixture(spark, sf, "patches").select("patch_id", L.age_class(F.col("unit_name")).alias("age"))
    return aged.where(F.col("age") >= 0)


CATEGORY = """CASE WHEN abs(center_lat) > 80 THEN 3 WHEN mare_fraction > 7e-1 THEN 2 WHEN mare_fraction > 3e-1 THEN 1 ELSE 0 END"""


@query(
    "terrain_category",
    "P18",
    f"""SELECT patch_id, {CATEGORY} AS category, CASE WHEN abs(center_lat) > 80 THEN 3 ELSE 1 END AS without_geology FROM patches""",
)
def terrain_category(spark, sf):
    lat, mare = F.col("center_lat"), F.col("mare_fraction")
    return fixture(spark, sf, "patches").select(
        "patch_id",
        L.terrain_category(lat, mare).alias("category"),
        L.terrain_category(lat, None).alias("without_geology"),
    )


@query(
    "geo_split",
    "P19",
    """SELECT patch_id, CASE WHEN abs(center_lat) <= 60 THEN 'train' WHEN abs(center_lat) <= 70 THEN 'val' ELSE 'test' END AS split
    FROM patches WHERE abs(center_lat) <= 80""",
)
def geo_split(spark, sf):
    p = fixture(spark, sf, "patches").select("patch_id", L.latitude_split(F.col("center_lat")).alias("split"))
    return p.where(F.col("split").isNotNull())


@query(
    "geology_target",
    "P21",
    """SELECT patch_id, CAST(dense_rank() OVER (ORDER BY unit_name) - 1 AS INT) AS target FROM patches""",
)
def geology_target(spark, sf):
    p = fixture(spark, sf, "patches")
    ids = vector.unit_ids(p, "unit_name").withColumnRenamed("unit", "unit_name")
    return counted_join(p, ids, "unit_name").select("patch_id", (F.col("unit_id") - 1).alias("target"))


@query(
    "latitude_band",
    "F4",
    """SELECT patch_id, center_lat FROM patches WHERE center_lat BETWEEN -45 AND 82""",
)
def latitude_band(spark, sf):
    p = fixture(spark, sf, "patches").select("patch_id", "center_lat")
    return p.where(F.col("center_lat").between(-45, 82))


CATEGORISED = f"""SELECT *, {CATEGORY} AS category, CAST(FLOOR(tile_row / 5e0) * 10 + FLOOR(tile_col / 5e0) AS INT) AS block_id FROM patches"""
BLOCK_SQL = f"""
SELECT block_id, category, CAST(total AS BIGINT) AS n_patches FROM (
  SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY block_id) AS total
  FROM (SELECT block_id, category, count(*) AS n, min(patch_id) AS seen FROM ({CATEGORISED}) c GROUP BY 1, 2) g) r WHERE k = 1"""
SPLIT_SQL = f"""
SELECT block_id, category, CASE WHEN k <= greatest(1, FLOOR(n * 1e-1)) THEN 'test'
  WHEN k <= greatest(1, FLOOR(n * 1e-1)) + greatest(1, FLOOR(n * 1e-1)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat('42:', CAST(block_id AS VARCHAR))), block_id) AS k,
        count(*) OVER (PARTITION BY category) AS n FROM ({BLOCK_SQL}) b) s"""
ASSIGNED = f"""SELECT c.*, s.split FROM ({CATEGORISED}) c JOIN ({SPLIT_SQL}) s ON c.block_id = s.block_id"""


def categorised(spark, sf):
    p = fixture(spark, sf, "patches")
    return p.withColumn(
        "category", L.terrain_category(F.col("center_lat"), F.col("mare_fraction"))
    ).withColumn("block_id", Z.block_id(5, 50))


def assigned(spark, sf):
    p = categorised(spark, sf)
    splits = Z.split_blocks(Z.block_votes(p))
    return p.join(splits.select("block_id", "split"), "block_id")


@query("block_category", "A6", BLOCK_SQL)
def block_category(spark, sf):
    return Z.block_votes(categorised(spark, sf))


@query("blocked_split", "N4 J14", f"SELECT patch_id, block_id, split FROM ({ASSIGNED}) a")
def blocked_split(spark, sf):
    return assigned(spark, sf).select("patch_id", "block_id", "split")


@query(
    "split_report",
    "A14 C17",
    f"""SELECT split, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM patches), 6) AS pct, min(center_lat) AS min_lat, max(center_lat) AS max_lat,
    round(min(center_lon), 6) AS min_lon, round(max(center_lon), 6) AS max_lon, CAST(count(*) FILTER (WHERE abs(center_lat) <= 30) AS BIGINT) AS lat_0_30,
    CAST(count(*) FILTER (WHERE abs(center_lat) > 30 AND abs(center_lat) <= 60) AS BIGINT) AS lat_30_60,
    CAST(count(*) FILTER (WHERE abs(center_lat) > 60 AND abs(center_lat) <= 80) AS BIGINT) AS lat_60_80,
    CAST(count(*) FILTER (WHERE abs(center_lat) > 80) AS BIGINT) AS lat_80_90, round(avg(mare_fraction), 6) AS mean_mare FROM ({ASSIGNED}) a GROUP BY split""",
)
def split_report(spark, sf):
    return rounded(Z.split_report(assigned(spark, sf)), "pct", "min_lon", "max_lon", "mean_mare")


@query(
    "block_counts",
    "A15",
    f"""SELECT category, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(n_patches) AS BIGINT) AS n_patches FROM ({BLOCK_SQL}) b GROUP BY category""",
)
def block_counts(spark, sf):
    return Z.block_votes(categorised(spark, sf)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_patches").alias("n_patches")
    )


@query(
    "quality_issues",
    "F9",
    """SELECT patch_id, severity, issue FROM (
      SELECT patch_id, 'WARNING' AS severity, 'no valid cell' AS issue FROM patches WHERE coalesce(mare_fraction, 0) <= 0 UNION ALL
      SELECT patch_id, 'WARNING', 'mostly nodata' FROM patches WHERE mare_fraction > 0 AND mare_fraction < 1e-1 UNION ALL
      SELECT patch_id, 'ERROR', 'latitude out of range' FROM patches WHERE center_lat * 105e-2 NOT BETWEEN -90 AND 90) q""",
)
def quality_issues_query(spark, sf):
    p = fixture(spark, sf, "patches").withColumnRenamed("mare_fraction", "valid_fraction")
    return quality_issues(p.withColumn("center_lat", F.col("center_lat") * 1.05))


# ---- sampling ------------------------------------------------------------------------------


@query(
    "uniform_sample",
    "X2",
    "SELECT patch_id FROM patches ORDER BY md5(concat('42:', CAST(patch_id AS VARCHAR))), patch_id LIMIT 100",
)
def uniform_sample(spark, sf):
    return P.uniform_sample(fixture(spark, sf, "patches").select("patch_id"), "patch_id", 100)


@query(
    "replacement_draw",
    "X3",
    """SELECT d.draw, p.patch_id FROM (SELECT draw, CAST('0x' || substr(md5(concat('123:', CAST(draw AS VARCHAR))), 1, 8) AS BIGINT) % (SELECT count(*) FROM patches) AS k
      FROM range(0, 500) t(draw)) d JOIN (SELECT patch_id, row_number() OVER (ORDER BY patch_id) - 1 AS k FROM patches) p ON p.k = d.k""",
)
def replacement_draw(spark, sf):
    p = fixture(spark, sf, "patches").select("patch_id")
    return P.draw_with_replacement(p, "patch_id", p.count(), 500)


@query(
    "first_patches",
    "F11 O1",
    "SELECT patch_id, unit_name FROM patches ORDER BY patch_id LIMIT 50",
)
def first_patches(spark, sf):
    return P.first_n(fixture(spark, sf, "patches").select("patch_id", "unit_name"), "patch_id", 50)


CROP, CROPS, TRIES = 6, 400, 20
CROP_SQL = f"""
WITH o AS (SELECT crop_id, try, CAST(CAST('0x' || substr(md5(concat('42:row:', CAST(crop_id AS VARCHAR), ':', CAST(try AS VARCHAR))), 1, 8) AS BIGINT) % ({{h}} - {CROP} + 1) AS INT) AS row0,
      CAST(CAST('0x' || substr(md5(concat('42:col:', CAST(crop_id AS VARCHAR), ':', CAST(try AS VARCHAR))), 1, 8) AS BIGINT) % (125 - {CROP} + 1) AS INT) AS col0
    FROM range(0, {CROPS}) a(crop_id) CROSS JOIN (SELECT CAST(t AS INT) AS try FROM range(0, {TRIES}) b(t)) t),
s AS (SELECT crop_id, try, row0, col0, count(m3_750) / {CROP * CROP}e0 AS valid_fraction
    FROM o JOIN rasters r ON r.row BETWEEN row0 AND row0 + {CROP - 1} AND r.col BETWEEN col0 AND col0 + {CROP - 1} GROUP BY 1, 2, 3, 4)
SELECT c.crop_id, f.try, f.row0, f.col0, round(f.valid_fraction, 6) AS valid_fraction, f.try IS NOT NULL AS accepted
FROM range(0, {CROPS}) c(crop_id) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY try) AS k FROM s WHERE valid_fraction >= 9e-1) f
  ON f.crop_id = c.crop_id AND f.k = 1"""


def crops(spark, sf):
    lead = fixture(spark, sf, "rasters").select("row", "col", F.col("m3_750").alias("value"))
    return P.sample_crops(lead, dem_grid(spark, sf), CROPS, CROP, min_valid=0.9, tries=TRIES)


@query(
    "crop_sample", "X1 F3", CROP_SQL.replace("{h}", "(SELECT max(row) + 1 FROM rasters)")
)
def crop_sample(spark, sf):
    return rounded(crops(spark, sf), "valid_fraction")


@query(
    "crop_pixels",
    "X1 A4 DM12",
    f"""SELECT c.crop_id, l.channel, count(l.value) > 0 AS has_channel, CAST(count(l.value) AS BIGINT) AS n_valid,
    round(sum(CAST(CAST(l.value AS FLOAT) AS DOUBLE)), 2) AS total
    FROM ({CROP_SQL.replace("{h}", "(SELECT max(row) + 1 FROM rasters)")}) c JOIN ({LAYERS_SQL}) l
      ON l.row BETWEEN row0 AND row0 + {CROP - 1} AND l.col BETWEEN col0 AND col0 + {CROP - 1}
    WHERE accepted GROUP BY 1, 2""",
)
def crop_pixels(spark, sf):
    grid = dem_grid(spark, sf)
    tiles = T.pack_tiles(layers(spark, sf), grid)
    made = P.crop_pixels(crops(spark, sf), tiles, grid, CROP)
    known = F.array_compact("pixels")
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "crop_id",
        "channel",
        "has_channel",
        F.size(known).cast("bigint").alias("n_valid"),
        F.round(F.when(F.size(known) > 0, total), 2).alias("total"),
    )


LAT_BAND = (61.0, 85.0)
# Rows 3 to 18 of the grid lie in that band, so origins run from 3 to 13 or as far as the grid goes.
BAND_SQL = CROP_SQL.replace(f"% ({{h}} - {CROP} + 1)", f"% (least({{h}} - {CROP}, 13) - 3 + 1) + 3")


@query(
    "crop_latitudes",
    "F4 X1",
    f"""SELECT c.crop_id, c.row0, c.col0, c.valid_fraction, count(m3_750) AS n_valid, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max
    FROM ({BAND_SQL.replace("{h}", "(SELECT max(row) + 1 FROM rasters)")}) c
    JOIN rasters r ON r.row BETWEEN row0 AND row0 + {CROP - 1} AND r.col BETWEEN col0 AND col0 + {CROP - 1}
    JOIN (SELECT row, col, lat FROM dem) d ON d.row = r.row AND d.col = r.col
    WHERE accepted GROUP BY 1, 2, 3, 4""",
)
def crop_latitudes(spark, sf):
    """Crops from the rows of a latitude band, and the latitudes of the cells they hold."""
    grid = dem_grid(spark, sf)
    lead = fixture(spark, sf, "rasters").select("row", "col", F.col("m3_750").alias("value"))
    rows = P.latitude_rows(grid, CROP, *LAT_BAND)
    made = P.sample_crops(lead, grid, CROPS, CROP, min_valid=0.9, tries=TRIES, rows=rows).where("accepted")
    inside = F.explode(F.sequence(F.lit(0), F.lit(CROP - 1)))
    cells = made.withColumn("i", inside).withColumn("j", inside).select(
        "crop_id", "row0", "col0", "valid_fraction", (F.col("row0") + F.col("i")).alias("row"), (F.col("col0") + F.col("j")).alias("col")
    )
    held = cells.join(lead, ["row", "col"]).join(fixture(spark, sf, "dem").select("row", "col", "lat"), ["row", "col"])
    out = held.groupBy("crop_id", "row0", "col0", "valid_fraction").agg(
        F.count("value").alias("n_valid"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max")
    )
    return rounded(out, "valid_fraction", "lat_min", "lat_max")


@query(
    "patch_features",
    "M1",
    f"""SELECT channel, tile_row, tile_col, round(avg(value) + 17e-9, 4) AS mean, round(stddev_pop(value) + 17e-9, 4) AS std, round(quantile_cont(value, 0.1) + 17e-9, 4) AS p10,
    round(quantile_cont(value, 0.9) + 17e-9, 4) AS p90, round(count(value) / 25e0, 6) AS valid_fraction FROM ({TILED}) t GROUP BY 1, 2, 3""",
)
def patch_features(spark, sf):
    """Per-patch statistics; a tile has a fixed number of cells, so exact percentiles are safe."""
    tiled = T.add_tile(layers(spark, sf), dem_grid(spark, sf))
    v = F.col("value")
    out = tiled.groupBy("channel", "tile_row", "tile_col").agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.1)).alias("p10"),
        F.percentile(v, F.lit(0.9)).alias("p90"),
        (F.count(v) / F.lit(25.0)).alias("valid_fraction"),
    )
    return rounded(off_tie(out, "mean", "std", "p10", "p90", digits=4), "valid_fraction")


__all__ = ["patch_stats"]
