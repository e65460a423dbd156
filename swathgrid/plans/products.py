"""Queries on the composite products and the remaining sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathgrid.functions.text import parse_label
from swathgrid.grid import Grid
from swathgrid.operators import stats as S
from swathgrid.operators import tiles as T
from swathgrid.plans import composites as PL
from swathgrid.plans.fixtures import DEM_PIXEL_M, LATTICE, LAYERS_SQL, dem, dem_grid, fixture
from swathgrid.plans.rasters import (
    BLOCK,
    CRATER_SQL,
    OFF_TIE,
    ROUGH_SQL,
    SLOPE_SQL,
    diamonds,
    layers,
    off_tie,
    rounded,
)
from swathgrid.plans.registry import query
from swathgrid.sources import publish
from swathgrid.sources import tables as IO
from swathgrid.sources.workspace import scratch

H = "(SELECT max(row) + 1 FROM dem)"
H2 = f"CAST(FLOOR({H} * 3 / 2e0) AS INT)"
SRC_COLS, DST_COLS = 125, 200


def regrid_sql(cells: str, dst_cols: int = DST_COLS, dst_rows: str = H2, keys: str = "") -> str:
    """Bilinear regrid of a cells query (row, col, v, keys), before rounding."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}r AS row, c AS col, sum(w * v) / sum(w) AS value FROM (
  SELECT {k}t.r, t.c, v, (CASE WHEN dr = 0 THEN 1 - (y - FLOOR(y)) ELSE y - FLOOR(y) END)
    * (CASE WHEN dc = 0 THEN 1 - (x - FLOOR(x)) ELSE x - FLOOR(x) END) AS w
  FROM (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, (r + 5e-1) * {H} / {dst_rows} - 5e-1 AS y,
          (c + 5e-1) * 125 / {dst_cols}e0 - 5e-1 AS x FROM range(0, {dst_rows}) a(r) CROSS JOIN range(0, {dst_cols}) b(c)) t
  CROSS JOIN (VALUES (0), (1)) AS i(dr) CROSS JOIN (VALUES (0), (1)) AS j(dc)
  JOIN ({cells}) d ON d.row = CAST(FLOOR(y) AS INT) + dr AND d.col = CAST(FLOOR(x) AS INT) + dc WHERE v IS NOT NULL) q
GROUP BY {k}r, c HAVING sum(w) > 0"""


def _rounded_sql(body: str, keys: str = "") -> str:
    return f"SELECT {keys}row, col, round(value + 17e-9, 6) AS value FROM ({body}) z"


def shapes(spark, sf):
    h = dem_grid(spark, sf).height
    return (h, SRC_COLS), (h * 3 // 2, DST_COLS)


@query("product_visible", "C1 J9", _rounded_sql(regrid_sql("SELECT row, col, elevation AS v FROM rasters")))
def product_visible(spark, sf):
    cells = fixture(spark, sf, "rasters").select("row", "col", F.col("elevation").alias("value"))
    return off_tie(PL.align_visible(cells, *shapes(spark, sf), block=BLOCK), "value")


@query("product_laser_dem", "C2 P1 J9", _rounded_sql(regrid_sql("SELECT row, col, lola * 5e-1 AS v FROM dem")))
def product_laser_dem(spark, sf):
    cells = dem(spark, sf, "lola").drop("lat")
    return off_tie(PL.align_laser_dem(cells, *shapes(spark, sf), nodata=-32768.0, block=BLOCK), "value")


@query("product_stereo_dem", "C3 P1 J9", _rounded_sql(regrid_sql("SELECT row, col, sldem / 1000 * 1000 AS v FROM dem")))
def product_stereo_dem(spark, sf):
    cells = dem(spark, sf, "sldem").drop("lat").withColumn("value", F.col("value") / 1000)
    return off_tie(PL.align_stereo_dem(cells, *shapes(spark, sf), block=BLOCK), "value")


@query(
    "product_radiometer",
    "C4 S2 P1 J9",
    _rounded_sql(regrid_sql("SELECT row, col, sldem * 25e-2 + 125e0 AS v FROM dem WHERE col % 20 <> 3")),
)
def product_radiometer(spark, sf):
    """Scale, offset and missing constant come from the label."""
    cells = dem(spark, sf, "sldem").drop("lat")
    cells = cells.withColumn("value", F.when(F.col("col") % 20 == 3, -9999.0).otherwise(F.col("value")))
    text = 'OBJECT = IMAGE\nSCALING_FACTOR = "0.25"\nOFFSET = 125\nMISSING_CONSTANT = -9999\nEND'
    label = spark.range(1).select(parse_label(F.lit(text)).alias("label"))
    return off_tie(PL.align_radiometer(cells, label, *shapes(spark, sf), block=BLOCK), "value")


BLENDED = """SELECT row, col, lat, CASE WHEN abs(lat) < 58 THEN coalesce(sldem, lola)
      WHEN abs(lat) < 62 AND sldem IS NOT NULL AND lola IS NOT NULL
        THEN sldem * (1 - (abs(lat) - 58) / 4) + lola * (abs(lat) - 58) / 4
      ELSE lola END AS lola FROM dem"""


@query(
    "product_terrain",
    "C5 J8 N1 N2",
    f"""SELECT 'elevation' AS channel, row, col, round(lola + 17e-9, 3) AS value FROM ({BLENDED}) b
    UNION ALL SELECT 'slope', row, col, round(slope + 17e-9, 3) FROM ({SLOPE_SQL.replace("FROM dem)", f"FROM ({BLENDED}) d)")}) s
    UNION ALL SELECT 'roughness', row, col, round(roughness, 3)
    FROM ({ROUGH_SQL.replace("FROM dem a", f"FROM ({BLENDED}) a").replace("JOIN dem b", f"JOIN ({BLENDED}) b")}) r""",
)
def product_terrain(spark, sf):
    laser, stereo = dem(spark, sf, "lola"), dem(spark, sf, "sldem").drop("lat")
    out = PL.derive_terrain(laser, stereo, dem_grid(spark, sf), DEM_PIXEL_M, BLOCK)
    # The SQL rounds slopes to five digits before.
    value = F.when(F.col("channel") == "slope", F.round("value", 5)).otherwise(F.col("value"))
    exact = F.when(F.col("channel") == "roughness", F.round(value, 3)).otherwise(F.round(value + OFF_TIE, 3))
    return out.withColumn("value", exact)


@query(
    "product_gravity",
    "C6 P2 P5 J9",
    _rounded_sql(
        regrid_sql(
            "SELECT channel, row, CAST((col + 62) % 125 AS INT) AS col, v FROM (SELECT 'grail_freeair' AS channel, row, col, elevation AS v FROM rasters "
            "UNION ALL SELECT 'grail_bouguer', row, col, roughness FROM rasters WHERE roughness <> 0 UNION ALL SELECT 'grail_uncertainty', row, col, m3_750 FROM rasters) g",
            keys="channel",
        ),
        "channel, ",
    ),
)
def product_gravity(spark, sf):
    names = {"grail_freeair": "elevation", "grail_bouguer": "roughness", "grail_uncertainty": "m3_750"}
    cells = T.stack_columns(fixture(spark, sf, "rasters"), names)
    return off_tie(PL.align_gravity(cells, *shapes(spark, sf), nodata=-99999.0, block=BLOCK), "value")


RADAR = """SELECT channel, row, CAST((col + 62) % 125 AS INT) AS col, v FROM (
    SELECT 'minirf_s1' AS channel, row, col, CASE WHEN elevation > 0 AND elevation <= 1000000 THEN elevation END AS v FROM rasters
    UNION ALL SELECT 'minirf_cpr', row, col, CASE WHEN minirf_s1 > 0 AND minirf_s1 <= 50 THEN minirf_s1 END FROM rasters) g"""


def radar_cells(spark, sf):
    names = {"minirf_s1": "elevation", "minirf_cpr": "minirf_s1"}
    return T.stack_columns(fixture(spark, sf, "rasters"), names)


@query("product_radar", "C7 P2 P5 J9", _rounded_sql(regrid_sql(RADAR, keys="channel"), "channel, "))
def product_radar(spark, sf):
    return off_tie(PL.align_radar(radar_cells(spark, sf), *shapes(spark, sf), block=BLOCK), "value")


@query(
    "product_radar_fixed",
    "C8 P11 A8 K7 P9",
    f"""SELECT channel, row, col, round((l - mean) / std, 5) AS value FROM (
      SELECT channel, row, col, CASE WHEN v > 0 THEN ln(1 + v) END AS l FROM ({RADAR}) r) a
    JOIN (SELECT channel, avg(ln(1 + v)) AS mean, stddev_pop(ln(1 + v)) AS std FROM ({RADAR}) r WHERE v > 0 GROUP BY channel) s USING (channel)""",
)
def product_radar_fixed(spark, sf):
    src, _ = shapes(spark, sf)
    aligned = PL.align_radar(radar_cells(spark, sf), src, src)
    stats = T.channel_table(spark).select("channel", "mean", "std")
    cells, _ = PL.fix_radar(aligned, stats)
    return rounded(cells, "value", digits=5)


@query(
    "product_bands",
    "C9 P2 P4 J9 J10 P5",
    f"""SELECT row, col, round(arg_max(value, ordinal) + 17e-9, 6) AS value, CAST(max(ordinal) AS INT) AS ordinal FROM (
      SELECT row, CAST((col + CASE tile WHEN 'a' THEN 0 ELSE 100 END) % 250 AS INT) AS col, value, CASE tile WHEN 'a' THEN 1 ELSE 2 END AS ordinal FROM (
        {regrid_sql("SELECT 'a' AS tile, row, col, m3_750 AS v FROM rasters UNION ALL SELECT 'b' AS tile, row, col, lpgrs_feo AS v FROM rasters", 150, H, "tile")}) t) p
    GROUP BY row, col""",
)
def product_bands(spark, sf):
    h = dem_grid(spark, sf).height
    cells = T.stack_columns(fixture(spark, sf, "rasters"), {"a": "m3_750", "b": "lpgrs_feo"})
    layout = spark.createDataFrame(
        [("a", 1, 0, 0), ("b", 2, 0, 100)], "tile string, ordinal int, row0 int, col0 int"
    )
    grid = Grid(250, h, 1.0, tile=5)
    tiles = cells.withColumnRenamed("channel", "tile")
    out = PL.mosaic_bands(tiles, layout, (h, 125), (h, 150), grid, nodata=-1e32, block=BLOCK)
    return off_tie(out.select("row", "col", "value", "ordinal"), "value")


@query(
    "product_albedo",
    "C10 P2 J9",
    _rounded_sql(regrid_sql("SELECT row, col, clementine_uvvis_750nm AS v FROM rasters WHERE clementine_uvvis_750nm <> 55")),
)
def product_albedo(spark, sf):
    cells = fixture(spark, sf, "rasters").select("row", "col", F.col("clementine_uvvis_750nm").alias("value"))
    return off_tie(PL.align_albedo(cells, *shapes(spark, sf), nodata=55.0, block=BLOCK), "value")


UNIT_CELLS = """SELECT CAST(FLOOR(y / 10e0) AS INT) AS tile_row, CAST(FLOOR(x / 10e0) AS INT) AS tile_col, (y % 10) * 10 + x % 10 AS idx, arg_max(unit, ordinal) AS unit
    FROM diamonds CROSS JOIN range(0, 180) a(y) CROSS JOIN range(0, 360) b(x)
    WHERE abs(-180e0 + x + 5e-1 - cx) + abs(90e0 - y - 5e-1 - cy) <= a GROUP BY y, x"""


@query(
    "product_geology",
    "C14 J6 P15 P16 J7 A5",
    f"""SELECT tile_row, tile_col, d.unit AS dominant_unit_name, i.unit_id AS dominant_unit_id, n_geo_units, mare_fraction
    FROM (SELECT tile_row, tile_col, CAST(count(DISTINCT unit) AS INT) AS n_geo_units,
            round(avg(CASE WHEN regexp_matches(unit, '^(Em|Im|lIm|Cm)') THEN 1e0 ELSE 0e0 END), 6) AS mare_fraction FROM ({UNIT_CELLS}) u GROUP BY 1, 2) z
    JOIN (SELECT tile_row, tile_col, unit FROM (SELECT *, row_number() OVER (PARTITION BY tile_row, tile_col ORDER BY n DESC, seen) AS k
      FROM (SELECT tile_row, tile_col, unit, count(*) AS n, min(idx) AS seen FROM ({UNIT_CELLS}) u GROUP BY 1, 2, 3) c) r WHERE k = 1) d USING (tile_row, tile_col)
    JOIN (SELECT unit, CAST(dense_rank() OVER (ORDER BY unit) AS INT) AS unit_id FROM diamonds) i ON i.unit = d.unit""",
)
def product_geology(spark, sf):
    _, zones = PL.geology_layers(diamonds(spark, sf), LATTICE)
    return rounded(zones, "mare_fraction")


@query("product_craters", "C15 F6 J5", CRATER_SQL)
def product_craters(spark, sf):
    return PL.crater_layer(fixture(spark, sf, "craters"), LATTICE)


WHOLE = "row < FLOOR((SELECT max(row) + 1 FROM rasters) / 5e0) * 5"
PATCH_TILE = "CAST(FLOOR(row / 5e0) AS INT) AS tile_row, CAST(FLOOR(col / 5e0) AS INT) AS tile_col"


@query(
    "product_patches",
    "C16 F2 A3 A4 K1 J4",
    f"""SELECT {PATCH_TILE}, round(count(*) FILTER (WHERE elevation IS NOT NULL AND roughness IS NOT NULL) / 25e0, 6) AS valid_fraction,
    CASE WHEN count(elevation) > 0 THEN 1 ELSE 0 END + CASE WHEN count(roughness) > 0 THEN 1 ELSE 0 END AS n_v1,
    CASE WHEN count(elevation) > 0 THEN 2 ELSE 0 END + CASE WHEN count(m3_750) > 0 THEN 1 ELSE 0 END AS n_v2,
    CASE WHEN count(elevation) > 0 THEN 2 ELSE 0 END + CASE WHEN count(m3_750) > 0 THEN 1 ELSE 0 END + CASE WHEN count(minirf_s1) > 0 THEN 1 ELSE 0 END AS n_v4
    FROM rasters WHERE {WHOLE} GROUP BY 1, 2 HAVING count(elevation) / 25e0 >= 5e-1""",
)
def product_patches(spark, sf):
    """Two channels, then a spectral one with an override of roughness, then radar."""
    grid, r = dem_grid(spark, sf), fixture(spark, sf, "rasters")
    v1 = T.stack_columns(r, {c: c for c in ("elevation", "roughness")})
    meta, flags1 = PL.patch_dataset(v1, grid, "elevation", 2)
    fixed = T.stack_columns(r, {"m3_750": "m3_750", "roughness": "elevation"})
    v2, flags2 = PL.extend_patches(v1, grid, meta, fixed)
    _, flags4 = PL.extend_patches(v2, grid, meta, T.stack_columns(r, {"minirf_s1": "minirf_s1"}))
    out = meta.select("tile_row", "tile_col", F.round("valid_fraction", 6).alias("valid_fraction"))
    for name, flags in (("n_v1", flags1), ("n_v2", flags2), ("n_v4", flags4)):
        n = flags.groupBy("tile_row", "tile_col").agg(F.count_if("has_channel").cast("int").alias(name))
        out = out.join(n, ["tile_row", "tile_col"])
    return out


@query(
    "product_validation",
    "C18 X2 A13",
    f"""SELECT channel, round(min(mn), 6) AS min, round(max(mx), 6) AS max, round(avg(nf) * 100, 6) AS nan_pct FROM (
      SELECT channel, tile_row, tile_col, min(value) AS mn, max(value) AS mx, 1 - count(value) / CAST(count(*) AS DOUBLE) AS nf
      FROM (SELECT *, {PATCH_TILE} FROM ({LAYERS_SQL}) l WHERE {WHOLE}) t
      JOIN (SELECT DISTINCT {PATCH_TILE} FROM rasters WHERE {WHOLE} ORDER BY md5(concat('42:', CAST(tile_row * 25 + tile_col AS VARCHAR))) LIMIT 100) s USING (tile_row, tile_col)
      GROUP BY 1, 2, 3) p GROUP BY channel""",
)
def product_validation(spark, sf):
    report = PL.validate(layers(spark, sf), dem_grid(spark, sf), 100)
    return rounded(report.select("channel", "min", "max", "nan_pct"), "min", "max", "nan_pct")


# ---- sinks ---------------------------------------------------------------------------------


@query(
    "stats_upsert",
    "K7 A8",
    f"""SELECT channel, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 1), 6) AS std FROM (
      SELECT channel, CASE channel WHEN 'elevation' THEN 11e0 ELSE avg(value) END AS m, CASE channel WHEN 'elevation' THEN 22e0 ELSE stddev_pop(value) END AS s
      FROM ({LAYERS_SQL}) l WHERE value <> 0 GROUP BY channel) t""",
)
def stats_upsert(spark, sf):
    """Statistics of two channels restated, those of all others kept."""
    cells = layers(spark, sf)
    old = S.mean_std(cells, skip_zero=True).withColumn(
        "mean", F.when(F.col("channel") == "roughness", -1.0).otherwise(F.col("mean"))
    )
    new = S.mean_std(cells.where(F.col("channel").isin("elevation", "roughness")), skip_zero=True)
    new = new.withColumn("mean", F.when(F.col("channel") == "elevation", 11.0).otherwise(F.col("mean")))
    new = new.withColumn("std", F.when(F.col("channel") == "elevation", 22.0).otherwise(F.col("std")))
    return rounded(S.upsert_stats(old, new), "mean", "std")


@query(
    "stats_csv",
    "K6 A7",
    f"""SELECT channel, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM ({LAYERS_SQL}) l GROUP BY channel""",
)
def stats_csv(spark, sf):
    path = scratch(spark, "report")
    m = S.moments(layers(spark, sf))
    IO.write_report(m.select("channel", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")]), path)
    schema = "channel string, min double, max double, mean double"
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "idempotent_write",
    "K8",
    "SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) * CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS n FROM lineitem GROUP BY l_returnflag",
)
def idempotent_write(spark, sf):
    """The second write is ignored; a partition overwrite then replaces one partition only."""
    from swathgrid.plans.fixtures import table

    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n")
    )
    path = scratch(spark, "once")
    IO.write_once(counts, path, ["flag"])
    IO.write_once(counts.withColumn("n", F.col("n") * 100), path, ["flag"])
    doubled = counts.where(F.col("flag") == "R").withColumn("n", F.col("n") * 2)
    IO.replace_partitions(doubled, path, ["flag"])
    return spark.read.parquet(path).select(F.col("flag").cast("string").alias("flag"), "n")


@query(
    "completed_write",
    "K8 U2",
    "SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag",
)
def completed_write(spark, sf):
    """A target that a broken job left half-written is made again; once complete, it is left alone."""
    from swathgrid.plans.fixtures import table

    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    path = scratch(spark, "published")
    lines.where("flag < 'N'").write.partitionBy("flag").parquet(path)
    publish.publish_once(lines, path, ["flag"])
    publish.publish_once(lines.limit(3), path, ["flag"])
    stored = spark.read.schema(lines.schema).parquet(path)
    return stored.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "resumed_strips",
    "K8 J3 U2",
    """SELECT strip_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN CAST(strip_id AS INT) % 3 = 0 THEN 'first' ELSE 'second' END AS run
    FROM obs GROUP BY strip_id""",
)
def resumed_strips(spark, sf):
    """A first run that finished a third of the strips, then one over all of them."""
    obs = fixture(spark, sf, "obs").select("strip_id", "line", "incidence")
    path = scratch(spark, "strips")
    first = obs.where(F.col("strip_id").cast("int") % 3 == 0).withColumn("run", F.lit("first"))
    publish.resume_by_key(first, path, "strip_id")
    both = publish.resume_by_key(obs.withColumn("run", F.lit("second")), path, "strip_id")
    return both.groupBy("strip_id", "run").agg(F.count(F.lit(1)).alias("n"))
