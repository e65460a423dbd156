"""Queries on rasters: rescaling, shifting, blending, stencils, regridding, statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from swathgrid.functions import values as V
from swathgrid.functions.geo import ring_to_metres
from swathgrid.grid import Grid
from swathgrid.operators import raster as R
from swathgrid.operators import registration as G
from swathgrid.operators import stats as S
from swathgrid.operators import stencil, vector
from swathgrid.operators.sampling import evenly_spaced
from swathgrid.operators.tiles import add_tile, pack_tiles, stack_columns, unpack_tiles, with_registry
from swathgrid.operators.triangulate import grid_triangulated as triangulated
from swathgrid.plans.fixtures import (
    DEM_PIXEL_M,
    LATTICE,
    LAYER_CHANNELS,
    LAYERS_SQL,
    dem,
    dem_grid,
    fixture,
    table,
)
from swathgrid.plans.registry import query

BLOCK = 64
# Added before rounding where results are short decimals, to keep clear of rounding ties.
OFF_TIE = 1.7e-8
H = "(SELECT max(row) + 1 FROM dem)"


def off_tie(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c) + OFF_TIE, digits) for c in columns})


def layers(spark, sf):
    return stack_columns(fixture(spark, sf, "rasters"), {c: c for c in LAYER_CHANNELS})


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- scalar transforms ---------------------------------------------------------------------


@query(
    "rescale_nodata",
    "P1 P2 P3",
    """SELECT row, col, round(CASE WHEN lola <> -1000 THEN lola * 5e-1 END, 6) AS half,
    round(CASE WHEN sldem IS NULL OR sldem = -999 THEN NULL ELSE sldem * 1000 + 25e-1 END, 6) AS metres,
    CASE WHEN lola > 0 AND lola <= 1000000 AND lola <= 50 THEN lola END AS cpr,
    CASE WHEN lola > 0 AND lola <= 1000000 THEN lola END AS s1,
    CASE WHEN lola >= 0 AND lola <= 2 THEN lola END AS reflectance FROM dem""",
)
def rescale_nodata(spark, sf):
    d = fixture(spark, sf, "dem")
    lola = F.col("lola")
    # NULL enters as NaN, as raw rasters have it, and is converted at ingest.
    raw = V.finite(F.coalesce(F.col("sldem"), F.lit(float("nan"))))
    return d.select(
        "row",
        "col",
        F.round(V.rescale(lola, 0.5, nodata=-1000), 6).alias("half"),
        F.round(V.rescale(raw, 1000, 2.5, nodata=-999), 6).alias("metres"),
        V.radar_valid(lola, "minirf_cpr").alias("cpr"),
        V.radar_valid(lola, "minirf_s1").alias("s1"),
        V.reflectance_valid(lola, -1e30).alias("reflectance"),
    )


@query(
    "zscore",
    "P9 J17",
    f"""SELECT channel, row, col, round((value - mean) / std, 5) AS z FROM ({LAYERS_SQL}) l
    JOIN (VALUES ('elevation', -456.82745361328125e0, 2291.07861328125e0), ('roughness', 37.071136474609375e0, 34.59404754638672e0),
      ('m3_750', 0.07985502481460571e0, 0.026131946593523026e0), ('minirf_s1', 0.9580977559089661e0, 2.793243408203125e0),
      ('lpgrs_tio2', 0.008645933121442795e0, 0.011847379617393017e0), ('lpgrs_feo', 0.06930428743362427e0, 0.046127524226903915e0),
      ('clementine_uvvis_750nm', 41.5467414855957e0, 23.02393913269043e0)) AS s(channel, mean, std) USING (channel)""",
)
def zscore(spark, sf):
    known = with_registry(layers(spark, sf))
    z = V.zscore(F.col("value"), F.col("mean"), F.col("std"))
    return known.select("channel", "row", "col", F.round(z, 5).alias("z"))


@query(
    "zscore_zero_filled",
    "P10",
    """SELECT row, col, round((coalesce(elevation, 0) + 456.82745361328125e0) / 2291.07861328125e0, 6) AS z FROM rasters""",
)
def zscore_zero_filled(spark, sf):
    from swathgrid.constants import CHANNEL_STATS

    mean, std = (F.lit(x) for x in CHANNEL_STATS["elevation"])
    z = V.zscore_zero_filled(F.col("elevation"), mean, std)
    return fixture(spark, sf, "rasters").select("row", "col", F.round(z, 6).alias("z"))


@query(
    "log1p_compress",
    "P11",
    """SELECT row, col, round(CASE WHEN minirf_s1 > 0 THEN ln(1 + minirf_s1) WHEN minirf_s1 >= -1 THEN 0 END, 6) AS value
    FROM rasters""",
)
def log1p_compress(spark, sf):
    v = F.round(V.log1p_compress(F.col("minirf_s1")), 6)
    return fixture(spark, sf, "rasters").select("row", "col", v.alias("value"))


# ---- whole-raster moves --------------------------------------------------------------------


@query("raster_roll", "P5", "SELECT row, CAST((col + 62) % 125 AS INT) AS col, lola AS value FROM dem")
def raster_roll(spark, sf):
    return R.roll_columns(dem(spark, sf, "lola").drop("lat"), 125)


@query(
    "raster_roll_conditional",
    "P5 J16",
    """SELECT 'kept' AS kind, row, col, lola AS value FROM dem UNION ALL
    SELECT 'rolled' AS kind, row, CAST((col + 62) % 125 AS INT) AS col, CASE WHEN col >= 62 THEN lola END AS value FROM dem""",
)
def raster_roll_conditional(spark, sf):
    d = dem(spark, sf, "lola").drop("lat")
    half = d.withColumn("value", F.when(F.col("col") >= 62, F.col("value")))
    kept = R.roll_if_right_heavy(d, 125).withColumn("kind", F.lit("kept"))
    return kept.unionByName(R.roll_if_right_heavy(half, 125).withColumn("kind", F.lit("rolled")))


@query(
    "raster_shift",
    "P14",
    f"""SELECT CAST((row + 2 + {H}) % {H} AS INT) AS row, CAST((col - 4 + 125) % 125 AS INT) AS col,
    CASE WHEN row + 2 < {H} AND col - 4 >= 0 THEN lola END AS value FROM dem""",
)
def raster_shift(spark, sf):
    grid = dem_grid(spark, sf)
    # 2.5 rounds to 2 and -3.5 to -4: half to even.
    return R.shift(dem(spark, sf, "lola").drop("lat"), grid.width, grid.height, 2.5, -3.5)


@query(
    "dem_blend",
    "J8 P7",
    """SELECT row, col, round(CASE WHEN abs(lat) < 58 THEN coalesce(sldem, lola)
      WHEN abs(lat) < 62 AND sldem IS NOT NULL AND lola IS NOT NULL
        THEN sldem * (1 - (abs(lat) - 58) / 4) + lola * (abs(lat) - 58) / 4
      ELSE lola END, 6) AS elevation FROM dem""",
)
def dem_blend(spark, sf):
    d = fixture(spark, sf, "dem")
    laser = d.select("row", "col", "lat", F.col("lola").alias("value"))
    stereo = d.select("row", "col", F.col("sldem").alias("value"))
    grid = dem_grid(spark, sf)
    return rounded(R.blend_dems(laser, stereo, size=grid.width * grid.height), "elevation")


SLOPE_SQL = """
SELECT row, col, CASE WHEN v IS NULL THEN NULL ELSE round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) END AS slope FROM (
  SELECT row, col, v,
    (CASE WHEN col = 0 THEN e - v WHEN col = 124 THEN v - w ELSE (e - w) / 2 END)
      / (1000e0 * greatest(cos(radians(lat)), 1e-2)) AS dx,
    (CASE WHEN row = 0 THEN s - v WHEN row = last THEN v - n ELSE (s - n) / 2 END) / 1000e0 AS dy
  FROM (SELECT row, col, lat, lola AS v, max(row) OVER () AS last,
          lag(lola) OVER (PARTITION BY row ORDER BY col) AS w, lead(lola) OVER (PARTITION BY row ORDER BY col) AS e,
          lag(lola) OVER (PARTITION BY col ORDER BY row) AS n, lead(lola) OVER (PARTITION BY col ORDER BY row) AS s
        FROM dem) a) b"""


@query("dem_slope", "N1", SLOPE_SQL)
def dem_slope(spark, sf):
    grid = dem_grid(spark, sf)
    out = stencil.slope(dem(spark, sf, "lola"), grid, lat="lat", pixel_m=DEM_PIXEL_M, block=BLOCK)
    return rounded(out, "slope", digits=5)


ROUGH_SQL = f"""
SELECT row, col, CASE WHEN max(v) IS NULL THEN NULL ELSE round(stddev_pop(x), 3) END AS roughness FROM (
  SELECT a.row, a.col, a.lola AS v, b.lola AS x FROM dem a
  CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dr) r CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dc) c
  JOIN dem b ON b.row = least(greatest(a.row + dr, 0), {H} - 1) AND b.col = least(greatest(a.col + dc, 0), 124)) p
GROUP BY row, col"""


@query("dem_roughness", "N2", ROUGH_SQL)
def dem_roughness(spark, sf):
    out = stencil.roughness(dem(spark, sf, "lola"), dem_grid(spark, sf), block=BLOCK)
    return rounded(out, "roughness", digits=3)


def dem_tiles(spark, sf, grid):
    return pack_tiles(dem(spark, sf, "lola").drop("lat").withColumn("channel", F.lit("dem")), grid)


FLOAT_DEM = "SELECT row, col, lat, CAST(CAST(lola AS FLOAT) AS DOUBLE) AS lola FROM dem"


@query(
    "dem_slope_tiles",
    "G2 J13 N1 P22",
    SLOPE_SQL.replace("FROM dem)", f"FROM ({FLOAT_DEM}) d)").replace(
        "round(degrees(atan(sqrt(dx * dx + dy * dy))), 5)",
        "round(CAST(CAST(degrees(atan(sqrt(dx * dx + dy * dy))) AS FLOAT) AS DOUBLE), 3)",
    ),
)
def dem_slope_tiles(spark, sf):
    grid = dem_grid(spark, sf)

    def lat(rows):
        return 90.0 - (np.asarray(rows) % 120 + 0.5) * 1.5

    tiles = stencil.slope_tiles(dem_tiles(spark, sf, grid), grid, pixel_m=DEM_PIXEL_M, lat=lat)
    out = unpack_tiles(tiles, grid).drop("channel")
    return out.select("row", "col", F.round(F.col("value").cast("double"), 3).alias("slope"))


@query(
    "dem_roughness_tiles",
    "G2 J13 N2",
    ROUGH_SQL.replace("FROM dem a", f"FROM ({FLOAT_DEM}) a")
    .replace("JOIN dem b", f"JOIN ({FLOAT_DEM}) b")
    .replace("round(stddev_pop(x), 3)", "round(CAST(CAST(stddev_pop(x) AS FLOAT) AS DOUBLE), 1)"),
)
def dem_roughness_tiles(spark, sf):
    grid = dem_grid(spark, sf)
    out = unpack_tiles(stencil.roughness_tiles(dem_tiles(spark, sf, grid), grid), grid)
    return out.select("row", "col", F.round(F.col("value").cast("double"), 1).alias("roughness"))


REGRID_SQL = f"""
SELECT r AS row, c AS col, round(sum(w * v) / sum(w) + 17e-9, 6) AS value FROM (
  SELECT t.r, t.c, d.sldem AS v,
    (CASE WHEN dr = 0 THEN 1 - (y - FLOOR(y)) ELSE y - FLOOR(y) END)
    * (CASE WHEN dc = 0 THEN 1 - (x - FLOOR(x)) ELSE x - FLOOR(x) END) AS w
  FROM (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, (r + 5e-1) * {H} / CAST(FLOOR({H} * 3 / 2e0) AS INT) - 5e-1 AS y,
          (c + 5e-1) * 125 / 200e0 - 5e-1 AS x
        FROM range(0, CAST(FLOOR({H} * 3 / 2e0) AS INT)) a(r) CROSS JOIN range(0, 200) b(c)) t
  CROSS JOIN (VALUES (0), (1)) AS i(dr) CROSS JOIN (VALUES (0), (1)) AS j(dc)
  JOIN dem d ON d.row = CAST(FLOOR(y) AS INT) + dr AND d.col = CAST(FLOOR(x) AS INT) + dc
  WHERE d.sldem IS NOT NULL) q
GROUP BY r, c HAVING sum(w) > 0"""


@query("regrid_bilinear", "J9", REGRID_SQL)
def regrid_bilinear(spark, sf):
    h = dem_grid(spark, sf).height
    out = R.regrid_bilinear(dem(spark, sf, "sldem"), (h, 125), (h * 3 // 2, 200), block=BLOCK)
    return off_tie(out, "value")


@query(
    "regrid_average",
    "J9",
    f"""SELECT CAST(FLOOR((row + 5e-1) * CAST(FLOOR({H} / 3e0) AS INT) / {H}) AS INT) AS row,
    CAST(FLOOR((col + 5e-1) * 50 / 125e0) AS INT) AS col, round(avg(sldem) + 17e-9, 6) AS value
    FROM dem WHERE sldem IS NOT NULL GROUP BY 1, 2""",
)
def regrid_average(spark, sf):
    h = dem_grid(spark, sf).height
    out = R.regrid_average(dem(spark, sf, "sldem"), (h, 125), (h // 3, 50))
    return off_tie(out, "value")


@query(
    "regrid_footprint",
    "J9",
    f"""SELECT r AS row, c AS col, round(sum(w * v) / sum(w) + 17e-9, 6) AS value FROM (
      SELECT t.r, t.c, d.sldem AS v, (1 - abs(d.row - y) / sy) * (1 - abs(d.col - x) / 25e-1) AS w
      FROM (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, {H} / CAST(FLOOR({H} / 3e0) AS DOUBLE) AS sy,
              (r + 5e-1) * {H} / CAST(FLOOR({H} / 3e0) AS INT) - 5e-1 AS y, (c + 5e-1) * 25e-1 - 5e-1 AS x
            FROM range(0, CAST(FLOOR({H} / 3e0) AS INT)) a(r) CROSS JOIN range(0, 50) b(c)) t
      JOIN dem d ON abs(d.row - y) < sy AND abs(d.col - x) < 25e-1 WHERE d.sldem IS NOT NULL) q
    GROUP BY r, c""",
)
def regrid_footprint(spark, sf):
    """Down-sampling with a tent of the target's width."""
    h = dem_grid(spark, sf).height
    out = R.regrid_footprint(dem(spark, sf, "sldem"), (h, 125), (h // 3, 50))
    return off_tie(out, "value")


@query(
    "tile_mosaic_last_valid",
    "J10 C9",
    f"""SELECT row, col, arg_max(value, o) AS value, CAST(max(o) AS INT) AS ordinal FROM (
      SELECT l.*, v.o FROM ({LAYERS_SQL}) l JOIN (VALUES ('elevation', 1), ('roughness', 2), ('m3_750', 3), ('minirf_s1', 4))
      AS v(channel, o) USING (channel)) s WHERE value IS NOT NULL GROUP BY row, col""",
)
def tile_mosaic_last_valid(spark, sf):
    order = F.create_map(
        *[F.lit(x) for c, o in (("elevation", 1), ("roughness", 2), ("m3_750", 3), ("minirf_s1", 4)) for x in (c, o)]
    )
    tiles = layers(spark, sf).withColumn("ordinal", F.try_element_at(order, F.col("channel")))
    return R.last_valid(tiles.where(F.col("ordinal").isNotNull()), "ordinal")


@query(
    "covalid",
    "J16",
    "SELECT row, col, lola AS a, sldem AS b FROM dem WHERE lola IS NOT NULL AND sldem IS NOT NULL",
)
def covalid(spark, sf):
    return R.covalid(dem(spark, sf, "lola"), dem(spark, sf, "sldem"))


BINS_GRID = (90, 180)


def gridded_bins_sql(value):
    """Linear along longitude in each band, then between bands, on a 2 degree grid."""
    return f"""
WITH c AS (SELECT lat, lon, avg({value}) AS v FROM bins WHERE {value} > -1e-2 GROUP BY lat, lon),
cols AS (SELECT CAST(c AS INT) AS col, -180e0 + (c + 5e-1) * 2e0 AS x FROM range(0, 180) t(c)),
lines AS (SELECT CAST(r AS INT) AS row, 90e0 - (r + 5e-1) * 2e0 AS y FROM range(0, 90) t(r)),
near AS (SELECT lat, col, x, max(lon) FILTER (WHERE lon <= x) AS l0, min(lon) FILTER (WHERE lon > x) AS l1
         FROM c CROSS JOIN cols GROUP BY lat, col, x),
band AS (SELECT n.lat, n.col, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v
           ELSE a.v + (b.v - a.v) * (x - l0) / (l1 - l0) END AS v
         FROM near n LEFT JOIN c a ON a.lat = n.lat AND a.lon = l0 LEFT JOIN c b ON b.lat = n.lat AND b.lon = l1),
pick AS (SELECT row, col, y, min(lat) FILTER (WHERE lat >= y) AS b0, max(lat) FILTER (WHERE lat < y) AS b1
         FROM band CROSS JOIN lines GROUP BY row, col, y)
SELECT row, p.col, round(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v
    ELSE a.v + (b.v - a.v) * (b0 - y) / (b0 - b1) END + 17e-9, 6) AS value
FROM pick p LEFT JOIN band a ON a.lat = b0 AND a.col = p.col LEFT JOIN band b ON b.lat = b1 AND b.col = p.col"""


@query("grid_scattered", "J11 F10", gridded_bins_sql("feo"))
def grid_scattered(spark, sf):
    bins = fixture(spark, sf, "bins").where(F.col("feo") > -0.01)
    out = R.grid_scattered(bins, 180, 90, "feo")
    return off_tie(out, "value")


@query("grid_triangulated", "J11 F10")
def grid_triangulated(spark, sf):
    """Circumcircles are not SQL over whole tables; the tests hold the operator against all triples of centres."""
    bins = fixture(spark, sf, "bins").where(F.col("feo") > -0.01)
    return triangulated(bins, 180, 90, "feo", block=32)


# ---- vector features -----------------------------------------------------------------------

CRATER_SQL = """
SELECT DISTINCT CAST(y AS INT) AS row, CAST(x AS INT) AS col FROM (
  SELECT cx + s * 360 AS cx, cy, r FROM (
    SELECT lon + 180 AS cx, 90 - lat AS cy, diam_km / (2 * pi() * 17374e-1 / 360e0) / 2e0 AS r
    FROM craters WHERE diam_km >= 10) d CROSS JOIN (VALUES (-1), (0), (1)) AS v(s)
  WHERE s = 0 OR (s = 1 AND cx - r < 0) OR (s = -1 AND cx - r >= 0 AND cx + r > 360)) k
CROSS JOIN range(0, 180) a(y) CROSS JOIN range(0, 360) b(x)
WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r"""


@query("crater_mask", "J5 F6 U4", CRATER_SQL)
def crater_mask(spark, sf):
    craters = fixture(spark, sf, "craters").where(F.col("diam_km") >= 10)
    return vector.crater_mask(craters, LATTICE)


def diamonds(spark, sf):
    """Diamond rings; longitudes above 180 are left out of the grid by clipping."""
    d = fixture(spark, sf, "diamonds")
    point = [("+", 0), (0, "+"), ("-", 0), (0, "-")]
    size = {"+": F.col("a"), "-": -F.col("a"), 0: F.lit(0.0)}
    ring = F.array(
        *[
            F.struct((F.col("cx") + size[x]).alias("x"), (F.col("cy") + size[y]).alias("y"))
            for x, y in point
        ]
    )
    return d.select("ordinal", "unit", ring.alias("ring"))


@query(
    "polygon_raster",
    "J6 P15",
    """SELECT row, col, unit, CAST(dense_rank() OVER (ORDER BY unit) AS INT) AS unit_id, ordinal FROM (
      SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, arg_max(unit, ordinal) AS unit, max(ordinal) AS ordinal
      FROM diamonds CROSS JOIN range(0, 180) a(y) CROSS JOIN range(0, 360) b(x)
      WHERE abs(-180e0 + x + 5e-1 - cx) + abs(90e0 - y - 5e-1 - cy) <= a GROUP BY y, x) c""",
)
def polygon_raster(spark, sf):
    polygons = diamonds(spark, sf)
    cells = vector.polygon_raster(polygons, LATTICE)
    named = vector.attach_units(cells, polygons).drop("unit_id")
    # Ids over the units that are visible in the raster.
    return named.join(vector.unit_ids(named), "unit")


@query(
    "polygon_parts",
    "S13 J6",
    """SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, max(ordinal) AS ordinal, arg_max(unit, ordinal) AS unit
    FROM (SELECT *, abs((x - 1795e-1 - cx + 900) % 360 - 180) AS dx1, abs((x - 1795e-1 - cx - 60 + 900) % 360 - 180) AS dx2,
            abs(90e0 - y - 5e-1 - cy) AS dy FROM diamonds CROSS JOIN range(0, 180) a(y) CROSS JOIN range(0, 360) b(x)) d
    WHERE (dx1 + dy <= a AND NOT dx1 + dy <= a / 2) OR dx2 + dy <= a / 2 GROUP BY y, x""",
)
def polygon_parts(spark, sf):
    """A WKT layer of two parts each, the first with a hole; some reach across the date line."""
    from swathgrid.sources.tables import unit_column

    def around(dx, share):
        corner = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
        size = F.col("a") * share
        points = [F.concat_ws(" ", F.col("cx") + dx + size * x, F.col("cy") + size * y) for x, y in corner]
        return F.concat(F.lit("("), F.concat_ws(", ", *points), F.lit(")"))

    wkt = F.concat(
        F.lit("MULTIPOLYGON (("), around(0, 1.0), F.lit(", "), around(0, 0.5), F.lit("), ("), around(60, 0.5), F.lit("))")
    )
    layer = fixture(spark, sf, "diamonds").select("ordinal", F.col("unit").alias("MapUnit"), wkt.alias("wkt"))
    polygons = layer.select("ordinal", F.col(unit_column(layer)).alias("unit"), vector.parse_wkt_rings(F.col("wkt")).alias("rings"))
    cells = vector.polygon_raster(polygons, LATTICE, wrap=True)
    return vector.attach_units(cells, polygons).select("row", "col", "ordinal", "unit")


@query(
    "polygon_projection",
    "P8",
    """SELECT ordinal, pos, round((CASE WHEN top > 180 AND x > 180 THEN x - 360 ELSE x END) * pi() / 180 * 1737400, 3) AS x,
    round(y * pi() / 180 * 1737400, 3) AS y FROM (
      SELECT ordinal, pos, cx + dx * a AS x, cy + dy * a AS y, (SELECT max(cx + a) FROM diamonds) AS top
      FROM diamonds CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) AS v(pos, dx, dy)) p""",
)
def polygon_projection(spark, sf):
    rings = ring_to_metres(diamonds(spark, sf)).select("ordinal", F.posexplode("ring").alias("pos", "p"))
    return rings.select("ordinal", "pos", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(
    "polygon_scan",
    "S13",
    """SELECT n_nationkey AS ordinal, n_name AS unit, pos, round(cx + dx * a, 6) AS x, round(cy + dy * a, 6) AS y
    FROM diamonds d JOIN nation ON n_nationkey = ordinal
    CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) AS v(pos, dx, dy)""",
)
def polygon_scan(spark, sf):
    """A WKT layer: the unit column is found by name, the ring parsed from text."""
    from swathgrid.sources.tables import unit_column

    ring = F.col("ring")
    closed = F.concat(ring, F.slice(ring, 1, 1))
    text = F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", ")
    layer = diamonds(spark, sf).select(
        "ordinal",
        F.concat(F.lit("POLYGON(("), text, F.lit("))")).alias("wkt"),
        F.col("unit").alias("FIRST_Unit"),
    )
    name = unit_column(layer)
    rings = layer.select("ordinal", F.col(name).alias("unit"), vector.parse_wkt_ring(F.col("wkt")).alias("ring"))
    points = rings.select("ordinal", "unit", F.posexplode("ring").alias("pos", "p"))
    return points.select(
        "ordinal", "unit", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")
    )


# ---- statistics ----------------------------------------------------------------------------


@query(
    "global_stats",
    "A7 K6",
    f"""SELECT channel, CAST(count(value) AS BIGINT) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p01,
    round(quantile_cont(value, 0.99), 6) AS p99, round(1 - count(value) / CAST(count(*) AS DOUBLE), 6) AS nodata_fraction
    FROM ({LAYERS_SQL}) l GROUP BY channel""",
)
def global_stats(spark, sf):
    stats = S.global_stats(layers(spark, sf))
    return S.stats_report(stats).join(stats.select("channel", "n"), "channel")


@query(
    "channel_mean_std",
    "A8",
    f"""SELECT channel, round(coalesce(avg(value) FILTER (WHERE value <> 0), 0), 6) AS mean,
    round(coalesce(stddev_pop(value) FILTER (WHERE value <> 0), 1), 6) AS std FROM ({LAYERS_SQL}) l GROUP BY channel""",
)
def channel_mean_std(spark, sf):
    return rounded(S.mean_std(layers(spark, sf), skip_zero=True), "mean", "std")


DIST = [0.1, 1, 5, 25, 50, 75, 95, 99, 99.9]


@query(
    "distribution",
    "A9",
    "SELECT channel, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, "
    "round(min(value), 6) AS min, round(max(value), 6) AS max, "
    "round(avg(CASE WHEN value > 5 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_gt_5, "
    "round(avg(CASE WHEN value > 10 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_gt_10, "
    + ", ".join(
        f"round(quantile_cont(value, {p / 100}), 6) AS p{str(p).replace('.', '_')}" for p in DIST
    )
    + f" FROM ({LAYERS_SQL}) l WHERE value <> 0 GROUP BY channel",
)
def distribution(spark, sf):
    out = S.distribution(layers(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("channel", "n")])


@query(
    "quantiles_narrowed",
    "A7 A9",
    f"""SELECT channel, p AS prob, round(CASE p WHEN 5e-1 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.999) END, 6) AS quantile
    FROM ({LAYERS_SQL}) l CROSS JOIN (VALUES (5e-1), (999e-3)) AS v(p) WHERE value IS NOT NULL GROUP BY channel, p""",
)
def quantiles_narrowed(spark, sf):
    """The same quantiles by the way that large keys take."""
    from swathgrid.operators.ranking import quantiles

    q = quantiles(layers(spark, sf), "value", [0.5, 0.999], ["channel"], buckets=64, direct_rows=10)
    return q.select("channel", "prob", F.round("quantile", 6).alias("quantile"))


VALIDATION_PATCHES = f"""SELECT channel, CAST(FLOOR(row / 5e0) AS INT) AS tr, CAST(FLOOR(col / 5e0) AS INT) AS tc,
    min(value) AS mn, max(value) AS mx, avg(value) AS me, 1 - count(value) / CAST(count(*) AS DOUBLE) AS nf
    FROM ({LAYERS_SQL}) l WHERE row < FLOOR((SELECT max(row) + 1 FROM rasters) / 5e0) * 5 GROUP BY 1, 2, 3"""


@query(
    "range_validation",
    "A13 F9",
    f"""SELECT channel, round(mn, 6) AS min, round(mx, 6) AS max, round(me, 6) AS mean, round(nan_pct, 6) AS nan_pct,
    CASE WHEN lo IS NULL THEN '?' WHEN nan_pct > 90 THEN 'WARN (sparse)' WHEN mx > hi * 15e-1 THEN 'WARN (high)'
         WHEN mn < lo * 15e-1 AND mn < lo * 5e-1 THEN 'WARN (low)' ELSE 'OK' END AS status
    FROM (SELECT channel, min(mn) AS mn, max(mx) AS mx, avg(me) AS me, avg(nf) * 100 AS nan_pct FROM ({VALIDATION_PATCHES}) p GROUP BY channel) s
    LEFT JOIN (VALUES ('elevation', -9000e0, 11000e0), ('roughness', 0e0, 5000e0), ('m3_750', 0e0, 5e-1), ('minirf_s1', 0e0, 1e6),
      ('lpgrs_tio2', 0e0, 2e-1), ('lpgrs_feo', 0e0, 4e-1), ('clementine_uvvis_750nm', 0e0, 5e-1)) AS r(channel, lo, hi) USING (channel)""",
)
def range_validation(spark, sf):
    grid = dem_grid(spark, sf)
    out = S.range_validation(S.patch_stats(add_tile(layers(spark, sf), grid)))
    return rounded(out, "min", "max", "mean", "nan_pct")


@query(
    "raster_summary",
    "A32 O1",
    f"""SELECT channel, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(value) AS BIGINT) AS n_valid, round(min(value), 6) AS min,
    round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM ({LAYERS_SQL}) l
    WHERE row IN (SELECT CAST(FLOOR(i * (h - 1) / 4e0) AS INT) FROM range(0, 5) t(i) CROSS JOIN (SELECT max(row) + 1 AS h FROM rasters) m)
    GROUP BY channel""",
)
def raster_summary(spark, sf):
    """The report over five evenly spaced rows, which is the feature."""
    h = dem_grid(spark, sf).height
    rows = [int(i * (h - 1) / 4) for i in range(5)]
    return rounded(S.raster_summary(layers(spark, sf), rows=rows), "min", "max", "mean")


@query(
    "evenly_spaced_rows",
    "O4",
    """SELECT o_orderkey AS position, o_totalprice AS value FROM orders WHERE o_orderkey IN (
      SELECT CAST(FLOOR(i * (n - 1) / 99e0) AS BIGINT) FROM range(0, 100) t(i) CROSS JOIN (SELECT count(*) AS n FROM orders) c)""",
)
def evenly_spaced_rows(spark, sf):
    orders = table(spark, sf, "orders")
    ranked = orders.select(F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("value"))
    return evenly_spaced(ranked, "position", orders.count(), 100)


@query(
    "display_range",
    "A33 P27",
    f"""SELECT channel, round(CASE WHEN count(*) > 10 THEN quantile_cont(value, 0.02) ELSE -2 END, 6) AS vmin,
    round(CASE WHEN count(*) > 10 THEN quantile_cont(value, 0.98) ELSE 2 END, 6) AS vmax,
    round(quantile_cont(value, 0.5), 6) AS median FROM ({LAYERS_SQL}) l WHERE value <> 0 GROUP BY channel""",
)
def display_range(spark, sf):
    return rounded(S.display_range(layers(spark, sf), ["channel"]), "vmin", "vmax", "median")


@query(
    "robust_location",
    "A10",
    """WITH x AS (SELECT row % 7 AS k, sldem - lola AS d FROM dem WHERE sldem IS NOT NULL AND lola IS NOT NULL),
    m AS (SELECT k, quantile_cont(d, 0.5) AS med FROM x GROUP BY k),
    s AS (SELECT k, med, quantile_cont(abs(d - med), 0.5) AS mad FROM x JOIN m USING (k) GROUP BY k, med)
    SELECT k, round(med, 6) AS median, round(mad, 6) AS mad, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN mad < 5e-1 THEN med
      ELSE coalesce(avg(d) FILTER (WHERE abs(d - med) < 3 * mad), med) END, 6) AS location
    FROM x JOIN s USING (k) GROUP BY k, med, mad""",
)
def robust_location(spark, sf):
    both = R.covalid(dem(spark, sf, "lola"), dem(spark, sf, "sldem"))
    d = both.select((F.col("row") % 7).alias("k"), (F.col("b") - F.col("a")).alias("d"))
    return rounded(S.robust_location(d, "d", ["k"]), "median", "mad", "location")


# ---- registration --------------------------------------------------------------------------


def shifted_pair(spark, sf):
    """A raster and a copy of it that was rolled by (-2, +3)."""
    grid = dem_grid(spark, sf)
    ref = dem(spark, sf, "lola").drop("lat")
    moved = ref.withColumn("row", F.pmod(F.col("row") - 2, F.lit(grid.height)).cast("int"))
    moved = moved.withColumn("col", F.pmod(F.col("col") + 3, F.lit(grid.width)).cast("int"))
    return grid, ref, moved


def window_size(grid):
    return min(24, grid.height)


@query(
    "registration_offsets",
    "G1 O3",
    f"""SELECT CAST(i AS VARCHAR) AS region, 2e0 AS dy, -3e0 AS dx FROM (SELECT {H} AS h, least(24, {H}) AS size) s
    CROSS JOIN range(0, 100000) r(i) WHERE i < FLOOR(h / size) * FLOOR(125 / size)""",
)
def registration_offsets(spark, sf):
    """The copy was rolled by (-2, +3), so every window must find (2, -3)."""
    grid, ref, moved = shifted_pair(spark, sf)
    regions = G.lattice_regions(spark, grid, window_size(grid))
    return G.region_offsets(ref, moved, regions, block=BLOCK).select("region", "dy", "dx")


@query(
    "registration_summary",
    "A10 A11 C13",
    """SELECT 2e0 AS dy_pixels, -3e0 AS dx_pixels, 474e0 AS dy_meters, -711e0 AS dx_meters,
    round(sqrt(474e0 * 474e0 + 711e0 * 711e0), 6) AS total_offset_m
    FROM (SELECT count(*) FROM orders) o""",
)
def registration_summary(spark, sf):
    """The copy was rolled by (-2, +3), so the robust offset must be (2, -3)."""
    grid, ref, moved = shifted_pair(spark, sf)
    out = G.summarise_offsets(G.region_offsets(ref, moved, G.lattice_regions(spark, grid, window_size(grid)), BLOCK))
    return rounded(out.drop("n_regions"), "total_offset_m")


@query(
    "registration_correction",
    "C13 P14 G1",
    "SELECT 0e0 AS dy, 0e0 AS dx FROM (SELECT count(*) FROM orders) o",
)
def registration_correction(spark, sf):
    """Correct the copy by the robust offset and measure again: nothing remains."""
    grid, ref, moved = shifted_pair(spark, sf)
    _, rest = G.register(ref, moved, G.lattice_regions(spark, grid, window_size(grid)), grid)
    return rest.groupBy("dy", "dx").agg(F.count(F.lit(1)).alias("n")).select("dy", "dx")


__all__ = ["Grid", "layers"]
