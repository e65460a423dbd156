"""Rasterising of disks and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.constants import LUNAR_RADIUS_M
from swathgrid.grid import Grid
from swathgrid.operators.ranking import counted_join

WORD = 64


def crater_disks(craters: DataFrame, grid: Grid, key: str = "crater_id") -> DataFrame:
    """Disk centre and radius in pixels; disks over the +-180 edge get a second centre."""
    degree_km = 2 * math.pi * LUNAR_RADIUS_M / 1000.0 / 360.0
    d = craters.select(
        key,
        ((F.col("lon") + F.lit(180.0)) * F.lit(grid.ppd)).alias("cx"),
        ((F.lit(90.0) - F.col("lat")) * F.lit(grid.ppd)).alias("cy"),
        (F.col("diam_km") / F.lit(degree_km) * F.lit(grid.ppd) / 2.0).alias("r"),
    )
    shifted = F.when(F.col("cx") - F.col("r") < 0, F.col("cx") + grid.width).when(
        F.col("cx") + F.col("r") > grid.width, F.col("cx") - grid.width
    )
    centres = F.array_compact(F.array(F.col("cx"), shifted))
    return d.withColumn("cx", F.explode(centres))


def _word_mask(first: Column, last: Column, word: Column) -> Column:
    """64-bit mask of positions first..last that fall into a word."""
    lo = F.greatest(first - word * WORD, F.lit(0)).cast("int")
    hi = F.least(last - word * WORD, F.lit(WORD - 1)).cast("int")
    ones = F.shiftrightunsigned(F.lit(-1).cast("bigint"), 0)
    right = F.call_function("shiftrightunsigned", ones, (F.lit(WORD - 1) - (hi - lo)).cast("int"))
    return F.call_function("shiftleft", right, lo)


def covered_cells(runs: DataFrame) -> DataFrame:
    """Distinct cells of column runs (row, first, last).

    Runs become 64-cell bit masks, and masks are OR-ed per (row, word). That merges on the map
    side and shuffles one long per 64 cells, however many disks overlap.
    """
    words = runs.withColumn(
        "word",
        F.explode(
            F.sequence(F.floor(F.col("first") / WORD).cast("int"), F.floor(F.col("last") / WORD).cast("int"))
        ),
    ).select("row", "word", _word_mask(F.col("first"), F.col("last"), F.col("word")).alias("m"))
    merged = words.groupBy("row", "word").agg(F.bit_or("m").alias("m"))
    bit = F.col("bit")
    return (
        merged.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))
        .where(F.call_function("shiftrightunsigned", F.col("m"), bit).bitwiseAND(F.lit(1)) == 1)
        .select("row", (F.col("word") * WORD + bit).alias("col"))
    )


def crater_mask(craters: DataFrame, grid: Grid, key: str = "crater_id") -> DataFrame:
    """Cells inside any disk. Disks are circles in pixel space, tested at integer positions.

    Large disks are first cut into rows and spread over the cluster, then each row's run of
    columns is computed; the exact distance test trims its ends.
    """
    disks = crater_disks(craters, grid, key)
    reach = F.ceil("r").cast("int")
    y0 = F.greatest(F.col("cy").cast("int") - reach, F.lit(0))
    y1 = F.least(F.col("cy").cast("int") + reach, F.lit(grid.height - 1))
    lines = disks.withColumn("y0", y0).withColumn("y1", y1).where(F.col("y0") <= F.col("y1"))
    lines = lines.withColumn("row", F.explode(F.sequence("y0", "y1")))
    lines = lines.select(key, "row", "cx", "cy", "r").repartition(F.col(key), F.col("row"))
    off = F.col("row") - F.col("cy")
    half = F.sqrt(F.greatest(F.col("r") * F.col("r") - off * off, F.lit(0.0)))

    def inside(x):
        return (x - F.col("cx")) * (x - F.col("cx")) + off * off <= F.col("r") * F.col("r")

    a, b = F.ceil(F.col("cx") - half).cast("int"), F.floor(F.col("cx") + half).cast("int")
    # Rounding of the square root may misplace an end by one cell: test the cells around it.
    first = F.coalesce(*[F.when(inside(a + d), a + d) for d in (-1, 0, 1)])
    last = F.coalesce(*[F.when(inside(b + d), b + d) for d in (1, 0, -1)])
    lowest, highest = F.col("cx").cast("int") - reach, F.col("cx").cast("int") + reach
    runs = lines.select(
        "row",
        F.greatest(first, lowest, F.lit(0)).alias("first"),
        F.least(last, highest, F.lit(grid.width - 1)).alias("last"),
        (first.isNotNull() & last.isNotNull()).alias("hit"),
    ).where(F.col("hit") & (F.col("first") <= F.col("last")))
    return covered_cells(runs.select("row", "first", "last"))


def _edges(ring: Column) -> Column:
    """Edges of a ring, the closing one included."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        after,
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


def polygon_runs(polygons: DataFrame, grid: Grid, wrap: bool = False) -> DataFrame:
    """Even-odd scan conversion at pixel centres: (ordinal, row, first, last).

    A polygon is one ``ring``, or ``rings`` of any number of parts and holes; coordinates are grid degrees. Every edge
    yields its crossing with each row centre line; sorted crossings of a polygon and row, over all
    its rings, pair up to runs: what lies in an even number of rings is outside. With ``wrap`` polygons may reach beyond +-180
    (as those of 0 to 360 layers do), and their runs are cut there; otherwise what lies beyond is left out.
    """
    edges = F.flatten(F.transform("rings", _edges)) if "rings" in polygons.columns else _edges(F.col("ring"))
    edges = polygons.select("ordinal", F.explode(edges).alias("e")).select("ordinal", "e.*")
    edges = edges.where(F.col("y1") != F.col("y2"))
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    r0 = F.greatest(F.floor((F.lit(90.0) - top) * grid.ppd).cast("int") - 1, F.lit(0))
    r1 = F.least(F.floor((F.lit(90.0) - bottom) * grid.ppd).cast("int") + 1, F.lit(grid.height - 1))
    crossing = edges.withColumn("r0", r0).withColumn("r1", r1).where(F.col("r0") <= F.col("r1"))
    crossing = crossing.withColumn("row", F.explode(F.sequence("r0", "r1")))
    y = grid.lat_of(F.col("row"))
    crossing = crossing.where((y >= bottom) & (y < top)).select(
        "ordinal",
        "row",
        (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"),
    )
    w = W.partitionBy("ordinal", "row").orderBy("x")
    pairs = crossing.withColumn("n", F.row_number().over(w)).withColumn("x2", F.lead("x").over(w))
    pairs = pairs.where((F.col("n") % 2 == 1) & F.col("x2").isNotNull())

    def position(x):
        return (x + F.lit(180.0)) * F.lit(grid.ppd) - F.lit(0.5)

    first, last = F.ceil(position(F.col("x"))).cast("int"), F.ceil(position(F.col("x2"))).cast("int") - 1
    runs = pairs.select("ordinal", "row", first.alias("first"), last.alias("last")).where(F.col("first") <= F.col("last"))
    turn = F.lit(0)
    if wrap:
        turns = F.sequence(F.floor(F.col("first") / grid.width), F.floor(F.col("last") / grid.width))
        runs = runs.withColumn("turn", F.explode(turns))
        turn = (F.col("turn") * grid.width).cast("int")
    inside = F.greatest(F.col("first") - turn, F.lit(0)), F.least(F.col("last") - turn, F.lit(grid.width - 1))
    return runs.select("ordinal", "row", inside[0].alias("first"), inside[1].alias("last")).where(F.col("first") <= F.col("last"))


def unwrap_rings(polygons: DataFrame) -> DataFrame:
    """``rings`` of polygons that jump from one side of +-180 to the other, made continuous.

    A step of more than half a turn counts as a step across the date line. Not for layers whose edges do span half the globe, such as
    polar caps drawn from -180 to 180; those need no unwrapping.
    """
    other = [c for c in polygons.columns if c not in ("ordinal", "rings")]
    points = polygons.select("ordinal", F.posexplode("rings").alias("_ring", "_points"))
    points = points.select("ordinal", "_ring", F.posexplode("_points").alias("_at", "_p"))
    ring = W.partitionBy("ordinal", "_ring").orderBy("_at")
    step = F.col("_p.x") - F.lag("_p.x").over(ring)
    turn = F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0)
    points = points.withColumn("_turn", turn).withColumn("_x", F.col("_p.x") + F.sum("_turn").over(ring))
    point = F.struct("_at", F.col("_x").alias("x"), F.col("_p.y").alias("y"))
    rings = points.groupBy("ordinal", "_ring").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    bare = F.transform("_points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rings = rings.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("_ring", bare.alias("r")))).alias("_rings"))
    done = rings.select("ordinal", F.transform("_rings", lambda r: r["r"]).alias("rings"))
    return polygons.select("ordinal", *other).join(done, "ordinal")


def polygon_raster(polygons: DataFrame, grid: Grid, wrap: bool = False) -> DataFrame:
    """Cell -> ordinal of the last polygon that covers it (later features overwrite)."""
    runs = polygon_runs(polygons, grid, wrap)
    cells = runs.withColumn("col", F.explode(F.sequence("first", "last")))
    return cells.groupBy("row", "col").agg(F.max("ordinal").alias("ordinal"))


def attach_units(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Add the unit name and dense unit id to rasterised cells."""
    named = polygons.select("ordinal", "unit").join(unit_ids(polygons), "unit")
    return counted_join(cells, named, "ordinal").select("row", "col", "unit", "unit_id", "ordinal")


def unit_ids(units: DataFrame, unit: str = "unit") -> DataFrame:
    """Distinct unit names numbered 1..N in sorted order.

    The id is a SMALLINT by definition, so the single ordered window sees 32 767 names at most.
    """
    names = units.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit")).distinct()
    return names.withColumn("unit_id", F.row_number().over(W.orderBy("unit")).cast("int"))


def _points(body: Column) -> Column:
    """``x y, x y, ...`` as an array of points, closing point dropped."""
    points = F.transform(
        F.split(body, ","),
        lambda s: F.struct(
            F.get(F.split(F.trim(s), r"\s+"), F.lit(0)).try_cast("double").alias("x"),
            F.get(F.split(F.trim(s), r"\s+"), F.lit(1)).try_cast("double").alias("y"),
        ),
    )
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when(closed, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)


def parse_wkt_ring(wkt: Column) -> Column:
    """Outer ring of ``POLYGON((x y, x y, ...))`` as an array of points, closing point dropped."""
    return _points(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1))


def parse_wkt_rings(wkt: Column) -> Column:
    """All rings of a ``POLYGON`` or ``MULTIPOLYGON``, parts and holes alike; none for an empty one, NULL for other text."""
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(F.upper(F.ltrim(wkt)).rlike("^(MULTI)?POLYGON"), F.transform(bodies, _points))
