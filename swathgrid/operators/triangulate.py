"""Scattered centres to a grid: Delaunay triangles no larger than a reach, the nearest centre elsewhere.

A triangle belongs to the Delaunay triangulation if no centre lies within its circumcircle. For circles of a
radius up to `reach`, that is decided by the centres within two reaches of any point of the triangle, so a block
of cells needs the centres of its own box and of a margin that wide, and neighbouring blocks agree on every triangle.
One shuffle of the centres by block follows. Cells in no such triangle (outside the hull, in gaps) look for their nearest centre within
one reach, then two, then four: joins on lattice squares, each for the cells that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.sources.workspace import written

TILT = np.array([1e-8, 1.7e-8])  # keeps cell centres off edges and corners, in reaches
NOISE, TOLERANCE = 1e-6, 1e-9
MOST_PRODUCTS = 1 << 21


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _inside(corner: np.ndarray, e1: np.ndarray, e2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Barycentric weights of points in triangles given by a corner and two edges."""
    area = _cross(e1, e2)
    second, third = _cross(at - corner, e2) / area, _cross(e1, at - corner) / area
    return np.stack([1 - second - third, second, third], -1)


def delaunay_values(points: np.ndarray, values: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    """Values at places `at` from the Delaunay triangles that hold them, NaN where there is none within reach.

    Lifted to a paraboloid, the triangle over a place is the lowest one: the weights of three points that give the
    place and the least height. All places start in one large triangle and exchange a corner for the
    point furthest below their plane until there is none. Of corners on one circle, heights raised by a
    hash of the coordinates decide, alike in all blocks.
    """
    out = np.full(len(at), np.nan)
    if not len(points) or not len(at):
        return out
    waves = np.sin(points @ np.array([12.9898, 78.233])) * 43758.5453
    centre = at.mean(0)
    p, q = (points - centre) / reach, (at - centre) / reach + TILT
    span = 16 * max(np.abs(p).max(), np.abs(q).max(), 1.0)
    p = np.concatenate([p, span * np.array([[0.0, 2.0], [-2.0, -1.0], [2.0, -1.0]])])
    height = (p**2).sum(1)
    height[:-3] += NOISE * (waves - np.floor(waves))
    height[-3:] += 1e3 * span**2
    outer = len(points)
    step = max(1, MOST_PRODUCTS // len(p))
    for start in range(0, len(q), step):
        own = q[start : start + step]
        corners = np.tile(np.arange(outer, outer + 3), (len(own), 1))
        open_ = np.arange(len(own))
        while len(open_):
            tri = p[corners[open_]]
            a, e1, e2 = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
            z = height[corners[open_]]
            z1, z2, area = z[:, 1] - z[:, 0], z[:, 2] - z[:, 0], _cross(e1, e2)
            slope = np.stack([z1 * e2[:, 1] - z2 * e1[:, 1], z2 * e1[:, 0] - z1 * e2[:, 0]], 1) / area[:, None]
            above = height - slope @ p.T - (z[:, 0] - (a * slope).sum(1))[:, None]
            # Corners lie in their plane but for rounding.
            np.put_along_axis(above, corners[open_], 0.0, 1)
            enter = above.argmin(1)
            moves = above[np.arange(len(open_)), enter] < -TOLERANCE
            open_, enter, a, e1, e2 = open_[moves], enter[moves], a[moves], e1[moves], e2[moves]
            held, change = _inside(a, e1, e2, own[open_]), _inside(a, e1, e2, p[enter])
            ratio = np.where(change > 1e-13, held / np.where(change > 1e-13, change, 1), np.inf)
            corners[open_, ratio.argmin(1)] = enter
        tri = p[corners]
        a, e1, e2 = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
        sides = np.prod([np.hypot(*e.T) for e in (e1, e2, e2 - e1)], axis=0)
        good = (corners < outer).all(1) & (sides <= 2 * np.abs(_cross(e1, e2)) * (1 + 1e-9))
        weights = _inside(a, e1, e2, own)[good]
        out[start : start + step][good] = (weights * values[corners[good]]).sum(1)
    return out


def _blocks_near(x: str, step: float, low: float, margin: float, count: int):
    """Blocks along one axis whose box and margin hold a coordinate; an empty list if there is none."""
    first = F.greatest(F.ceil((F.col(x) - low - margin) / step - 1), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col(x) - low + margin) / step), F.lit(count - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def grid_triangulated(
    bins: DataFrame,
    width: int,
    height: int,
    value: str = "value",
    reach: float = 5.0,
    block: int = 64,
    most_centres: int = 200_000,
) -> DataFrame:
    """row, col, value of a whole grid from scattered centres (lat, lon in degrees).

    Linear in the Delaunay triangles with a circumcircle of `reach` degrees at most, the nearest centre (ties: the
    smaller lat, then lon) elsewhere. The plane is that of lon and lat and ends at +-180. Centres at one
    place are averaged; null places and values take no part; without centres all values are null.

    A task holds the centres of a block and its margin. They are counted first, and more than `most_centres` raise an
    error that asks for smaller blocks or a smaller reach.
    """
    spark = bins.sparkSession
    centres = written(
        bins.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        .agg(F.avg(F.col(value).cast("double")).alias("v")),
        "centres",
    )
    dx, dy = 360.0 / width, 180.0 / height
    across, down = -(-width // block), -(-height // block)
    placed = (
        centres.withColumn("south", -F.col("lat"))
        .withColumn("block_col", F.explode(_blocks_near("lon", block * dx, -180.0, 2 * reach, across)))
        .withColumn("block_row", F.explode(_blocks_near("south", block * dy, -90.0, 2 * reach, down)))
        .select("block_row", "block_col", "lat", "lon", "v")
    )
    fullest = placed.groupBy("block_row", "block_col").count().agg(F.max("count")).first()[0] or 0
    if fullest > most_centres:
        raise ValueError(f"a block has {fullest} centres, more than {most_centres}: take a smaller block or reach")
    # A row for each block makes those without centres too.
    every = spark.range(across * down).select(
        F.expr(f"cast(id div {across} as int)").alias("block_row"),
        F.expr(f"cast(id % {across} as int)").alias("block_col"),
        *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "v")),
    )

    def fill(batches: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(batches["block_row"].iloc[0]) * block, int(batches["block_col"].iloc[0]) * block
        rows, cols = np.mgrid[row0 : min(row0 + block, height), col0 : min(col0 + block, width)].reshape(2, -1)
        # In one order, whatever way the rows came.
        near = batches.dropna(subset=["v"]).sort_values(["lat", "lon"])
        at = np.stack([-180 + (cols + 0.5) * dx, 90 - (rows + 0.5) * dy], 1)
        found = delaunay_values(near[["lon", "lat"]].to_numpy(), near["v"].to_numpy(), at, reach)
        return pd.DataFrame({"row": rows, "col": cols, "value": pd.array(found, "Float64")})

    cells = placed.unionByName(every).groupBy("block_row", "block_col").applyInPandas(fill, "row int, col int, value double")
    cells = written(cells.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), "triangulated")
    done = cells.where(F.col("value").isNotNull())
    still = cells.where(F.col("value").isNull()).select("row", "col")
    for found, still in _nearest(still, centres, dx, dy, reach):
        done = done.unionByName(found)
    return done.unionByName(still.withColumn("value", F.lit(None).cast("double")))


def _nearest(cells: DataFrame, centres: DataFrame, dx: float, dy: float, within: float) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For growing distances: cells whose nearest centre lies within it, and those still open."""
    x, y = -180.0 + (F.col("col") + 0.5) * dx, 90.0 - (F.col("row") + 0.5) * dy
    while within < 1024 and not cells.isEmpty():
        near = F.sequence(F.lit(-1), F.lit(1))
        asked = (
            cells.withColumn("i", F.explode(F.transform(near, lambda d: F.floor(x / within) + d)))
            .withColumn("j", F.explode(F.transform(near, lambda d: F.floor(y / within) + d)))
        )
        squares = centres.select(F.floor(F.col("lon") / within).alias("i"), F.floor(F.col("lat") / within).alias("j"), "lat", "lon", "v")
        far = (F.col("lon") - x) ** 2 + (F.col("lat") - y) ** 2
        met = asked.join(squares, ["i", "j"]).withColumn("far", far).where(F.col("far") <= within**2)
        best = met.groupBy("row", "col").agg(F.min_by("v", F.struct("far", "lat", "lon")).alias("value"))
        best = written(best, "nearest")
        cells = written(cells.join(best, ["row", "col"], "left_anti"), "open-cells")
        yield best, cells
        within *= 2
