"""Polygons of several rings, and resampling to coarser grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators import raster, vector

GRID = Grid(36, 18, 0.1)


def cells(spark, wkt, wrap=True, unwrap=False):
    layer = spark.createDataFrame([(1, "u", wkt)], "ordinal int, unit string, wkt string")
    polygons = layer.select("ordinal", "unit", vector.parse_wkt_rings(F.col("wkt")).alias("rings"))
    polygons = vector.unwrap_rings(polygons) if unwrap else polygons
    return {(r.row, r.col) for r in vector.polygon_raster(polygons, GRID, wrap).collect()}


def box(c0, c1, r0, r1):
    return {(r, c % 36) for r in range(r0, r1) for c in range(c0, c1)}


def test_wkt_rings(spark):
    texts = ["POLYGON((0 0, 1 0, 1 1, 0 0),(2 2,3 2,3 3,2 2))", " multipolygon (((0 0, 1 0, 1 1)), ((5 5, 6 5, 6 6, 5 5)))", "POLYGON EMPTY", "POINT(1 2)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, wkt string")
    got = [r.rings and [[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.select(vector.parse_wkt_rings(F.col("wkt")).alias("rings"), "i").orderBy("i").collect()]
    assert got[0] == [[(0, 0), (1, 0), (1, 1)], [(2, 2), (3, 2), (3, 3)]]
    assert got[1] == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]]
    assert got[2:] == [[], None, None]


def test_holes_and_parts(spark):
    wkt = "MULTIPOLYGON(((0 0,60 0,60 60,0 60,0 0),(20 20,40 20,40 40,20 40,20 20)),((-100 -50,-80 -50,-80 -30,-100 -30,-100 -50)))"
    assert cells(spark, wkt) == (box(18, 24, 3, 9) - box(20, 22, 5, 7)) | box(8, 10, 12, 14)
    # An island in the hole counts again.
    island = "POLYGON((0 0,60 0,60 60,0 60),(10 10,50 10,50 50,10 50),(20 20,30 20,30 30,20 30))"
    assert cells(spark, island) == (box(18, 24, 3, 9) - box(19, 23, 4, 8)) | box(20, 21, 6, 7)
    assert cells(spark, "POLYGON EMPTY") == set()


def test_across_the_date_line(spark):
    wkt = "POLYGON((160 0,210 0,210 20,160 20,160 0))"
    assert cells(spark, wkt) == box(34, 39, 7, 9)
    assert cells(spark, wkt, wrap=False) == box(34, 36, 7, 9)
    assert cells(spark, "POLYGON((-200 0,-150 0,-150 20,-200 20,-200 0))") == box(-2, 3, 7, 9)
    jumping = "POLYGON((160 0,-150 0,-150 20,160 20,160 0))"
    assert cells(spark, jumping, unwrap=True) == box(34, 39, 7, 9)
    assert cells(spark, "POLYGON((-180 80,180 80,180 90,-180 90,-180 80))") == box(0, 36, 0, 1)


def frame(spark, m):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def regridded(spark, m, dst):
    out = np.full(dst, np.nan)
    for r in raster.regrid_footprint(frame(spark, m), m.shape, dst).collect():
        out[r.row, r.col] = r.value
    return out


def tent(m, dst):
    """The definition, cell by cell."""
    out = np.full(dst, np.nan)
    (sh, sw), (dh, dw) = m.shape, dst
    ry, rx = max(1, sh / dh), max(1, sw / dw)
    for i in range(dh):
        wy = np.maximum(0, 1 - np.abs(np.arange(sh) - ((i + 0.5) * sh / dh - 0.5)) / ry)
        for j in range(dw):
            wx = np.maximum(0, 1 - np.abs(np.arange(sw) - ((j + 0.5) * sw / dw - 0.5)) / rx)
            w = np.outer(wy, wx) * ~np.isnan(m)
            if w.sum() > 1e-12:
                out[i, j] = np.nansum(w * np.nan_to_num(m)) / w.sum()
    return out


@pytest.mark.parametrize("dst", [(4, 5), (5, 3), (24, 40), (5, 40), (12, 20), (1, 1)])
def test_footprint_is_the_tent(spark, dst):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 20))
    m[rng.random(m.shape) < 0.2] = np.nan
    m[:5, :7] = np.nan  # some targets see no valid cell
    np.testing.assert_allclose(regridded(spark, m, dst), tent(m, dst), atol=1e-9)


def test_constants_and_planes(spark):
    y, x = np.mgrid[:24, :30]
    assert np.allclose(regridded(spark, np.full((24, 30), 7.0), (7, 11)), 7.0)
    got = regridded(spark, 2.0 * y - 3.0 * x, (8, 10))
    ty, tx = np.mgrid[:8, :10]
    want = 2.0 * ((ty + 0.5) * 3 - 0.5) - 3.0 * ((tx + 0.5) * 3 - 0.5)
    np.testing.assert_allclose(got[1:-1, 1:-1], want[1:-1, 1:-1], atol=1e-9)


def test_finer_grids_are_bilinear(spark):
    m = np.random.default_rng(2).normal(size=(6, 7))
    plain = {(r.row, r.col): r.value for r in raster.regrid_bilinear(frame(spark, m), (6, 7), (13, 21)).collect()}
    got = regridded(spark, m, (13, 21))
    assert all(abs(got[k] - v) < 1e-9 for k, v in plain.items()) and len(plain) == 13 * 21
