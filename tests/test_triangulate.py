"""Triangulated gridding against all triples of centres, tested one by one."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from swathgrid.operators.triangulate import delaunay_values, grid_triangulated


def brute(points, values, at, reach):
    """Value of each place: its triangle among all with an empty circumcircle, else the nearest centre."""
    triangles = []
    for tri in combinations(range(len(points)), 3):
        (ax, ay), (bx, by), (cx, cy) = points[list(tri)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            continue
        sq = [ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy]
        ux = (sq[0] * (by - cy) + sq[1] * (cy - ay) + sq[2] * (ay - by)) / d
        uy = (sq[0] * (cx - bx) + sq[1] * (ax - cx) + sq[2] * (bx - ax)) / d
        r = np.hypot(ax - ux, ay - uy)
        others = np.delete(points, tri, 0)
        if r <= reach and (np.hypot(*(others - [ux, uy]).T) >= r).all():
            triangles.append(tri)
    out = []
    for q in at:
        for tri in triangles:
            weights = np.linalg.solve(np.vstack([points[list(tri)].T, np.ones(3)]), [*q, 1.0])
            if (weights >= 0).all():
                out.append(weights @ values[list(tri)])
                break
        else:
            out.append(values[np.hypot(*(points - q).T).argmin()])
    return np.array(out)


def grid(width, height):
    rows, cols = np.mgrid[0:height, 0:width].reshape(2, -1)
    return rows, cols, np.stack([-180 + (cols + 0.5) * 360 / width, 90 - (rows + 0.5) * 180 / height], 1)


def frame(spark, points, values):
    rows = [(float(y), float(x), float(v)) for (x, y), v in zip(points, values, strict=True)]
    return spark.createDataFrame(rows, "lat double, lon double, v double")


def collected(df, width, height):
    out = np.full((height, width), np.nan)
    got = df.collect()
    assert len(got) == width * height
    for r in got:
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out.ravel()


@pytest.mark.parametrize("reach", [40.0, 400.0])
def test_blocks_agree_with_all_triples(spark, reach):
    rng = np.random.default_rng(3)
    points = np.stack([rng.uniform(-150, 150, 36), rng.uniform(-70, 70, 36)], 1)
    values = rng.normal(size=36)
    width, height = 36, 18
    got = collected(grid_triangulated(frame(spark, points, values), width, height, "v", reach, block=7), width, height)
    np.testing.assert_allclose(got, brute(points, values, grid(width, height)[2], reach), atol=1e-5)


def test_many_places_and_points_within_one_block():
    rng = np.random.default_rng(4)
    points = rng.uniform(0, 10, (30, 2))
    values = rng.normal(size=30)
    at = rng.uniform(2, 8, (300, 2))
    got = delaunay_values(points, values, at, 100.0)
    inside = ~np.isnan(got)
    assert inside.sum() > 250
    np.testing.assert_allclose(got[inside], brute(points, values, at[inside], 100.0), atol=1e-5)


def test_planes_are_kept_on_a_lattice_of_ties_and_at_the_centres(spark):
    """Every square of a lattice lies on one circle, and cell centres fall on centres."""
    lon, lat = np.meshgrid(np.arange(-175, 180, 10.0), np.arange(-85, 90, 10.0))
    points = np.stack([lon.ravel(), lat.ravel()], 1)
    values = 2 * points[:, 0] - 3 * points[:, 1] + 1
    got = collected(grid_triangulated(frame(spark, points, values), 36, 18, "v", 8.0, block=5), 36, 18)
    at = grid(36, 18)[2]
    np.testing.assert_allclose(got, 2 * at[:, 0] - 3 * at[:, 1] + 1, atol=1e-4)


def test_single_line_repeats_nulls_and_nothing(spark):
    rows = [(0.0, -90.0, 1.0), (0.0, 90.0, 2.0), (0.0, 90.0, 4.0), (None, 0.0, 9.0), (5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, v double")
    got = collected(grid_triangulated(df, 12, 6, "v", 5.0, block=5), 12, 6).reshape(6, 12)
    assert (got[:, :6] == 1).all() and (got[:, 6:] == 3).all()
    assert np.isnan(collected(grid_triangulated(df.limit(0), 12, 6, "v"), 12, 6)).all()


def test_a_block_that_is_too_full_is_refused(spark):
    points = np.random.default_rng(5).uniform(-10, 10, (50, 2))
    with pytest.raises(ValueError, match="smaller block"):
        grid_triangulated(frame(spark, points, np.ones(50)), 36, 18, "v", most_centres=20)
