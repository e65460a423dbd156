"""Window counts in two levels, draws, and a blend of rasters that do not cover each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators import sampling as P


def cells_of(spark, grid, share, seed=1):
    rng = np.random.default_rng(seed)
    ok = rng.random((grid.height, grid.width)) < share
    there = rng.random(ok.shape) < 0.9  # other cells do not occur at all
    rows = [(i, j, 1.0 if ok[i, j] else None) for i in range(grid.height) for j in range(grid.width) if there[i, j]]
    return ok & there, spark.createDataFrame(rows, "row int, col int, value double")


@pytest.mark.parametrize("size", [1, 4, 5, 9, 13, 23])
def test_window_counts(spark, size):
    grid = Grid(37, 28, 1.0, tile=5)  # partial tiles at both ends
    ok, cells = cells_of(spark, grid, 0.6)
    rng = np.random.default_rng(size)
    at = [(k, int(rng.integers(0, 28 - size + 1)), int(rng.integers(0, 37 - size + 1))) for k in range(60)] + [(60, 5, 5), (61, 28 - size, 37 - size)]
    windows = spark.createDataFrame(at, "k int, row0 int, col0 int")
    got = {r.k: r.n_valid for r in P.window_counts(cells, windows, ["k"], grid, size).collect()}
    assert got == {k: int(ok[r : r + size, c : c + size].sum()) for k, r, c in at}


def test_no_valid_cell(spark):
    grid = Grid(20, 20, 1.0, tile=4)
    cells = spark.createDataFrame([(0, 0, None)], "row int, col int, value double")
    windows = spark.createDataFrame([(1, 0, 0), (2, 3, 3)], "k int, row0 int, col0 int")
    for size in (3, 12):
        assert [r.n_valid for r in P.window_counts(cells, windows, ["k"], grid, size).collect()] == [0, 0]
    assert not P.sample_crops(cells, grid, 5, 6).where("accepted").count()


def test_tables_are_made_for_touched_tiles_only(spark):
    grid = Grid(40, 40, 1.0, tile=8)
    _, cells = cells_of(spark, grid, 1.0)
    tiles = spark.createDataFrame([(0, 0), (3, 2), (3, 2)], "tile_row int, tile_col int")
    made = P.tile_prefixes(cells, tiles, grid).collect()
    assert sorted((r.tile_row, r.tile_col) for r in made) == [(0, 0), (3, 2)]
    assert all(len(r.prefix) == 81 for r in made)


def test_draws_from_keys_with_gaps(spark):
    df = spark.range(100).select((F.col("id") * 2).alias("key"), (F.col("id") + 0.5).alias("v"))
    out = P.draw_with_replacement(df, "key", 100, 500).collect()
    assert sorted(r.draw for r in out) == list(range(500))
    assert all(r.v == r.key / 2 + 0.5 for r in out) and len({r.key for r in out}) > 60
    assert P.draw_with_replacement(df, "key", 1 << 40, 50).count() == 0
