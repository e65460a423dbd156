"""Tile-wise sums against cell-wise ones, with early output, NULLs, a crowded tile and merged batches."""

import pytest
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators import accumulate as A
from swathgrid.operators import mosaic as M

GRID = Grid(360, 180, 1.0)


@pytest.fixture(scope="module")
def strips(spark):
    """40,000 pixels: a third at the pole, phase NULL for whole cells and for single pixels."""
    i = F.col("id")
    lat = F.when(i % 3 == 0, 89.5).otherwise((i * 7919 % 1790) / 10 - 89.5)
    return spark.range(40_000, numPartitions=12).select(
        lat.alias("lat"),
        ((i * 104729 % 3600) / 10).alias("lon"),
        ((i % 97 + 1) / 100).alias("b1"),
        F.when(i % 50 == 0, F.lit(None)).otherwise((i % 89 + 1) / 100).alias("b2"),
        (i % 79 + 1.0).alias("incidence"),
        (i % 59 + 1.0).alias("emission"),
        F.when((i % 5 == 0) | (lat < -60), F.lit(None)).otherwise((i % 100).cast("double")).alias("phase"),
    )


def rows(df):
    digits = [c for c in df.columns if c not in ("row", "col", "n_obs")]
    return sorted(map(tuple, df.withColumns({c: F.round(c, 9) for c in digits}).collect()), key=str)


@pytest.mark.parametrize("block,held_mb", [(64, 128), (16, 0), (7, 128)])
def test_tiles_give_the_mosaic(strips, block, held_mb):
    want = rows(M.mosaic(strips, GRID, ["b1", "b2"]))
    assert rows(A.mosaic_by_tiles(strips, GRID, ["b1", "b2"], block=block, held_mb=held_mb)) == want
    assert any(r[-1] is None for r in want) and any(r[-1] is not None for r in want)


def test_partials_of_batches_add_up(spark, strips):
    obs = M.usable_observations(strips, GRID, ["b1", "b2"])
    parts = [A.tile_sums(obs.where(F.col("row") % 3 == k), GRID, ["b1", "b2"], 16) for k in range(3)]
    early = A.merge_tiles(parts[0].unionByName(parts[1]), ["b1", "b2"], 16)
    tiles = A.merge_tiles(early.unionByName(parts[2]), ["b1", "b2"], 16, crowded=False)
    assert tiles.count() == tiles.select("tile").distinct().count()
    got = M.finalise(A.tile_cells(tiles, GRID, ["b1", "b2"], 16), ["b1", "b2"])
    assert rows(got) == rows(M.mosaic(strips, GRID, ["b1", "b2"]))


def test_no_observations(strips):
    assert A.mosaic_by_tiles(strips.where("b1 > 5"), GRID, ["b1", "b2"]).count() == 0
