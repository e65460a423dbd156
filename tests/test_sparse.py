"""Absent cells count as NULL cells; scratch folders are shared."""

from types import SimpleNamespace

import pytest

from swathgrid.operators import raster, sampling, tiles
from swathgrid.sources.workspace import checkpoint_root
from swathgrid.grid import Grid
from swathgrid.plans.composites import derive_terrain

CELL = "channel string, row int, col int, value double"


def test_a_sparse_override_replaces_the_whole_channel(spark):
    base = spark.createDataFrame([("a", 0, c, 1.0) for c in range(4)] + [("b", 0, 0, 5.0)], CELL)
    over = spark.createDataFrame([("a", 0, 0, 9.0)], CELL)
    got = sorted(map(tuple, tiles.stack_channels(base, over).collect()))
    assert got == [("a", 0, 0, 9.0), ("b", 0, 0, 5.0)]


def test_cells_that_only_the_stereo_raster_holds_stay(spark):
    schema = "row int, col int, lat double, value double"
    laser = spark.createDataFrame([(0, 0, 10.0, 1.0)], schema)
    stereo = spark.createDataFrame([(0, 0, 10.0, 2.0), (0, 1, 10.0, 3.0), (0, 2, 80.0, 4.0)], schema)
    assert sorted(map(tuple, raster.blend_dems(laser, stereo).collect())) == [(0, 0, 2.0), (0, 1, 3.0), (0, 2, None)]


def test_coverage_of_all_patches(spark):
    flags = spark.createDataFrame([(0, 0, "a", True)], "tile_row int, tile_col int, channel string, has_channel boolean")
    patches = spark.createDataFrame([(0, c) for c in range(4)], "tile_row int, tile_col int")
    assert tuple(tiles.coverage_by_channel(flags, patches).first()) == ("a", 25.0, 4)


def test_positions_with_an_outlier_key(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(0, 3000, 3), 10**12]], "k long")
    got = sampling.dense_positions(ids, ids.limit(5), key="k").orderBy("k").collect()
    assert [r.position for r in got] == list(range(1001))


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="share"):
        checkpoint_root(session)


def test_terrain_keeps_cells_that_only_stereo_holds(spark):
    schema = "row int, col int, lat double, value double"
    laser = spark.createDataFrame([(0, 0, 10.0, 1.0), (0, 1, 10.0, 3.0)], schema)
    stereo = spark.createDataFrame([(0, 0, 10.0, 2.0), (0, 2, 10.0, 5.0)], schema)
    out = derive_terrain(laser, stereo, Grid(3, 1, 1.0), 1000.0).where("channel = 'elevation'")
    assert sorted((r.row, r.col, r.value) for r in out.collect()) == [(0, 0, 2.0), (0, 1, 3.0), (0, 2, 5.0)]
