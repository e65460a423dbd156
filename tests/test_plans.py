"""Shape of physical plans, and results when one key holds a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators import blocks
from swathgrid.operators import catalog as C
from swathgrid.operators import features, mosaic, raster, sampling, stencil, vector, zonal
from swathgrid.operators import tiles as T
from swathgrid.operators.blocks import with_halo
from swathgrid.plans import composites as PL
from swathgrid.plans.fixtures import OBS_GRID, dem, fixture

SF = "/root/testdata/sf0.001"
GRID = Grid(125, 12, 1.0, tile=5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


@pytest.mark.parametrize(
    "name,make",
    [
        ("slope", lambda d: stencil.slope(d, GRID, block=8)),
        ("roughness", lambda d: stencil.roughness(d, GRID, block=8)),
        ("bilinear", lambda d: raster.regrid_bilinear(d, (12, 125), (20, 200), block=8)),
        ("last_valid", lambda d: raster.last_valid(d.withColumn("o", F.lit(1)), "o")),
        ("average", lambda d: raster.regrid_average(d, (12, 125), (4, 50))),
        ("zonal", lambda d: T.channel_flags(d.withColumn("channel", F.lit("slope")), GRID)),
        ("metadata", lambda d: T.patch_metadata(d.withColumn("channel", F.lit("elevation")), GRID, 1)),
    ],
)
def test_one_shuffle(spark, name, make):
    assert exchanges(make(dem(spark, SF, "lola").drop("lat"))) == 1


def test_mosaic_combines_before_the_shuffle_and_prunes_the_scan(spark):
    text = plan(mosaic.mosaic(fixture(spark, SF, "obs"), OBS_GRID, ["b1", "b2"]))
    assert text.count("Exchange ") == 1 and "partial_sum" in text
    assert "l_returnflag" not in text and "l_shipdate" not in text
    assert "IsNotNull(l_quantity)" in text


def test_masks_and_scalar_rolls_move_no_rows(spark):
    a = spark.range(100).select(
        F.col("id").alias("sample_id"), F.lit("surface").alias("group_name"), F.lit(True).alias("available")
    )
    masked = sampling.random_mask(a, 16, 0.75)
    assert exchanges(masked) == 0
    assert masked.where("visible").count() == 400
    assert exchanges(raster.roll_columns(dem(spark, SF, "lola"), 125)) == 0


def test_halo_repeats_few_cells(spark):
    big = spark.range(512 * 512).select(
        F.floor(F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col")
    )
    assert with_halo(big, 512, 512, 1).count() == (512 + 2) ** 2


def test_tasks_of_large_grids_keep_their_cells(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_CELLS", 1024)
    cells = spark.range(256 * 256).select(
        F.floor(F.col("id") / 256).cast("int").alias("row"), (F.col("id") % 256).cast("int").alias("col"),
        F.lit("elevation").alias("channel"), (F.col("id") % 7).cast("double").alias("value"),
    )
    halo = with_halo(cells, 256, 256, 1, ["channel"], block=8)
    assert halo.rdd.getNumPartitions() == 64
    per_task = halo.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 3 * 1024 * 1.25**2
    by_tile = T.patch_metadata(cells, Grid(256, 256, 1.0, tile=4), 1)
    assert by_tile.rdd.getNumPartitions() == 64 and by_tile.count() == 64 * 64


def test_terrain_of_large_grids_is_cut_into_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_CELLS", 1024)
    cells = spark.range(128 * 128).select(
        F.floor(F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"),
        F.lit(0.0).alias("lat"), (F.col("id") % 7).cast("double").alias("value"),
    )
    out = PL.derive_terrain(cells, None, Grid(128, 128, 1.0), 1000.0, block=8)
    assert out.rdd.getNumPartitions() >= 2 * 16 and out.count() == 3 * 128 * 128


def test_tiles_are_worked_on_in_stacks_that_batches_may_cut(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random((13, 17)) < 0.1, np.nan, rng.normal(size=(13, 17)) * 100).astype("f4")
    grid = Grid(17, 13, 1.0, tile=4)
    cells = spark.createDataFrame(
        [("dem", r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(13) for c in range(17)],
        "channel string, row int, col int, value double",
    )
    tiles = T.pack_tiles(cells, grid).cache()
    for by_tile, by_cell, name in [
        (stencil.slope_tiles, stencil.slope(cells, grid), "slope"),
        (stencil.roughness_tiles, stencil.roughness(cells, grid), "roughness"),
    ]:
        want = {(r.row, r.col): r[name] for r in by_cell.select("row", "col", name).collect()}
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            try:
                out = by_tile(tiles, grid)
                assert "FlatMapGroups" not in plan(out)
                got = {(r.row, r.col): r.value for r in T.unpack_tiles(out, grid).collect()}
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert set(got) == set(want)
            for place, x in want.items():
                assert (got[place] is None) == (x is None) and (x is None or got[place] == pytest.approx(x, rel=1e-4, abs=1e-4))


def test_blend_of_large_grids_is_cut_into_more_tasks(spark, monkeypatch):
    cells = spark.range(128 * 128).select(
        F.floor(F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"),
        (F.col("id") % 90).cast("double").alias("lat"), (F.col("id") % 7).cast("double").alias("value"),
    )
    laser, held = cells.where("row % 5 > 0"), []
    monkeypatch.setattr(PL, "written", lambda df, name: held.append(df) or df)

    def blend(stereo):
        held.clear()
        PL.derive_terrain(laser, stereo, Grid(128, 128, 1.0), 1000.0, block=8)
        return held[0]

    for stereo in (cells.where("col % 3 > 0"), cells.where("col % 3 > 0").drop("lat")):
        whole = sorted(map(tuple, blend(stereo).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(blocks, "TASK_CELLS", 256)
            cut = blend(stereo)
            assert cut.rdd.getNumPartitions() >= 16
            assert sorted(map(tuple, cut.collect()), key=str) == whole


def test_stacking_sends_no_cells_by_channel(spark):
    cells = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("channel"), F.col("id").cast("int").alias("row"),
        F.lit(0).alias("col"), F.lit(1.0).alias("value"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables whose size Spark does not know to be small
    try:
        out = T.stack_channels(cells, cells.where("channel = 'a' AND row < 10").withColumn("value", F.lit(2.0)))
        assert "hashpartitioning(channel" not in plan(out)
        got = out.groupBy("channel", "value").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got)) == [("a", 2.0, 5), ("b", 1.0, 500)]


def hot(spark, n=3000):
    """Keys 0..n-1 of which a third are 0."""
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))


def test_hot_cell_in_the_mosaic(spark):
    obs = hot(spark).select(
        F.when(F.col("k") == 0, 0.5).otherwise(F.col("k") % 89 + 0.5).alias("lat"),
        F.lit(10.0).alias("lon"),
        (F.col("id") % 10 / 20 + 0.1).alias("b"),
        (F.col("id") % 60 + 5.0).alias("incidence"),
        F.lit(20.0).alias("emission"),
        F.lit(5.0).alias("phase"),
    )
    out = mosaic.mosaic(obs, Grid(360, 180, 1.0), ["b"])
    assert out.agg(F.sum("n_obs")).first()[0] == 3000
    rows = obs.where("lat = 0.5").toPandas()
    w = np.cos(np.radians(rows["incidence"]))
    cell = out.where("row = 89").first()
    assert cell["b"] == pytest.approx((w * rows["b"]).sum() / w.sum())


def test_hot_timestamp_keeps_every_left_row(spark):
    url = F.concat(F.lit("http://a/d/M3G20090101T"), F.lpad(F.col("k").cast("string"), 6, "0"))
    base = hot(spark).select(F.lit(0.0).alias("center_lat"), F.lit(0.0).alias("center_lon"), "id", "k")
    left = base.withColumn("external_url", F.concat(url, F.lit("_V01_L2.LBL")))
    right = base.withColumn("external_url", F.concat(url, F.lit("_V03_L1B.LBL")))
    assert C.pair_products(left, right, "id").count() == 3000


def test_hot_unit_and_zone(spark):
    cells = hot(spark).select(
        (F.col("k") % 5).cast("int").alias("tile_row"), F.lit(0).alias("tile_col"),
        F.when(F.col("k") == 0, 7).otherwise(F.col("k") % 4 + 1).cast("int").alias("unit_id"),
        F.col("id").cast("int").alias("idx"), F.lit(1).alias("mare"),
    )
    rows = {r["tile_row"]: r for r in zonal.zonal_units(cells).collect()}
    assert rows[0]["dominant_unit_id"] == 7 and rows[0]["n_geo_units"] == 5


def test_one_disk_over_a_third_of_the_grid(spark):
    rows = [(0, 0.0, 0.0, 2 * 1737.4 * 3.14159 / 360 * 130)] + [(i, 60.0, float(i), 40.0) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "crater_id int, lat double, lon double, diam_km double")
    cells = vector.crater_mask(df, Grid(360, 180, 1.0))
    assert cells.count() == cells.distinct().count() > 0.18 * 360 * 180


def test_batches_must_keep_their_size(spark):
    t = spark.range(10).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.col("id").alias("sample_id"),
        F.explode(F.array(F.lit("surface"), F.lit("radar"))).alias("group_name"),
        F.array(F.lit(1.0), F.col("id") * 0.1).alias("vec"),
    )
    assert features.alignment_scores(t, ["surface", "radar"], 10).first()["n_samples"] == 10
    with pytest.raises(Exception, match="holds more than"):
        features.alignment_scores(t, ["surface", "radar"], 9).collect()
