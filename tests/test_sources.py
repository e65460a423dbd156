"""Binary files, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators import mosaic as M
from swathgrid.operators import tiles as T
from swathgrid.sources import binary
from swathgrid.sources import tables as IO
from swathgrid.sources.workspace import checkpoint_root, scratch
from swathgrid.streaming import jobs

GRID = Grid(72, 36, 0.2)


def test_flat_raster_byte_orders_and_size_check(spark, tmp_path):
    binary.register(spark)
    data = np.array([[1.5, np.nan, 3.0], [4.0, np.inf, -6.0]])
    for kind, order in (("IEEE_REAL", ">f4"), ("MSB_REAL", ">f4"), ("PC_REAL", "<f4"), ("LSB_X", "<f4")):
        (tmp_path / f"{kind}.img").write_bytes(data.astype(order).tobytes())
        (tmp_path / f"{kind}.lbl").write_text(f"LINES = 2\nLINE_SAMPLES = 3\nSAMPLE_TYPE = {kind}\n")
        df = spark.read.format("flat_raster").option("label", str(tmp_path / f"{kind}.lbl"))
        rows = df.option("rowsPerTask", 1).load(str(tmp_path / f"{kind}.img")).orderBy("row", "col").collect()
        assert [r["value"] for r in rows] == [1.5, None, 3.0, 4.0, None, -6.0]
    assert spark.read.format("flat_raster").load(str(tmp_path)).count() == 24
    (tmp_path / "short.img").write_bytes(b"1234")
    with pytest.raises(ValueError, match="fit no known raster"):
        binary.raster_layout(str(tmp_path / "short.img"))


def test_many_small_steps_make_a_bounded_number_of_tasks(spark, tmp_path):
    binary.register(spark)
    for i in range(70):
        np.arange(30, dtype="<f4").reshape(10, 3).__add__(100 * i).astype("<f4").tofile(tmp_path / f"part-{i}.img")
        (tmp_path / f"part-{i}.lbl").write_text("LINES = 10\nLINE_SAMPLES = 3\nSAMPLE_TYPE = PC_REAL\n")
    df = spark.read.format("flat_raster").option("rowsPerTask", 1).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 350  # 700 lines, two a task
    got = {(r.file, r.row, r.col): r.value for r in df.collect()}
    assert got == {(f"part-{i}.img", k // 3, k % 3): 100.0 * i + k for i in range(70) for k in range(30)}
    reader = binary._FlatRasterReader({"path": str(tmp_path), "rowsPerTask": "2", "where": '{"file": ["part-3.img"]}'})
    assert len(reader.partitions()) == 5  # few steps stay as asked for
    reader = binary._FlatRasterReader({"path": str(tmp_path), "rowsPerTask": "2"})
    reader.layouts = lambda: iter([binary.Layout("wide", "wide", 1200, 1, 1 << 20, "<f4")])
    assert len(reader.partitions()) == 600  # enough to read: two lines have 8 MB


@pytest.mark.parametrize("code,dtype", [(1, "u1"), (2, "i2"), (4, "f4"), (5, "f8"), (12, "u2"), (99, "f4")])
@pytest.mark.parametrize("order", [0, 1])
def test_cube_types_offsets_and_band_ranges(spark, tmp_path, code, dtype, order):
    cube = np.arange(3 * 6 * 4).reshape(3, 6, 4)
    raw = b"head" + cube.astype((">" if order else "<") + dtype).tobytes()
    (tmp_path / "a.img").write_bytes(raw)
    (tmp_path / "a.hdr").write_text(
        f"ENVI\nsamples = 4\nlines = 3\nbands = 6\nheader offset = 4\ndata type = {code}\nbyte order = {order}\n"
    )
    manifest = binary.cube_headers(spark, str(tmp_path / "*.hdr")).select(
        "*", F.lit("s").alias("strip_id"), F.lit(str(tmp_path / "a.img")).alias("img_path")
    )
    rows = binary.read_cubes(manifest, {"x": 5, "y": 0}, lines_per_task=2).collect()
    got = {(r["line"], r["sample"]): (r["x"], r["y"]) for r in rows}
    assert got == {(i, j): (cube[i, 5, j], cube[i, 0, j]) for i in range(3) for j in range(4)}


def test_cube_data_source(spark, tmp_path):
    binary.register(spark)
    cube = np.arange(5 * 3 * 2, dtype="<f4").reshape(5, 3, 2)
    (tmp_path / "c.img").write_bytes(cube.tobytes())
    df = spark.read.format("envi_bil").options(lines=5, bands=3, samples=2, select="2,0", linesPerTask=2)
    got = {(r["line"], r["sample"]): r["bands"] for r in df.load(str(tmp_path / "c.img")).collect()}
    assert got == {(i, j): [cube[i, 2, j], cube[i, 0, j]] for i in range(5) for j in range(2)}


def test_far_bands_are_read_apart():
    assert binary._runs([81, 8, 80], 100_000) == [(8, 8), (80, 81)]
    assert binary._runs([0, 3], 100) == [(0, 3)]


def test_checkpoint_folder_of_the_session_is_used(spark):
    root = checkpoint_root(spark)
    assert checkpoint_root(spark) == root
    a, b = scratch(spark, "t"), scratch(spark, "t")
    assert a != b and a.startswith(root.rstrip("/"))


def test_layer_and_column_choice(spark):
    assert IO.pick_layer(["contacts", "My_GeoUnits", "units"]) == "My_GeoUnits"
    assert IO.pick_layer(["unit_contact", "z_units"]) == "z_units"
    assert IO.pick_layer(["b", "a"]) == "a"
    df = spark.createDataFrame([("p", "q", 1)], "wkt string, name string, UNIT int")
    assert IO.unit_column(df) == "UNIT"
    assert IO.unit_column(df.drop("UNIT")) == "name"
    with pytest.raises(ValueError, match="no column"):
        IO.resolve(["a"], {"lat": ["Lat"]})


def test_rewriting_one_partition_keeps_others(spark, tmp_path):
    path = str(tmp_path / "p")
    IO.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    IO.replace_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def strips(spark, n, seed):
    rng = F.rand(seed)
    return spark.range(n).select(
        (F.pmod("id", F.lit(170)) - 85.0).cast("double").alias("lat"),
        (F.col("id") * 7 % 360).cast("double").alias("lon"),
        (F.round(rng, 3) * 0.8 + 0.1).alias("b"),
        F.lit(30.0).alias("incidence"),
        F.lit(20.0).alias("emission"),
        F.lit(10.0).alias("phase"),
    )


def mosaic_rows(df):
    return sorted((r["row"], r["col"], round(r["b"], 9), r["n_obs"]) for r in df.collect())


def test_stream_restart_counts_each_file_once(spark, tmp_path):
    src, sink, log = (str(tmp_path / n) for n in ("in", "sums", "log"))
    strips(spark, 300, 1).write.parquet(src)
    schema = strips(spark, 1, 1).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        job = jobs.stream_mosaic(stream, GRID, ["b"], sink, log)
        return jobs.drain(job, lambda: spark.read.parquet(sink).drop("batch"))

    run()
    strips(spark, 200, 2).write.mode("append").parquet(src)
    sums = run()
    run()
    batch = M.mosaic(spark.read.parquet(src), GRID, ["b"])
    assert mosaic_rows(jobs.current_mosaic(sums, ["b"])) == mosaic_rows(batch)
    target = str(tmp_path / "folded")
    jobs.compact(sums, target, 0)
    folded = spark.read.parquet(target).drop("batch")
    assert mosaic_rows(jobs.current_mosaic(folded, ["b"])) == mosaic_rows(batch)


def test_stream_stats_over_several_batches(spark, tmp_path):
    src = str(tmp_path / "cells")
    cells = spark.range(1000).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("channel"), (F.col("id") % 97).cast("double").alias("value")
    )
    cells.repartition(5).write.parquet(src)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(src)
    sink = str(tmp_path / "out")
    job = jobs.stream_stats(stream, sink, str(tmp_path / "log"))
    got = {r["channel"]: r for r in jobs.current_stats(jobs.drain(job, lambda: spark.read.parquet(sink))).collect()}
    want = cells.groupBy("channel").agg(F.count("value"), F.avg("value"), F.stddev_pop("value")).collect()
    for channel, n, mean, std in want:
        assert got[channel]["n"] == n
        assert got[channel]["mean"] == pytest.approx(mean) and got[channel]["std"] == pytest.approx(std)


def test_mosaic_does_not_depend_on_order(spark):
    df = strips(spark, 500, 3)
    a = M.mosaic(df, GRID, ["b"])
    b = M.mosaic(df.orderBy(F.desc("lat")).repartition(7), GRID, ["b"])
    assert mosaic_rows(a) == mosaic_rows(b)


def test_tiles_round_trip(spark, tmp_path):
    grid = Grid(10, 10, 1.0, tile=5)
    cells = spark.range(100).select(
        F.lit("slope").alias("channel"), F.floor(F.col("id") / 10).cast("int").alias("row"),
        (F.col("id") % 10).cast("int").alias("col"), F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("value"),
    )
    path = str(tmp_path / "tiles")
    IO.write_tiles(T.pack_tiles(cells, grid), path)
    back = T.unpack_tiles(IO.read_tiles(spark, path), grid)
    key = lambda r: (r["row"], r["col"], r["value"])
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, cells.collect()), key=str)
    window = T.read_window(IO.read_tiles(spark, path), grid, 4, 4, 2, 3)
    assert window.count() == 6


def test_sketches_of_batches_merge(spark, tmp_path):
    src, sink = str(tmp_path / "cells"), str(tmp_path / "sketches")
    cells = spark.range(20_000).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("channel"),
        F.when(F.col("id") % 50 > 1, ((F.col("id") * 7919) % 20_011).cast("double")).alias("value"),
    )
    cells.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(src)
    job = jobs.stream_sketches(stream, sink, str(tmp_path / "log"))
    sketches = jobs.drain(job, lambda: spark.read.parquet(sink))
    assert sketches.select("batch").distinct().count() == 3
    jobs.compact_sketches(sketches, str(tmp_path / "folded"), 0)
    for source in (sketches, spark.read.parquet(str(tmp_path / "folded"))):
        for r in jobs.current_quantiles(source, [0.01, 0.5, 0.99]).collect():
            own = sorted(x.value for x in cells.where(F.col("channel") == r.channel).collect() if x.value is not None)
            assert r.n == len(own)
            assert abs(np.searchsorted(own, r.quantile) / len(own) - r.prob) < 0.03
