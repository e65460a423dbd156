"""Conditions answered by reading less, and rasters written in one commit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, Not, StringStartsWith

from swathgrid.sources import binary
from swathgrid.sources.pushdown import Selection, common, joined, without
from swathgrid.sources.writers import COMMITTED, FlatRasterWriter, write_rasters


def test_ranges():
    assert joined([3, 1, 2, 7]) == [(1, 4), (7, 8)]
    assert common([(0, 5), (8, 20)], [(3, 10)]) == [(3, 5), (8, 10)]
    assert without([(0, 10)], [(0, 1), (5, 6), (9, 10)]) == [(1, 5), (6, 9)]
    assert without([(0, 10)], []) == [(0, 10)]


def test_only_whole_answers_are_taken():
    s = Selection(("line",), ("file",), ("sampled",))
    left = [Not(EqualTo(("line",), 3)), EqualTo(("bands",), 1), GreaterThan(("line",), 2.5), EqualTo(("line",), True), StringStartsWith(("line",), "1")]
    taken = [GreaterThanOrEqual(("line",), -4), LessThan(("line",), 9), In(("line",), (1, 7, 12)), IsNotNull(("file",))]
    taken += [EqualTo(("sampled",), True), In(("file",), ("a", "b")), StringStartsWith(("file",), "a")]
    assert list(s.push([*left, *taken])) == left
    assert s.within("line", 100) == [(1, 2), (7, 8)] and s.flags["sampled"] == {True}
    assert [n for n in ("a", "b", "ab") if s.has_name("file", n)] == ["a"]
    assert list(s.push([GreaterThan(("line",), 1 << 70)])) == [] and s.within("line", 100) == []


LINES, BANDS, SAMPLES = 41, 6, 7


@pytest.fixture
def cubes(tmp_path):
    data = np.arange(3 * LINES * BANDS * SAMPLES, dtype="<f4").reshape(3, LINES, BANDS, SAMPLES)
    rows = []
    for i, cube in enumerate(data):
        (tmp_path / f"s{i}.img").write_bytes(b"head" + cube.tobytes())
        rows.append((f"s{i}", str(tmp_path / f"s{i}.img"), LINES, BANDS, SAMPLES, 4, 0, 4))
    return data, rows


def manifest_of(spark, rows, path):
    names = "strip_id string, img_path string, lines int, bands int, samples int, data_type int, byte_order int, header_offset int"
    spark.createDataFrame(rows, names).write.parquet(path)
    return path


def reads(monkeypatch):
    sizes, fetch = [], binary._fetch
    monkeypatch.setattr(binary, "_fetch", lambda f, start, size: sizes.append(size) or fetch(f, start, size))
    return sizes


def test_bytes_read(spark, cubes, tmp_path, monkeypatch):
    _, rows = cubes
    path, sizes = manifest_of(spark, rows, str(tmp_path / "m")), reads(monkeypatch)

    def read(filters, **options):
        reader = binary.BilCube({"manifest": path, "select": "2", "pushdown": "true", **options}).reader(None)
        assert list(reader.pushFilters(filters)) == []
        sizes.clear()
        parts = reader.partitions()
        return len(parts), sum(b.num_rows for p in parts for b in reader.read(p)), sum(sizes)

    line = SAMPLES * 4
    assert read([]) == (2, 3 * LINES * SAMPLES, 3 * LINES * line)
    assert read([], linesPerTask=10) == (13, 3 * LINES * SAMPLES, 3 * LINES * line)
    # The daytime filter: three lines a cube, all in one task.
    assert read([EqualTo(("sampled",), True)]) == (1, 9 * SAMPLES, 9 * line)
    assert read([EqualTo(("sampled",), False)])[1] == 3 * (LINES - 3) * SAMPLES
    assert read([EqualTo(("file",), "s1"), GreaterThan(("line",), 38)]) == (1, 2 * SAMPLES, 2 * line)
    assert read([In(("line",), (5, 6, 90)), GreaterThanOrEqual(("sample",), 4)]) == (1, 18, 6 * 12)
    assert read([EqualTo(("line",), 1000)]) == (1, 0, 0)
    assert read([EqualTo(("sampled",), True), EqualTo(("sampled",), False)])[1:] == (0, 0)


def test_spark_pushes_and_agrees(spark, cubes, tmp_path):
    data, rows = cubes
    binary.register(spark)
    path = manifest_of(spark, rows, str(tmp_path / "m"))

    def load():
        return spark.read.format("envi_bil").options(manifest=path, select="3,0", linesPerTask=10, pushdown=True).load()

    assert load().rdd.getNumPartitions() == 13
    hit = load().where("sampled AND sample > 2 AND file IN ('s0', 's2')")
    assert hit.rdd.getNumPartitions() == 1
    want = {(f"s{i}", n, j): [data[i, n, 3, j], data[i, n, 0, j]] for i in (0, 2) for n in (0, 20, 40) for j in range(3, SAMPLES)}
    assert {(r.file, r.line, r.sample): r.bands for r in hit.collect()} == want
    odd = load().where("line % 2 = 1 AND line <= 3 AND NOT sampled AND bands[1] >= 0")
    assert sorted({(r.file, r.line) for r in odd.collect()}) == [(f"s{i}", n) for i in range(3) for n in (1, 3)]
    given = binary.scan(spark, "envi_bil", {"sampled": True, "sample": [(3, 99)], "file": ["s0", "s2"]}, manifest=path, select="3,0")
    assert {(r.file, r.line, r.sample): r.bands for r in given.collect()} == want
    with pytest.raises(Exception, match="no condition on depth"):
        binary.scan(spark, "envi_bil", {"depth": [(0, 1)]}, manifest=path, select="0").collect()


def test_one_scan_with_several_conditions(spark, cubes, tmp_path):
    # Spark shares what was pushed last between the uses of a source, so nothing is pushed unasked.
    _, rows = cubes
    binary.register(spark)
    path = manifest_of(spark, rows, str(tmp_path / "m"))
    df = spark.read.format("envi_bil").options(manifest=path, select="0").load()
    both = df.where("line = 3").unionByName(df.where("line = 4"))
    assert sorted({r.line for r in both.collect()}) == [3, 4]
    assert df.count() == 3 * LINES * SAMPLES
    parts = [binary.scan(spark, "envi_bil", {"line": [(n, n + 1)]}, manifest=path, select="0") for n in (3, 4)]
    assert sorted({r.line for r in parts[0].unionByName(parts[1]).collect()}) == [3, 4]


def test_sampled_lines_of_a_manifest(spark, cubes):
    data, rows = cubes
    names = "strip_id string, img_path string, lines int, bands int, samples int, data_type int, byte_order int, header_offset int"
    manifest = binary.with_sampled_lines(spark.createDataFrame(rows, names))
    got = {(r.strip_id, r.line, r.sample): r.x for r in binary.read_cubes(manifest, {"x": 4}).collect()}
    assert got == {(f"s{i}", n, j): data[i, n, 4, j] for i in range(3) for n in (0, 20, 40) for j in range(SAMPLES)}


def test_manifest_checks_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "FALLBACK_SHAPES", [(4, 2)])
    good, wrong = np.arange(6, dtype=">f4").reshape(2, 3), np.arange(8, dtype=">f4").reshape(2, 4)
    for name, data in (("good", good), ("wrong", wrong)):
        (tmp_path / f"{name}.img").write_bytes(data.tobytes())
        (tmp_path / f"{name}.lbl").write_text('LINES = 2 <lines>\nLINE_SAMPLES = "3"\nSAMPLE_TYPE = "MSB_REAL"\n')
    cells = binary.read_cubes(binary.flat_manifest(spark, str(tmp_path / "*.lbl")), {"value": 0})
    got = {(r.strip_id, r.line, r.sample): r.value for r in cells.collect()}
    want = {(n, i, j): d[i, j] for n, d in (("good", good), ("wrong", wrong)) for i in range(2) for j in range(d.shape[1])}
    assert got == want
    same = binary.raster_layout(str(tmp_path / "wrong.img"), str(tmp_path / "wrong.lbl"))
    assert (same.lines, same.samples, same.dtype) == (2, 4, ">f4")
    (tmp_path / "good.img").write_bytes(b"12345")
    with pytest.raises(Exception, match="fits no known raster shape"):
        binary.flat_manifest(spark, str(tmp_path / "*.lbl")).collect()


# ---- sink ----------------------------------------------------------------------------------


def cells_of(spark, data, channels=("a", "b")):
    rows = [(c, i, j, float(v) + k) for k, c in enumerate(channels) for (i, j), v in np.ndenumerate(data) if v >= 0]
    return spark.createDataFrame(rows, "channel string, row int, col int, value double")


@pytest.mark.parametrize("big", [True, False])
def test_rasters_round_trip(spark, tmp_path, big):
    binary.register(spark)
    data = np.arange(77.0).reshape(11, 7)
    data[3, 2] = data[10, 6] = -1
    path = str(tmp_path / "out")
    write_rasters(cells_of(spark, data), path, 7, 11, 4, big_endian=big)
    back = spark.read.format("flat_raster").load(path)
    got = {(r.file, r.row, r.col): r.value for r in back.collect()}
    want = {(f"{c}/part-{i // 4}.img", i % 4, j): v + k if v >= 0 else None for k, c in enumerate("ab") for (i, j), v in np.ndenumerate(data)}
    assert got == want
    assert json.loads((tmp_path / "out" / COMMITTED).read_text()) == {"files": 6, "lines": 22}
    rows = spark.read.format("flat_raster").option("pushdown", True).load(path).where("file LIKE 'b/%' AND row = 1")
    assert {r.file for r in rows.collect()} == {f"b/part-{i}.img" for i in range(3)}
    write_rasters(cells_of(spark, data, ("c",)), path, 7, 11, 11, mode="overwrite", big_endian=big)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.img")) == ["part-0.img"]
    assert not list((tmp_path / "out").glob("_staging*"))


def test_failed_job_leaves_nothing(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "out")
    data = np.arange(40.0).reshape(8, 5)
    bad = cells_of(spark, data, ("a",)).withColumn("value", F.when(F.col("row") == 7, F.raise_error("broken").cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_rasters(bad, path, 5, 8, 2)
    with pytest.raises(Exception, match="outside"):
        write_rasters(cells_of(spark, data, ("a",)), path, 5, 6, 2)
    # Rows of one part in two tasks: no task can know, the commit does.
    torn = cells_of(spark, data, ("a",)).repartition(2, "col").select("channel", "row", "col", F.col("value").cast("float").alias("value"))
    with pytest.raises(Exception, match="more than one task"):
        torn.sortWithinPartitions("row").write.format("flat_raster").options(width=5, height=8, rowsPerFile=8).mode("append").save(path)
    assert [p for p in (tmp_path / "out").rglob("*")] == []


def test_files_of_tasks_that_were_not_accepted_are_not_published(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": [0, 1], "col": [0, 0], "value": pa.array([1.0, 2.0], pa.float32())})
    schema = spark.createDataFrame([], "row int, col int, value float").schema
    writer = FlatRasterWriter({"path": str(tmp_path / "o"), "width": 1, "height": 2, "rowsPerFile": 2}, schema, False)
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.files[0][4] != again.files[0][4]
    writer.commit([None, again])
    assert sorted(p.name for p in (tmp_path / "o").rglob("*")) == [COMMITTED, "part-0.img", "part-0.lbl"]
