"""Writes that are complete or not there, and resuming what is not."""

import json

import pytest
from pyspark.sql import functions as F

from swathgrid.sources import publish


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbers(spark, a, b, parts=3):
    return spark.range(a, b, numPartitions=parts).select("id", (F.col("id") % 3).alias("k"))


def test_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish.publish_once(numbers(spark, 0, 10), path, ["k"])
    told = publish.manifest(spark, path)
    assert told["rows"] == 10 and sum(f["rows"] for f in told["files"].values()) == 10
    assert not publish.publish_once(numbers(spark, 50, 90), path, ["k"])
    assert spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("damage", ["no manifest", "no file", "short file", "more files", "torn manifest"])
def test_broken_targets_are_made_again(spark, tmp_path, damage):
    path = tmp_path / "t"
    publish.publish_once(numbers(spark, 0, 10), str(path))
    data = sorted(path.glob("*.parquet"))
    if damage == "no manifest":
        (path / publish.MANIFEST).unlink()
    elif damage == "no file":
        data[0].unlink()
    elif damage == "short file":
        data[0].write_bytes(data[0].read_bytes()[:-1])
    elif damage == "more files":
        (path / "x.parquet").write_bytes(data[0].read_bytes())
    else:
        (path / publish.MANIFEST).write_text(json.dumps({"rows": 1})[:-3])
    assert not publish.is_complete(spark, str(path))
    assert publish.publish_once(numbers(spark, 0, 20), str(path))
    assert rows_of(spark.read.parquet(str(path))) == rows_of(numbers(spark, 0, 20))


def test_failure_leaves_neither_target_nor_staging(spark, tmp_path):
    bad = numbers(spark, 0, 10).withColumn("id", F.when(F.col("id") == 7, F.raise_error("broken").cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        publish.publish_once(bad, str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []
    assert publish.publish_once(numbers(spark, 0, 0), str(tmp_path / "t"))
    assert publish.manifest(spark, str(tmp_path / "t"))["rows"] == 0


def test_resume(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    data = spark.range(60).select((F.col("id") % 6).cast("string").alias("k"), "id")
    part = data.where("k < 2")
    assert rows_of(publish.resume_by_key(part, path, "k")) == rows_of(part)
    # A run that breaks between its data and its keys leaves the keys to do.
    once = publish.publish_once
    monkeypatch.setattr(publish, "publish_once", lambda df, to, *a: once(df, to, *a) if "/data/" in to else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        publish.resume_by_key(data, path, "k")
    monkeypatch.undo()
    assert rows_of(publish.finished_rows(spark, path, data.schema)) == rows_of(part)
    changed = data.withColumn("id", F.col("id") + 1000).unionByName(spark.createDataFrame([(None, 1)], data.schema))
    got = publish.resume_by_key(changed, path, "k")
    assert rows_of(got) == rows_of(part.unionByName(changed.where("k >= 2")))
    assert rows_of(publish.finished_keys(spark, path, "k", "string")) == [(str(k), 10) for k in range(6)]
    assert len(publish.sweep(spark, path)) == 1
    assert rows_of(publish.resume_by_key(data, path, "k")) == rows_of(got)
