"""Targets that are complete or not there: staged writes, a manifest of what was written, one rename.

A folder counts as complete if its manifest is there and every file it names has the size it tells. A folder without a
manifest is what a broken job left, and is made again. On stores without an atomic rename the manifest, which is moved with the
folder, still tells a torn move from a whole one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


class _Files:
    """The cluster's own file system at a path, so any address Spark can write to works."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def sizes(self, path: str) -> dict[str, int]:
        """Size of every data file below a folder by its name relative to it."""
        root = self.fs.makeQualified(self._path(path)).toUri().getPath().rstrip("/") + "/"
        out, files = {}, self.fs.listFiles(self._path(path), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toUri().getPath().removeprefix(root)
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                out[name] = status.getLen()
        return out

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)) if s.isDirectory())

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        self.fs.mkdirs(self._path(target).getParent())
        return self.fs.rename(self._path(source), self._path(target))

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What was written: ``rows``, ``schema``, and ``files`` with the size and rows of each. None without a readable one."""
    files = _Files(spark, path)
    if not files.exists(f"{path}/{MANIFEST}"):
        return None
    try:
        return json.loads(files.read(f"{path}/{MANIFEST}"))
    except ValueError:
        return None
    except Py4JJavaError as e:
        if "ChecksumException" in str(e.java_exception):  # torn, and the store noticed
            return None
        raise


def is_complete(spark: SparkSession, path: str) -> bool:
    told = manifest(spark, path)
    return told is not None and {n: f["bytes"] for n, f in told["files"].items()} == _Files(spark, path).sizes(path)


def publish_once(df: DataFrame, path: str, partition_by: list[str] = ()) -> bool:
    """Write unless the target is complete; tells whether it wrote.

    Data goes to a folder beside the target, is counted file by file from there, and is renamed when its manifest is in it. What a broken job
    left at the target is removed just before. If another job publishes meanwhile, its result stays.
    """
    spark, files = df.sparkSession, _Files(df.sparkSession, path)
    if is_complete(spark, path):
        return False
    path = path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(staging)
        stored = spark.read.schema(df.schema).parquet(staging)
        where = F.substring_index("_metadata.file_path", staging.rsplit("/", 1)[-1] + "/", -1)
        rows = dict(stored.groupBy(F.url_decode(where).alias("f")).agg(F.count(F.lit(1))).collect())
        sizes = files.sizes(staging)
        told = {n: {"bytes": size, "rows": rows.get(n, 0)} for n, size in sizes.items()}
        text = {"rows": sum(rows.values()), "schema": df.schema.simpleString(), "files": told}
        files.write(f"{staging}/{MANIFEST}", json.dumps(text))
        if files.exists(path) and not is_complete(spark, path):
            files.remove(path)
        if not files.exists(path) and files.move(staging, path):
            return True
        if is_complete(spark, path):
            return False
        raise OSError(f"{path} could not be published")
    finally:
        files.remove(staging)


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Batches whose list of keys was published; data of others is what a broken job left."""
    keys = f"{path}/keys"
    return [b for b in _Files(spark, path).folders(keys) if b.startswith("batch=") and is_complete(spark, f"{keys}/{b}")]


def _read(spark: SparkSession, path: str, part: str, schema) -> DataFrame:
    found = [f"{path}/{part}/{b}" for b in _batches(spark, path)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def finished_keys(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """key, n: the keys that are complete below a path, and their rows. ``kind`` is the key's type."""
    return _read(spark, path, "keys", f"`{key}` {kind}, n bigint")


def resume_by_key(df: DataFrame, path: str, key: str) -> DataFrame:
    """Add the keys of ``df`` that are not finished below ``path``; gives all finished rows.

    Each run is a batch: first its data is published, then the list of its keys, with their rows counted from the data. Only the list makes
    a key finished, so a run that breaks anywhere leaves its keys to do. Rows of a key always come from one run; those with a null key are
    never finished and are not stored.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    path = path.rstrip("/")
    done = finished_keys(spark, path, key, kind).select(key)
    todo = df.where(F.col(key).isNotNull()).join(done, key, "left_anti").select(*df.columns)
    batch = f"batch={uuid.uuid4().hex}"
    publish_once(todo, f"{path}/data/{batch}")
    stored = spark.read.schema(df.schema).parquet(f"{path}/data/{batch}")
    publish_once(stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")), f"{path}/keys/{batch}")
    return finished_rows(spark, path, df.schema)


def finished_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, path, "data", schema)


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove the data of batches that were never finished. Not for use while a job writes there."""
    files, kept = _Files(spark, path), set(_batches(spark, path))
    gone = [f"{path}/{part}/{b}" for part in ("data", "keys") for b in files.folders(f"{path}/{part}") if b not in kept]
    for folder in gone:
        files.remove(folder)
    return gone
