"""Shared scratch space: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The configured checkpoint folder; one is made only where none is set, as in local runs."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="swathgrid-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Write a table; the shuffle files made for it go at once, else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Write to a table in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    write(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, path: str) -> None:
    """Remove a table that this library wrote under the shared folder and that nothing reads any more."""
    if not path.startswith(checkpoint_root(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} does not lie in the shared folder")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
