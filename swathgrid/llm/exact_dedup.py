"""Exact deduplication by an extendible-hash index on shared files.

The directory has one slot per hash prefix. A bucket with more keys than its capacity is split on
the next bit, which doubles the directory where needed. Both steps are sums over key prefixes, so
the whole directory comes from one aggregate. Slots are at most 2 ** max_depth, which is
the proven bound for broadcasting them; a bucket that is still overfull there simply chains.
Within a bucket, texts chain by hash key, and grouping compares their bytes. Every task combines
its own copies first, so a text that a third of all rows share costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import id_and_text
from swathgrid.sources.workspace import written


def hash_key(text: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text)


def directory(keys: DataFrame, key_bits: int, capacity: int, max_depth: int) -> DataFrame:
    """Slots of the directory: cell (prefix of max_depth bits), bucket (its first cell), depth (local depth).

    `keys` holds distinct hash keys in column `h`. A cell belongs to the shallowest bucket around it
    that holds `capacity` keys at most.
    """
    cells = keys.groupBy(F.shiftrightunsigned("h", key_bits - max_depth).alias("cell")).agg(
        F.count(F.lit(1)).alias("keys")
    )
    levels = cells.select("cell", "keys", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn(
        "bucket", F.expr(f"shiftleft(shiftrightunsigned(cell, {max_depth} - depth), {max_depth} - depth)")
    )
    held = levels.groupBy("depth", "bucket").agg(F.sum("keys").alias("held"))
    fits = held.filter((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return (
        levels.join(fits, ["depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket", "held")).alias("leaf"))
        .select("cell", "leaf.bucket", "leaf.depth", "leaf.held")
    )


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    key_bits: int = 64,
    capacity: int = 8192,
    max_depth: int = 14,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. The row with the largest id stays. Null text is empty
    text, so all null and empty texts are one group. A null id never wins over a number; in a group
    of null ids only, keep_id is null and all rows are kept. Rows that repeat id and text count in
    group_size and share one decision. An empty table gives an empty result; other columns are not
    read. `key_bits` under 64 makes hash keys collide on purpose, which tests use.
    """
    rows = id_and_text(docs, key, text).withColumn("h", hash_key(F.col("text"), key_bits))
    row_file = written(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")), "dedup-rows")
    slots = written(
        directory(row_file.select("h").distinct(), key_bits, capacity, max_depth).select("cell", "bucket"),
        "dedup-directory",
    )
    chains = (
        rows.withColumn("cell", F.shiftrightunsigned("h", key_bits - max_depth))
        .join(F.broadcast(slots), "cell")
        .groupBy("bucket", "h", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    index = written(
        chains.repartition(F.col("bucket")).sortWithinPartitions("bucket", "h", "text_sha256"), "dedup-index"
    )
    return row_file.join(index.drop("bucket"), ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
