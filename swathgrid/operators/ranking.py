"""Exact ranks and quantiles that never gather a key in one task.

A plain window over a hot key sorts all of it in one task. Here the key is cut into ordered
buckets first; bucket counts (few rows) are accumulated, and only rows inside one bucket are
ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.sources.workspace import checkpointed

# A side up to this many rows is shipped to every task; beyond it Spark joins by shuffle.
SMALL_ROWS = 200_000
# An interval with up to this many values is ordered by one task.
DIRECT_ROWS = 100_000


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """Cut lineage through the checkpoint directory and tell the row count."""
    done = checkpointed(df)
    return done, done.count()


def small_join(
    big: DataFrame, small: DataFrame, rows: int, on: str | list[str], how: str = "inner"
) -> DataFrame:
    """Ship the counted side to every task if it is small; else leave the join to Spark."""
    return big.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


def counted_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """:func:`small_join` with a side that is stored first, so that counting it costs nothing."""
    done, rows = settle(small)
    return small_join(big, done, rows, on, how)


def hash_rank(df: DataFrame, keys: list[str], digest: str, tie: str) -> DataFrame:
    """1-based ``rank`` by a hex digest within keys, and the key's size ``n_in_key``.

    The first four digits spread each key over 65 536 ordered buckets. Counts per bucket are
    summed up in order; a row's rank is its bucket's start plus its place in the bucket.
    """
    b = df.withColumn("_b", F.substring(digest, 1, 4))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*keys)
    starts = counts.select(
        *keys,
        "_b",
        (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole).alias("n_in_key"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(digest, tie))
    return (
        b.join(starts, [*keys, "_b"])
        .withColumn("rank", F.col("_start") + inside)
        .drop("_b", "_start", digest)
    )


def first_by_hash(df: DataFrame, keys: list[str], digest: str, tie: str, n: int) -> DataFrame:
    """The first n rows per key in digest order.

    ``row_number() <= n`` lets Spark cut every task's share to n rows per key before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(digest, tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _bucket(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Ordered bucket 0..n-1 of a value in [lo, hi]; never decreases as v grows."""
    share = F.when(hi > lo, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(0.0)
    return F.least(F.floor(share * n), F.lit(n - 1)).cast("int")


def _squash(v: Column) -> Column:
    """Order-preserving compression, so that a few huge values do not empty the buckets."""
    return F.signum(v) * F.log1p(F.abs(v))


def quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    keys: list[str] = (),
    buckets: int = 4096,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: (keys, n, prob, quantile).

    Each round counts values per bucket and key, which combines before the shuffle, and narrows
    every wanted rank to one bucket. Rounds go on until the intervals left are small enough for
    one task each; the values in them are counted and ordered within their interval. All rounds
    read ``df`` again, so it should be a stored table where it is costly to compute.
    """
    keys = list(keys) or ["_all"]
    span = [*keys, "lo", "hi"]
    vals = df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    vals = vals.select(*keys, F.col(value).cast("double").alias("_v"))
    size = vals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    grid = size.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = grid.withColumn("at", F.col("prob") * (F.col("n") - 1)).select(
        *span,
        "n",
        "prob",
        "at",
        F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"),
        F.lit(0).cast("bigint").alias("below"),
        F.col("n").alias("held"),
    )

    def settled(df):
        """The targets with their number, and the most rows that one open interval holds."""
        done = checkpointed(df)
        open_rows = F.max(F.when(F.col("lo") < F.col("hi"), F.col("held")))
        rows, held = done.agg(F.count(F.lit(1)), open_rows).first()
        return done, rows, held or 0

    targets, n_targets, held = settled(wanted)
    scale = _squash
    # From the second round on, the ends of an interval fall into different buckets, so each round narrows it.
    while held > direct_rows:
        spans = targets.select(*span).distinct()
        hit = small_join(vals, spans, n_targets, keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bucket = _bucket(scale(F.col("_v")), scale(F.col("lo")), scale(F.col("hi")), buckets)
        scale = lambda c: c
        counts = (
            hit.withColumn("_b", bucket)
            .groupBy(*span, "_b")
            .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2"))
        )
        upto = F.sum("c").over(W.partitionBy(*span).orderBy("_b"))
        counts = counts.withColumn("upto", upto)
        inside = F.col("rank") - F.col("below")
        step = targets.join(counts, span).where(
            (inside >= F.col("upto") - F.col("c")) & (inside < F.col("upto"))
        )
        targets, n_targets, held = settled(
            step.select(
                *keys,
                F.col("lo2").alias("lo"),
                F.col("hi2").alias("hi"),
                "n",
                "prob",
                "at",
                "rank",
                (F.col("below") + F.col("upto") - F.col("c")).alias("below"),
                F.col("c").alias("held"),
            )
        )
    spans = targets.select(*span).distinct()
    hit = small_join(vals, spans, n_targets, keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    by_value = hit.groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("c"))
    by_value = by_value.withColumn("upto", F.sum("c").over(W.partitionBy(*span).orderBy("_v")))
    inside = F.col("rank") - F.col("below")
    found = targets.join(by_value, span).where(
        (inside >= F.col("upto") - F.col("c")) & (inside < F.col("upto"))
    )
    ends = found.groupBy(*keys, "n", "prob", "at").agg(
        F.min_by("_v", "rank").alias("v0"), F.max_by("_v", "rank").alias("v1")
    )
    q = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.floor("at"))
    return ends.select(*[k for k in keys if k != "_all"], "n", "prob", q.alias("quantile"))
