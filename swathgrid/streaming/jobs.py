"""Incremental mosaic, running channel statistics and strip admission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swathgrid.constants import MAX_INCIDENCE_DEG
from swathgrid.grid import Grid
from swathgrid.operators.accumulate import BLOCK, merge_tiles, tile_cells, tile_sums
from swathgrid.operators.mosaic import finalise, merge_sums, usable_observations, weighted_sums


def stream_mosaic(
    strips: DataFrame, grid: Grid, bands: list[str], sink: str, checkpoint: str,
    lat: str = "lat", lon: str = "lon", trigger: dict | None = None,
) -> StreamingQuery:
    """Write the weighted sums of every batch under its own batch folder.

    The job keeps no state: sums of batches add up. A batch that runs again after a failure
    replaces its own folder, so each strip counts once. Read the mosaic with
    :func:`current_mosaic`.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        weighted_sums(batch, bands).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    usable = usable_observations(strips, grid, bands, lat, lon)
    return (
        usable.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact(source: DataFrame, target: str, batch: int) -> None:
    """Fold the sums of finished batches into one folder of a new sink."""
    merge_sums(source).write.mode("overwrite").parquet(f"{target}/batch={batch}")


def current_mosaic(partials: DataFrame, bands: list[str]) -> DataFrame:
    return finalise(merge_sums(partials), bands)


def stream_tiles(
    strips: DataFrame, grid: Grid, bands: list[str], sink: str, checkpoint: str,
    lat: str = "lat", lon: str = "lon", block: int = BLOCK, trigger: dict | None = None,
) -> StreamingQuery:
    """As :func:`stream_mosaic`, but a batch writes one row a tile; read with :func:`current_tiles`."""

    def store(batch: DataFrame, batch_id: int) -> None:
        merge_tiles(tile_sums(batch, grid, bands, block), bands, block).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    usable = usable_observations(strips, grid, bands, lat, lon)
    return (
        usable.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_tiles(partials: DataFrame, grid: Grid, bands: list[str], block: int = BLOCK) -> DataFrame:
    return finalise(tile_cells(merge_tiles(partials, bands, block), grid, bands, block), bands)


def stream_stats(cells: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running n, mean, deviation, min and max per channel; state is one row per channel."""
    v = F.col("value")
    running = cells.groupBy("channel").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        running.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_stats(updates: DataFrame) -> DataFrame:
    """Latest row per channel with mean and population deviation."""
    rest = [c for c in updates.columns if c not in ("channel", "batch")]
    last = updates.groupBy("channel").agg(*[F.max_by(c, "batch").alias(c) for c in rest])
    return last.select("channel", "n", "min", "max", "mean", "std")


def stream_sketches(cells: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Quantile sketches (KLL) of every batch and channel, each batch under its own folder.

    The job keeps no state: sketches merge on reading, in any order. A batch that runs again replaces
    its own folder. A sketch takes some kilobytes whatever it stands for, and tasks sketch their share
    before the shuffle.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("value").isNotNull() & ~F.isnan("value"))
        sketch = known.groupBy("channel").agg(F.kll_sketch_agg_double(F.col("value").cast("double")).alias("sketch"))
        sketch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        cells.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact_sketches(source: DataFrame, target: str, batch: int) -> None:
    """Fold the sketches of finished batches into one folder of a new sink."""
    merged = source.groupBy("channel").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    merged.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def current_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(channel, n, prob, quantile) of all batches so far.

    A quantile is a value whose rank is within 1.33 % of n of the wanted one, with 99 % certainty; merging does not add to that.
    """
    merged = sketches.groupBy("channel").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    found = [
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs
    ]
    rows = merged.select("channel", F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(F.array(*found)).alias("q"))
    return rows.select("channel", "n", "q.prob", "q.quantile")


def admit_strips(
    arrivals: DataFrame, key: str, time: str, delay: str, path: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Pass daytime strips on, each once, however often it is delivered within the delay.

    State is one key per strip of the delay. For long delays run it on the RocksDB state store.
    """
    day = (F.col("incidence") > 0) & (F.col("incidence") < MAX_INCIDENCE_DEG)
    admitted = (
        arrivals.where(F.col("incidence").isNull() | day)
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([key])
    )
    return (
        admitted.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain(query: StreamingQuery, read: Callable[[], DataFrame]) -> DataFrame:
    """Wait for an ``availableNow`` query and read what it wrote."""
    query.awaitTermination()
    try:
        return read()
    except AnalysisException as e:
        raise RuntimeError("the stream wrote no output") from e
