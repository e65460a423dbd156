"""Tiling, dense tiles, patch statistics, availability flags, stacking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.constants import (
    CHANNEL_GROUPS,
    CHANNEL_STATS,
    CHANNEL_TO_GROUP,
    CHANNELS,
    VALUE_RANGES,
)
from swathgrid.grid import Grid
from swathgrid.operators.blocks import spread
from swathgrid.operators.ranking import counted_join
from swathgrid.operators.stencil import array_column


def channel_table(spark: SparkSession) -> DataFrame:
    """The channel registry: 28 rows by definition, so shipping it to every task is safe."""
    rows = [
        f"('{c}', {i}, '{CHANNEL_TO_GROUP[c]}', "
        + ", ".join(f"{x!r}D" for x in (*VALUE_RANGES[c], *CHANNEL_STATS[c]))
        + ")"
        for i, c in enumerate(CHANNELS)
    ]
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} "
        "AS t(channel, idx, group_name, min_valid, max_valid, mean, std)"
    )


def with_registry(df: DataFrame, how: str = "inner") -> DataFrame:
    """Attach registry columns by channel; the inner form drops unknown channels."""
    return df.join(F.broadcast(channel_table(df.sparkSession)), "channel", how)


def place_in_tiles(cells: DataFrame, grid: Grid) -> DataFrame:
    """Tile position and row-major index inside the tile."""
    t = grid.tile
    return (
        cells.withColumn("tile_row", F.floor(F.col("row") / t).cast("int"))
        .withColumn("tile_col", F.floor(F.col("col") / t).cast("int"))
        .withColumn("idx", ((F.col("row") % t) * t + F.col("col") % t).cast("int"))
    )


def add_tile(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells of patches: incomplete tiles at the grid's edge are no patches and are left out."""
    return place_in_tiles(cells, grid).where(
        (F.col("tile_row") < grid.tile_rows) & (F.col("tile_col") < grid.tile_cols)
    )


def stack_columns(df: DataFrame, channels: dict[str, str], keep=("row", "col")) -> DataFrame:
    """Wide rasters (one column each) to long cells(channel, row, col, value)."""
    items = F.array(
        *[
            F.struct(F.lit(name).alias("channel"), F.col(col).cast("double").alias("value"))
            for name, col in channels.items()
        ]
    )
    return df.select(*keep, F.explode(items).alias("_c")).select(*keep, "_c.channel", "_c.value")


TILE_SCHEMA = "channel string, tile_row int, tile_col int, data array<float>"
TILE_KEY = ["channel", "tile_row", "tile_col"]


def _tile_batch(done: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
    keys, data = zip(*done, strict=True)
    channel, row, col = zip(*keys, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(channel), pa.array(row, pa.int32()), pa.array(col, pa.int32()), array_column(data)],
        names=[*TILE_KEY, "data"],
    )


def pack_tiles(cells: DataFrame, grid: Grid) -> DataFrame:
    """cells(channel, row, col, value) to dense tiles; cells that do not occur become NULL.

    Cells are shuffled and sorted by tile; a task then fills one array after the other and never
    holds more than the tiles of one batch.
    """
    area = grid.tile**2

    def pack(batches):
        key, data = None, None
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            row, col, idx = (batch.column(i).to_numpy() for i in (1, 2, 3))
            value = batch.column(4).to_numpy(zero_copy_only=False)
            new = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(codes)] if len(codes) else [0]
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                here = (names.dictionary[codes[a]].as_py(), int(row[a]), int(col[a]))
                if here != key:
                    if key is not None:
                        done.append((key, data))
                    key, data = here, np.full(area, np.nan)
                data[idx[a:b]] = value[a:b]
            if done:
                yield _tile_batch(done)
        if key is not None:
            yield _tile_batch([(key, data)])

    return (
        place_in_tiles(cells, grid)
        .select(*TILE_KEY, "idx", F.col("value").cast("double").alias("value"))
        .repartition(*TILE_KEY)
        .sortWithinPartitions(*TILE_KEY)
        .mapInArrow(pack, TILE_SCHEMA)
    )


def unpack_tiles(tiles: DataFrame, grid: Grid) -> DataFrame:
    t = grid.tile
    e = tiles.select("channel", "tile_row", "tile_col", F.posexplode("data").alias("idx", "value"))
    return e.select(
        "channel",
        (F.col("tile_row") * t + F.floor(F.col("idx") / t).cast("int")).alias("row"),
        (F.col("tile_col") * t + F.col("idx") % t).alias("col"),
        "value",
    ).where((F.col("row") < grid.height) & (F.col("col") < grid.width))


def read_window(tiles: DataFrame, grid: Grid, row: int, col: int, height: int, width: int) -> DataFrame:
    """Cells of a row/column window; only tiles that overlap it are read."""
    t = grid.tile
    hit = tiles.where(
        F.col("tile_row").between(row // t, (row + height - 1) // t)
        & F.col("tile_col").between(col // t, (col + width - 1) // t)
    )
    return unpack_tiles(hit, grid).where(
        F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)
    )


def normalise_tiles(tiles: DataFrame) -> DataFrame:
    """z-score of dense tiles with registry statistics; NULL stays NULL."""
    known = with_registry(tiles)
    data = F.when(
        F.col("std") > 0,
        F.transform("data", lambda v: ((v - F.col("mean")) / F.col("std")).cast("float")),
    ).otherwise(F.col("data"))
    return known.select("channel", "tile_row", "tile_col", data.alias("data"))


def tile_validity(cells: DataFrame, grid: Grid, channel: str) -> DataFrame:
    """Share of valid cells of one channel per complete tile."""
    return (
        add_tile(cells.where(F.col("channel") == channel), grid)
        .groupBy("tile_row", "tile_col")
        .agg((F.count("value") / F.lit(float(grid.tile**2))).alias("valid_fraction"))
    )


def usable_tiles(cells: DataFrame, grid: Grid, channel: str, max_nodata: float = 0.5) -> DataFrame:
    return tile_validity(cells, grid, channel).where(F.col("valid_fraction") >= 1 - max_nodata)


def patch_metadata(cells: DataFrame, grid: Grid, n_channels: int, elevation: str = "elevation") -> DataFrame:
    """Patch centre, share of cells valid in all channels, and elevation mean and range.

    Cells are shuffled once by tile; the per-cell and the per-tile aggregate both run on that
    layout. A tile holds a fixed number of cells, so no tile can become a hot key.
    """
    tiled = spread(add_tile(cells, grid), grid.width * grid.height, "tile_row", "tile_col")
    value = F.when(F.col("channel") == elevation, F.col("value"))
    per_cell = tiled.groupBy("tile_row", "tile_col", "idx").agg(
        F.count("value").alias("n"), F.max(value).alias("elevation")
    )
    return per_cell.groupBy("tile_row", "tile_col").agg(
        grid.tile_lat(F.col("tile_row")).alias("center_lat"),
        grid.tile_lon(F.col("tile_col")).alias("center_lon"),
        (F.count_if(F.col("n") == n_channels) / F.lit(float(grid.tile**2))).alias("valid_fraction"),
        F.avg("elevation").alias("mean_elevation"),
        (F.max("elevation") - F.min("elevation")).alias("elevation_range"),
    )


def channel_flags(cells: DataFrame, grid: Grid) -> DataFrame:
    """Channel is available in a patch if any of its cells is valid."""
    return (
        add_tile(cells, grid)
        .groupBy("tile_row", "tile_col", "channel")
        .agg(F.bool_or(F.col("value").isNotNull()).alias("has_channel"))
    )


def group_flags(flags: DataFrame) -> DataFrame:
    """Group is available in a patch if any of its channels is."""
    return (
        with_registry(flags)
        .groupBy("tile_row", "tile_col", "group_name")
        .agg(F.bool_or("has_channel").alias("has_group"))
    )


def flag_maps(flags: DataFrame) -> DataFrame:
    """One row per patch with a channel -> flag map (28 entries at most)."""
    entries = F.collect_list(F.struct("channel", "has_channel"))
    return flags.groupBy("tile_row", "tile_col").agg(F.map_from_entries(entries).alias("has_channel"))


def stack_channels(
    base: DataFrame, *layers: DataFrame, key=("channel", "row", "col"), value: str = "value"
) -> DataFrame:
    """Layer rasters over each other: for a channel in several layers the last layer wins.

    Whole channels are replaced, as when a re-read raster overrides a stored one: cells that are
    nodata in the overriding layer are nodata in the result, and cells that it lacks are absent.
    Dense tiles are stacked in the same way with their own key and value columns; without a channel in
    the key, the last layer wins key by key.

    A channel is one key with a whole raster of cells, so cells are not shuffled by it: the winning layers, one row
    a channel, are counted and go to the cells.
    """
    tagged = None
    for level, layer in enumerate([base, *layers]):
        part = layer.select(*key, value).withColumn("level", F.lit(level))
        tagged = part if tagged is None else tagged.unionByName(part)
    if "channel" not in key:
        return tagged.groupBy(*key).agg(F.max_by(value, "level").alias(value))
    top = tagged.groupBy("channel").agg(F.max("level").alias("level"))
    return counted_join(tagged, top, ["channel", "level"]).select(*key, value)


def coverage_by_channel(flags: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Percentage of patches with data per channel; of all `patches` if given, else of those with flags."""
    if patches is not None:
        place = ["tile_row", "tile_col"]
        every = patches.select(*place).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
        return (
            flags.groupBy("channel")
            .agg(F.count_if("has_channel").alias("with_data"))
            .select("channel", (F.col("with_data") / every * 100).alias("coverage_pct"), every.alias("n_patches"))
        )
    return flags.groupBy("channel").agg(
        (F.avg(F.col("has_channel").cast("int")) * 100).alias("coverage_pct"),
        F.count(F.lit(1)).alias("n_patches"),
    )


def spectral_coverage(cells: DataFrame, grid: Grid, channels: list[str]) -> DataFrame:
    """Per patch: share of cells valid in the first band, and whether any band has data."""
    first = F.when(F.col("channel") == channels[0], F.col("value"))
    return (
        add_tile(cells.where(F.col("channel").isin(channels)), grid)
        .groupBy("tile_row", "tile_col")
        .agg(
            (F.count(first) / F.lit(float(grid.tile**2))).alias("first_valid_fraction"),
            F.bool_or(F.col("value").isNotNull()).alias("any_valid"),
        )
    )


def patchify(cells: DataFrame, size: int, per_side: int, channel_idx: Column) -> DataFrame:
    """Cell of a patch image -> (patch number, position in the patch vector).

    Position runs channel first, then row, then column inside the small patch.
    """
    p = F.floor(F.col("row") / size) * per_side + F.floor(F.col("col") / size)
    pos = channel_idx * (size * size) + (F.col("row") % size) * size + F.col("col") % size
    return cells.withColumn("patch", p.cast("int")).withColumn("pos", pos.cast("int"))


def unpatchify(vectors: DataFrame, size: int, per_side: int, channel: int) -> DataFrame:
    """Inverse of :func:`patchify` for one channel."""
    area = size * size
    one = vectors.where(F.floor(F.col("pos") / area) == channel)
    q = F.col("pos") % area
    return one.select(
        *[c for c in vectors.columns if c not in ("patch", "pos", "row", "col")],
        (F.floor(F.col("patch") / per_side) * size + F.floor(q / size)).cast("int").alias("row"),
        ((F.col("patch") % per_side) * size + q % size).cast("int").alias("col"),
    )


def hold_out(samples: DataFrame, targets: list[str], group: str, witness: str | None) -> DataFrame:
    """Remove target channels from the inputs and restate the flag of their group.

    ``witness`` is the channel whose presence keeps the group available; without one the group
    is marked unavailable. Expects maps ``pixels``, ``has_channel`` and ``has_group``.
    """
    kept = F.map_filter("pixels", lambda k, v: ~k.isin(targets))
    flag = F.lit(False) if witness is None else F.coalesce(F.col("has_channel")[witness], F.lit(False))
    groups = F.transform_values("has_group", lambda k, v: F.when(k == group, flag).otherwise(v))
    return samples.withColumn("pixels", kept).withColumn("has_group", groups)


def spatial_mean_targets(cells: DataFrame, grid: Grid, targets: list[str], require: bool = True) -> DataFrame:
    """Mean of valid cells per patch for each target channel, 0 where there is none.

    With ``require`` only patches that hold every target channel are kept.
    """
    zero_free = F.when(F.col("value") != 0, F.col("value"))
    means = [
        F.coalesce(F.avg(F.when(F.col("channel") == t, zero_free)), F.lit(0.0)).alias(f"target_{t}")
        for t in targets
    ]
    present = [
        F.coalesce(F.bool_or((F.col("channel") == t) & F.col("value").isNotNull()), F.lit(False)).alias(f"_has_{t}")
        for t in targets
    ]
    out = add_tile(cells, grid).groupBy("tile_row", "tile_col").agg(*means, *present)
    if require:
        for t in targets:
            out = out.where(F.col(f"_has_{t}"))
    return out.drop(*[f"_has_{t}" for t in targets])


def assemble_samples(tiles: DataFrame) -> DataFrame:
    """One row per patch: maps ``pixels``, ``has_channel`` and ``has_group`` (28 channels at most)."""
    entry = F.struct(F.col("channel"), F.col("data"))
    flag = F.struct(F.col("channel"), F.exists("data", lambda v: v.isNotNull()).alias("f"))
    maps = tiles.groupBy("tile_row", "tile_col").agg(
        F.map_from_entries(F.collect_list(entry)).alias("pixels"),
        F.map_from_entries(F.collect_list(flag)).alias("has_channel"),
    )
    groups = []
    for name, members in CHANNEL_GROUPS.items():
        present = F.lit(False)
        for c in members:
            present = present | F.coalesce(F.col("has_channel")[c], F.lit(False))
        groups += [F.lit(name), present]
    return maps.withColumn("has_group", F.create_map(*groups))
