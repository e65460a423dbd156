"""Slope and roughness: windows over halo blocks, and array kernels over dense tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.grid import Grid
from swathgrid.operators.blocks import BLOCK, owned, spread, with_halo

MIN_COS_LAT = 0.01


def _beside(value: str, pos: str, window, step: int) -> Column:
    """Value of the cell one step away, NULL if that cell is missing."""
    there = F.lag(pos).over(window) if step < 0 else F.lead(pos).over(window)
    v = F.lag(value).over(window) if step < 0 else F.lead(value).over(window)
    return F.when(there == F.col(pos) + step, v)


def slope(
    cells: DataFrame,
    grid: Grid,
    value: str = "value",
    lat: str | None = None,
    pixel_m: float | None = None,
    keys: list[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Slope in degrees: central differences, one-sided only at the grid border.

    The choice of one-sided differences goes by position: a missing neighbour inside the grid
    gives NULL, and longitude does not wrap.
    """
    px = grid.pixel_m if pixel_m is None else pixel_m
    latitude = grid.lat_of(F.col("row")) if lat is None else F.col(lat)
    base = cells.select(*keys, "row", "col", F.col(value).alias("v"), latitude.alias("lat"))
    halo = with_halo(base, grid.width, grid.height, 1, keys, block=block)
    along = W.partitionBy(*keys, "block_row", "block_col", "row").orderBy("col")
    down = W.partitionBy(*keys, "block_row", "block_col", "col").orderBy("row")
    n = halo.withColumn("west", _beside("v", "col", along, -1))
    n = n.withColumn("east", _beside("v", "col", along, 1))
    n = n.withColumn("north", _beside("v", "row", down, -1))
    n = n.withColumn("south", _beside("v", "row", down, 1))
    v = F.col("v")

    def difference(pos, size, before, after):
        return (
            F.when(pos == 0, after - v).when(pos == size - 1, v - before).otherwise((after - before) / 2)
        )

    dx = difference(F.col("col"), grid.width, F.col("west"), F.col("east"))
    dx = dx / (F.lit(px) * F.greatest(F.cos(F.radians("lat")), F.lit(MIN_COS_LAT)))
    dy = difference(F.col("row"), grid.height, F.col("north"), F.col("south")) / F.lit(px)
    angle = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    return n.where(owned(grid.width, grid.height, block)).select(
        *keys, "row", "col", F.when(v.isNotNull(), angle).alias("slope")
    )


def roughness(
    cells: DataFrame,
    grid: Grid,
    value: str = "value",
    window: int = 5,
    keys: list[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Standard deviation of the valid cells in a square window, borders replicated.

    The window is separable: (count, sum, sum of squares) along rows, then down columns. Each
    cell is handed to the positions beside it, so missing cells count like NULL ones. Values are
    taken relative to the block mean, which keeps the difference of moments accurate.
    """
    k = window // 2
    base = cells.select(*keys, "row", "col", F.col(value).alias("v"))
    halo = with_halo(base, grid.width, grid.height, k, keys, pad=True, block=block)
    blk = [*keys, "block_row", "block_col"]
    centred = halo.withColumn("d", F.col("v") - F.avg("v").over(W.partitionBy(*blk)))
    beside = centred.withColumn("at", F.explode(F.sequence(F.col("col") - k, F.col("col") + k)))
    own = F.col("at") == F.col("col")
    along = beside.groupBy(*blk, "row", F.col("at")).agg(
        F.count("d").alias("n"),
        F.sum("d").alias("s"),
        F.sum(F.col("d") * F.col("d")).alias("q"),
        F.max(F.when(own, F.col("v"))).alias("v"),
        F.bool_or(own).alias("given"),
    ).withColumnRenamed("at", "col")
    down = W.partitionBy(*blk, "col").orderBy("row").rangeBetween(-k, k)
    both = along.withColumns({x: F.sum(x).over(down) for x in ("n", "s", "q")})
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    mine = owned(grid.width, grid.height, block) & grid.contains(F.col("row"), F.col("col"))
    return both.where(F.col("given") & mine).select(
        *keys, "row", "col", F.when(F.col("v").isNotNull(), F.sqrt(variance)).alias("roughness")
    )


# ---- dense tiles ---------------------------------------------------------------------------

#: Cells that a task of the tile operators works on at once, however many tiles a batch or a partition has.
STEP_CELLS = 1 << 18


def tile_matrices(column: pa.Array, rows: int, cols: int) -> np.ndarray:
    """An array column of equal sizes as a stack of matrices, NULL elements as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), rows, cols)


def stacked_column(matrices: np.ndarray) -> pa.Array:
    """A stack of matrices to an ARRAY<FLOAT> column, NaN as NULL elements."""
    flat = matrices.astype(np.float32).ravel()
    offsets = np.arange(len(matrices) + 1, dtype=np.int32) * (matrices.shape[1] * matrices.shape[2])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))


def array_column(rows: list[np.ndarray]) -> pa.Array:
    """Matrices to an ARRAY<FLOAT> column, NaN as NULL elements."""
    flat = np.concatenate([r.ravel() for r in rows]).astype(np.float32)
    offsets = np.cumsum([0] + [r.size for r in rows])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(flat, pa.float32(), mask=np.isnan(flat))
    )


PIECES = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
PIECE_SCHEMA = "channel string, tile_row int, tile_col int, dr int, dc int, piece array<float>"
PIECE_NAMES = ["channel", "tile_row", "tile_col", "dr", "dc", "piece"]


def halo_pieces(tiles: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """Each tile whole for itself, and only its border strips for its eight neighbours."""
    t, rows, cols = grid.tile, grid.tiles_down, grid.tiles_across
    step = max(1, STEP_CELLS // (t * t))
    side = {-1: slice(0, halo), 0: slice(0, t), 1: slice(t - halo, t)}

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                r, c = part.column(1).to_numpy(), part.column(2).to_numpy()
                m = tile_matrices(part.column(3), t, t)
                for dr, dc in PIECES:
                    # The neighbour at (r+dr, c+dc) sees this tile on its opposite side.
                    nr, nc = r + dr, c + dc
                    there = np.flatnonzero((nr >= 0) & (nr < rows) & (nc >= 0) & (nc < cols))
                    if not len(there):
                        continue
                    whence = [pa.array(np.full(len(there), x, np.int32)) for x in (-dr, -dc)]
                    places = [pa.array(x[there].astype(np.int32)) for x in (nr, nc)]
                    pieces = stacked_column(m[there][:, side[dr], side[dc]])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(there)), *places, *whence, pieces], names=PIECE_NAMES
                    )

    return tiles.select("channel", "tile_row", "tile_col", "data").mapInArrow(cut, PIECE_SCHEMA)


def _assemble(pieces: pa.RecordBatch, of: np.ndarray, count: int, t: int, halo: int) -> np.ndarray:
    """At most nine pieces a tile to padded matrices; sides without neighbour are NaN. ``of``: each piece's tile."""
    m = np.full((count, t + 2 * halo, t + 2 * halo), np.nan)
    place = {-1: slice(0, halo), 0: slice(halo, halo + t), 1: slice(halo + t, t + 2 * halo)}
    size = {-1: halo, 0: t, 1: halo}
    drs, dcs = pieces.column(3).to_numpy(), pieces.column(4).to_numpy()
    for dr, dc in PIECES:
        mine = np.flatnonzero((drs == dr) & (dcs == dc))
        if len(mine):
            m[of[mine], place[dr], place[dc]] = tile_matrices(pieces.column(5).take(pa.array(mine)), size[dr], size[dc])
    return m


def _tile_kernel(tiles: DataFrame, grid: Grid, halo: int, channel: str, kernel) -> DataFrame:
    """``kernel(matrices, tile_rows, tile_cols)`` on stacks of padded tiles.

    Pieces come sorted by tile. A task holds one batch of them and what the batch before left of its last tile.
    """
    t, key = grid.tile, ["channel", "tile_row", "tile_col"]
    step = max(1, STEP_CELLS // (t + 2 * halo) ** 2)

    def finished(pieces: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], pieces.num_rows)
        for at in range(0, len(starts), step):
            first, sizes = starts[at : at + step], (ends - starts)[at : at + step]
            some = pieces.slice(int(first[0]), int(sizes.sum()))
            m = _assemble(some, np.repeat(np.arange(len(first)), sizes), len(first), t, halo)
            r, c = (pieces.column(i).to_numpy()[first] for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array([channel] * len(first), pa.string()), pa.array(r), pa.array(c), stacked_column(kernel(m, r, c))],
                names=[*key, "data"],
            )

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            names = pieces.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            row, col = pieces.column(1).to_numpy(), pieces.column(2).to_numpy()
            new = (names[1:] != names[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
            starts = np.append(0, np.flatnonzero(new) + 1)
            if len(starts) > 1:
                yield from finished(pieces.slice(0, int(starts[-1])), starts[:-1])
            # A copy, so that the rest does not keep the whole batch.
            left = pieces.take(pa.array(np.arange(starts[-1], pieces.num_rows)))
        if left is not None:
            yield from finished(left, np.zeros(1, np.int64))

    pieces = spread(halo_pieces(tiles, grid, halo), grid.width * grid.height, *key)
    return pieces.sortWithinPartitions(*key).mapInArrow(run, "channel string, tile_row int, tile_col int, data array<float>")


def slope_tiles(tiles: DataFrame, grid: Grid, pixel_m: float | None = None, lat=None) -> DataFrame:
    """Tile form of :func:`slope`; ``lat(row_numbers)`` may override the grid's latitudes."""
    t, width, height, ppd = grid.tile, grid.width, grid.height, grid.ppd
    px = grid.pixel_m if pixel_m is None else pixel_m

    def kernel(m, tile_rows, tile_cols):
        rows = tile_rows[:, None] * t + np.arange(t)
        cols = tile_cols[:, None] * t + np.arange(t)
        latitude = 90.0 - (rows + 0.5) / ppd if lat is None else np.asarray(lat(rows.ravel())).reshape(rows.shape)
        r, c = rows[:, :, None], cols[:, None, :]
        v = m[:, 1:-1, 1:-1]
        north, south, west, east = m[:, :-2, 1:-1], m[:, 2:, 1:-1], m[:, 1:-1, :-2], m[:, 1:-1, 2:]
        dy = np.where(r == height - 1, v - north, np.where(r == 0, south - v, (south - north) / 2))
        dx = np.where(c == width - 1, v - west, np.where(c == 0, east - v, (east - west) / 2))
        dx = dx / (px * np.maximum(np.cos(np.radians(latitude)), MIN_COS_LAT))[:, :, None]
        out = np.degrees(np.arctan(np.hypot(dx, dy / px)))
        return np.where(np.isnan(v), np.nan, out)

    return _tile_kernel(tiles, grid, 1, "slope", kernel)


def roughness_tiles(tiles: DataFrame, grid: Grid, window: int = 5) -> DataFrame:
    """Tile form of :func:`roughness`."""
    t, width, height, k = grid.tile, grid.width, grid.height, window // 2

    def one(m, tile_row, tile_col):
        rows = np.clip(tile_row * t + np.arange(-k, t + k), 0, height - 1) - tile_row * t + k
        cols = np.clip(tile_col * t + np.arange(-k, t + k), 0, width - 1) - tile_col * t + k
        m = m[np.ix_(rows, cols)]
        ok = ~np.isnan(m)
        x = np.where(ok, m - (m[ok].mean() if ok.any() else 0.0), 0.0)

        def box(a):
            windows = np.lib.stride_tricks.sliding_window_view(a, (window, window))
            return windows.sum(axis=(2, 3))

        n = np.maximum(box(ok.astype(np.float64)), 1)
        var = np.maximum(box(x * x) / n - (box(x) / n) ** 2, 0)
        return np.where(ok[k:-k, k:-k], np.sqrt(var), np.nan)

    def kernel(m, tile_rows, tile_cols):
        return np.stack([one(*x) for x in zip(m, tile_rows, tile_cols, strict=True)])

    return _tile_kernel(tiles, grid, k, "roughness", kernel)
