"""Weighted mosaics summed as dense tiles, so that shuffles carry tiles and not cells.

Every task adds its observations to arrays of the tiles that they fall in, and puts out a tile's filled
cells as one row: `cells` (uint16 positions), `sums` (float64, a line per sum) and `seen` (a byte for each
sum and cell, 0 where only NULLs were summed). Rows of one tile add up in any order, those of stream
batches too. A strip covers few tiles at a time, so the arrays held are few; beyond `held_mb` the tiles
touched longest ago are put out early.

A tile that every strip crosses, such as one at a pole, has a row from every task. Rows are first
added within groups of tasks, about the square root of their number, then across the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.functions.geo import illumination_weight
from swathgrid.grid import Grid
from swathgrid.operators.mosaic import ANGLES, finalise, usable_observations

PARTIAL = "tile long, salt int, cells binary, sums binary, seen binary"
BLOCK = 64  # at most 256: positions are 16-bit


class _Held:
    """Tiles being summed: tile -> (sums, seen), each an array of sums x cells; the last sum counts rows."""

    def __init__(self, width: int, block: int, salt: int) -> None:
        self.width, self.area, self.salt = width, block * block, salt
        self.tiles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, tile: int, cells: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
        """`cells` are distinct."""
        held = self.tiles.pop(tile, None)
        if held is None:
            held = np.zeros((self.width, self.area)), np.zeros((self.width, self.area), bool)
        self.tiles[tile] = held
        held[0][:, cells] += sums
        held[1][:, cells] |= seen

    def put_out(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows of the tiles touched longest ago, until `most` are left."""
        rows: list[tuple] = []
        while len(self.tiles) > most:
            tile = next(iter(self.tiles))
            sums, seen = self.tiles.pop(tile)
            cells = np.flatnonzero(sums[-1])
            packed = cells.astype("<u2"), sums[:, cells].astype("<f8"), seen[:, cells].astype("u1")
            rows.append((tile, self.salt, *(x.tobytes() for x in packed)))
            if len(rows) == 16:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["tile", "salt", "cells", "sums", "seen"])


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = np.frombuffer(row["cells"], "<u2").astype(np.int64)
    return (
        cells,
        np.frombuffer(row["sums"], "<f8").reshape(width, len(cells)),
        np.frombuffer(row["seen"], "u1").reshape(width, len(cells)).astype(bool),
    )


def tile_sums(obs: DataFrame, grid: Grid, bands: list[str], block: int = BLOCK, held_mb: int = 128) -> DataFrame:
    """Sums of gridded observations (`row`, `col`, bands and angles) as unmerged tile rows.

    NULL values add nothing; a sum of NULLs only is NULL in the end, as in SQL. No rows give no tiles.
    """
    w = illumination_weight(F.col("incidence"))
    values = [(w * F.col(c)).cast("double").alias(f"v{i}") for i, c in enumerate([*bands, *ANGLES])]
    tile = F.floor(F.col("row") / block) * -(-grid.width // block) + F.floor(F.col("col") / block)
    cell = F.col("row") % block * block + F.col("col") % block
    placed = obs.select((tile * block * block + cell).cast("long").alias("at"), *values, w.cast("double").alias("w"))
    width, area = len(values) + 2, block * block
    salts = max(1, math.isqrt(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    most = max(1, (held_mb << 20) // (9 * width * area))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(width, block, TaskContext.get().partitionId() % salts)
        for batch in batches:
            at, *columns = batch.columns
            keys, index = np.unique(at.to_numpy(), return_inverse=True)
            sums = np.empty((width, len(keys)))
            seen = np.ones((width, len(keys)), bool)
            for i, column in enumerate(columns):
                known = column.is_valid().to_numpy(zero_copy_only=False)
                sums[i] = np.bincount(index, np.where(known, column.to_numpy(zero_copy_only=False), 0.0), len(keys))
                seen[i] = np.bincount(index[known], minlength=len(keys)) > 0
            sums[-1] = np.bincount(index, minlength=len(keys))
            tiles, cells = np.divmod(keys, area)
            cuts = np.flatnonzero(np.diff(tiles)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start < end:
                    held.add(int(tiles[start]), cells[start:end], sums[:, start:end], seen[:, start:end])
                if len(held.tiles) > most:
                    yield from held.put_out(most // 2)
        yield from held.put_out()

    return placed.mapInArrow(run, PARTIAL)


def merge_tiles(partials: DataFrame, bands: list[str], block: int = BLOCK, crowded: bool = True) -> DataFrame:
    """One row a tile. A task adds the rows of one tile at a time, in the order of tiles.

    `crowded=False` leaves out the first of the two shuffles: about half the bytes, but all rows of a tile meet
    in one task. It suits strips that cross no tile very often.
    """
    width = len(bands) + len(ANGLES) + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Held(width, block, 0), None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if last is not None and (row["tile"], row["salt"]) != last:
                    yield from held.put_out()
                last = row["tile"], row["salt"]
                held.salt = row["salt"]
                held.add(row["tile"], *_unpacked(row, width))
        yield from held.put_out()

    def added(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, PARTIAL)

    grouped = partials.select("tile", "salt", "cells", "sums", "seen")
    if crowded:
        grouped = added(grouped, "tile", "salt")
    return added(grouped.withColumn("salt", F.lit(0)), "tile", "salt")


def tile_cells(tiles: DataFrame, grid: Grid, bands: list[str], block: int = BLOCK) -> DataFrame:
    """Sums of each filled cell, with the columns of `mosaic.weighted_sums`."""
    names = [*(f"sum_{c}" for c in [*bands, *ANGLES]), "sum_w"]
    width, across = len(names) + 1, -(-grid.width // block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("tile", "cells", "sums", "seen")}
                cells, sums, seen = _unpacked(row, width)
                down, right = np.divmod(row["tile"], across)
                columns = [pa.array(down * block + cells // block, pa.int32()), pa.array(right * block + cells % block, pa.int32())]
                columns += [pa.array(s, pa.float64(), mask=~k) for s, k in zip(sums[:-1], seen[:-1], strict=True)]
                columns.append(pa.array(sums[-1].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *names, "n_obs"])

    schema = ", ".join(["row int", "col int", *(f"`{c}` double" for c in names), "n_obs long"])
    return tiles.select("tile", "cells", "sums", "seen").mapInArrow(run, schema)


def mosaic_by_tiles(
    strips: DataFrame, grid: Grid, bands: list[str], lat: str = "lat", lon: str = "lon", block: int = BLOCK, held_mb: int = 128
) -> DataFrame:
    """The rows of `mosaic.mosaic`, summed by tiles."""
    partials = tile_sums(usable_observations(strips, grid, bands, lat, lon), grid, bands, block, held_mb)
    return finalise(tile_cells(merge_tiles(partials, bands, block), grid, bands, block), bands)
