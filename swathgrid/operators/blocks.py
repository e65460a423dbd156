"""Halo blocks: the one physical pattern of all neighbourhood operators.

Each cell is sent to the block that owns it and, near a block edge, also to the blocks whose
halo it falls into. One shuffle on the block key follows; windows and aggregates that group by
the block key and anything more need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: Cells of a grid (by key) that one task gets on average; all layouts by place keep to it on larger grids.
TASK_CELLS = 1 << 18


def spread(cells: DataFrame, size: int, *by: str) -> DataFrame:
    """Cells of a grid of ``size`` cells, shuffled by the given columns.

    Spark sizes tasks by compressed bytes, which cells have few of, so a task's rows and memory would grow with the grid.
    From ``TASK_CELLS`` on the number of tasks grows instead.
    """
    if size <= TASK_CELLS:
        return cells.repartition(*by)
    tasks = max(-(-size // TASK_CELLS), cells.sparkSession.sparkContext.defaultParallelism)
    return cells.repartition(tasks, *by)


def _padded(x: str, size: int, halo: int) -> Column:
    """Positions a cell fills: itself, and for a border cell those outside the grid."""
    c = F.col(x)
    start = F.when(c == 0, c - halo).otherwise(c)
    return F.sequence(start, F.when(c == size - 1, c + halo).otherwise(c))


def _blocks(x: str, size: int, halo: int, block: int) -> Column:
    """Blocks along one axis whose cells or halo include a position: nearly always one."""

    def home(pos):
        b = F.floor(pos / block).cast("int")
        return F.least(F.greatest(b, F.lit(0)), F.lit((size - 1) // block))

    return F.sequence(home(F.col(x) - halo), home(F.col(x) + halo))


def with_halo(
    cells: DataFrame,
    width: int,
    height: int,
    halo: int,
    keys: list[str] = (),
    pad: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Cells with ``block_row``/``block_col``, repeated for halos, shuffled once by block.

    ``pad`` repeats the border cells outside the grid.
    """
    values = [c for c in cells.columns if c not in ("row", "col", *keys)]
    sent = cells
    if pad:
        sent = sent.withColumn("row", F.explode(_padded("row", height, halo)))
        sent = sent.withColumn("col", F.explode(_padded("col", width, halo)))
    sent = sent.withColumn("block_row", F.explode(_blocks("row", height, halo, block)))
    sent = sent.withColumn("block_col", F.explode(_blocks("col", width, halo, block)))
    placed = sent.select(*keys, "block_row", "block_col", "row", "col", *values)
    return spread(placed, width * height, *keys, "block_row", "block_col")


def owned(width: int, height: int, block: int = BLOCK) -> Column:
    """True where a (possibly padded) cell belongs to the block it was sent to."""

    def home(x, size):
        return F.least(F.greatest(F.floor(F.col(x) / block), F.lit(0)), F.lit((size - 1) // block))

    return (home("row", height) == F.col("block_row")) & (home("col", width) == F.col("block_col"))
