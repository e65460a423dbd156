"""The target grid: row 0 at +90 degrees, column 0 at -180 degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathgrid.constants import LUNAR_RADIUS_M, PATCH_SIZE, PIXELS_PER_DEGREE


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    ppd: float
    tile: int = PATCH_SIZE

    @classmethod
    def lunar(cls) -> Grid:
        return cls(360 * PIXELS_PER_DEGREE, 180 * PIXELS_PER_DEGREE, PIXELS_PER_DEGREE)

    @property
    def pixel_m(self) -> float:
        return 2 * math.pi * LUNAR_RADIUS_M / (360 * self.ppd)

    @property
    def tile_rows(self) -> int:
        """Whole tiles from north to south."""
        return self.height // self.tile

    @property
    def tile_cols(self) -> int:
        return self.width // self.tile

    @property
    def tiles_down(self) -> int:
        """Tiles from north to south, a partial last one included."""
        return -(-self.height // self.tile)

    @property
    def tiles_across(self) -> int:
        return -(-self.width // self.tile)

    def row_of(self, lat: Column) -> Column:
        """Row of a latitude; the cast truncates toward zero, as the definition wants.

        Positions too large for a row number give NULL, which is off the grid.
        """
        return ((F.lit(90.0) - lat) * F.lit(self.ppd)).try_cast("int")

    def col_of(self, lon: Column) -> Column:
        return ((lon + F.lit(180.0)) * F.lit(self.ppd)).try_cast("int")

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def lat_of(self, row: Column) -> Column:
        return F.lit(90.0) - (row + F.lit(0.5)) / F.lit(self.ppd)

    def lon_of(self, col: Column) -> Column:
        return F.lit(-180.0) + (col + F.lit(0.5)) / F.lit(self.ppd)

    def tile_lat(self, tile_row: Column) -> Column:
        return F.lit(90.0) - (tile_row + F.lit(0.5)) * F.lit(self.tile / self.ppd)

    def tile_lon(self, tile_col: Column) -> Column:
        return F.lit(-180.0) + (tile_col + F.lit(0.5)) * F.lit(self.tile / self.ppd)
