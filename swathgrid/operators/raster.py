"""Whole-raster operators on cells(row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.operators import blocks
from swathgrid.operators.blocks import BLOCK, owned, with_halo


def roll_columns(cells: DataFrame, width: int, by: int | None = None) -> DataFrame:
    """Cyclic shift along longitude, by default half a turn (0..360 to -180..180)."""
    step = width // 2 if by is None else by
    return cells.withColumn("col", F.pmod(F.col("col") + step, F.lit(width)).cast("int"))


def roll_if_right_heavy(cells: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Roll half a turn only if the right half holds over five times the left half's cells."""
    half = width // 2
    right = F.count_if((F.col("col") >= half) & F.col(value).isNotNull())
    left = F.count_if((F.col("col") < half) & F.col(value).isNotNull())
    heavy = cells.agg((right > left * 5).alias("heavy")).scalar()
    rolled = F.pmod(F.col("col") + half, F.lit(width)).cast("int")
    return cells.withColumn("col", F.when(heavy, rolled).otherwise(F.col("col")))


def shift(
    cells: DataFrame,
    width: int,
    height: int,
    dy: float,
    dx: float,
    value: str = "value",
    limit: float = 10,
) -> DataFrame:
    """Integer shift ``out[r, c] = in[r - dy, c - dx]`` with NULL fill.

    Offsets are rounded half to even; beyond ``limit`` the shift is refused, and below half a
    pixel both ways it is skipped. Vacated cells are the wrapped places of the lost ones, so
    the result is complete without a join.
    """
    if abs(dy) > limit or abs(dx) > limit:
        raise ValueError(f"offset ({dy}, {dx}) exceeds {limit} pixels")
    if abs(dy) < 0.5 and abs(dx) < 0.5:
        return cells
    r, c = F.col("row") + round(dy), F.col("col") + round(dx)
    inside = r.between(0, height - 1) & c.between(0, width - 1)
    return cells.select(
        *[k for k in cells.columns if k not in ("row", "col", value)],
        F.pmod(r, F.lit(height)).cast("int").alias("row"),
        F.pmod(c, F.lit(width)).cast("int").alias("col"),
        F.when(inside, F.col(value)).alias(value),
    )


def blend_dems(
    laser: DataFrame, stereo: DataFrame | None, lat: str = "lat", keep_lat: bool = False, size: int = 0
) -> DataFrame:
    """Stereo elevations near the equator, laser near the poles, a linear mix from 58 to 62.

    Inside the mixing band a cell is mixed only if both are valid; otherwise laser stays as is. Cells
    that only the stereo raster holds count as laser nodata; their latitude comes from its own column.
    ``keep_lat`` adds the latitude, of whichever raster has the cell. ``size``, the number of the grid's cells, tells how many
    tasks join large rasters; without it Spark decides.
    """
    if stereo is None:
        return laser.select("row", "col", F.col("value").alias("elevation"), *[F.col(lat)] * keep_lat)
    own = F.col(lat) if lat in stereo.columns else F.lit(None).cast("double")
    right = stereo.select("row", "col", F.col("value").alias("stereo"), own.alias("_lat"))
    # Two short rows a cell and no windows: a task can take four times the cells, and fewer tasks spare the scans a sort.
    if (load := size // 4) > blocks.TASK_CELLS:
        laser, right = (blocks.spread(x, load, "row", "col") for x in (laser, right))
    both = laser.join(right, ["row", "col"], "full" if lat in stereo.columns else "left")
    either = F.coalesce(F.col(lat), F.col("_lat"))
    a = F.abs(either)
    mixed = F.col("stereo").isNotNull() & F.col("value").isNotNull()
    share = (a - 58.0) / 4.0
    elevation = (
        F.when(a < 58, F.coalesce(F.col("stereo"), F.col("value")))
        .when((a < 62) & mixed, F.col("stereo") * (1 - share) + F.col("value") * share)
        .otherwise(F.col("value"))
    )
    return both.select("row", "col", elevation.alias("elevation"), *[either.alias(lat)] * keep_lat)


def _target_range(base: Column, src: int, dst: int) -> Column:
    """Target positions that may fall between source centres ``base`` and ``base + 1``."""
    lo = F.floor((base + F.lit(0.5)) * (dst / src) - F.lit(0.5)) - 1
    hi = F.ceil((base + F.lit(1.5)) * (dst / src) - F.lit(0.5)) + 1
    return F.sequence(
        F.greatest(lo.cast("int"), F.lit(0)), F.least(hi.cast("int"), F.lit(dst - 1))
    )


def regrid_bilinear(
    cells: DataFrame,
    src: tuple[int, int],
    dst: tuple[int, int],
    value: str = "value",
    keys: list[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Resample to another grid over the same extent; shapes are (height, width).

    Each 2x2 group of source cells produces exactly the target cells whose centre lies between
    its four centres. So target cells come from the source side and need no join: one shuffle of
    the source by halo block, whatever the ratio of the two grids. Missing corners are left out
    and the weights of the others renormalised.
    """
    (sh, sw), (dh, dw) = src, dst
    base = cells.where(F.col(value).isNotNull()).select(
        *keys, "row", "col", F.col(value).cast("double").alias("v")
    )
    halo = with_halo(base, sw, sh, 1, keys, block=block)
    corners = F.array(
        *[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)]
    )
    corner = halo.withColumn("k", F.explode(corners))
    corner = corner.withColumn("row", F.col("row") - F.col("k.dr"))
    corner = corner.withColumn("col", F.col("col") - F.col("k.dc"))

    def pick(dr, dc):
        return F.max(F.when((F.col("k.dr") == dr) & (F.col("k.dc") == dc), F.col("v")))

    quads = (
        corner.where(owned(sw, sh, block))
        .groupBy(*keys, "block_row", "block_col", "row", "col")
        .agg(*[pick(dr, dc).alias(f"v{dr}{dc}") for dr in (0, 1) for dc in (0, 1)])
    )
    out = quads.withColumn("out_row", F.explode(_target_range(F.col("row"), sh, dh)))
    out = out.withColumn("y", (F.col("out_row") + F.lit(0.5)) * F.lit(sh) / F.lit(dh) - F.lit(0.5))
    out = out.where(F.floor("y") == F.col("row"))
    out = out.withColumn("out_col", F.explode(_target_range(F.col("col"), sw, dw)))
    out = out.withColumn("x", (F.col("out_col") + F.lit(0.5)) * F.lit(sw) / F.lit(dw) - F.lit(0.5))
    out = out.where(F.floor("x") == F.col("col"))
    fy, fx = F.col("y") - F.col("row"), F.col("x") - F.col("col")
    total = weight = F.lit(0.0)
    for dr in (0, 1):
        for dc in (0, 1):
            w = (fy if dr else 1 - fy) * (fx if dc else 1 - fx)
            v = F.col(f"v{dr}{dc}")
            total = total + F.coalesce(w * v, F.lit(0.0))
            weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
    return out.select(
        *keys,
        F.col("out_row").alias("row"),
        F.col("out_col").alias("col"),
        total.alias("_t"),
        weight.alias("_w"),
    ).where(F.col("_w") > 0).select(*keys, "row", "col", (F.col("_t") / F.col("_w")).alias("value"))


def _tent(axis: str, src: int, dst: int) -> tuple[Column, Column]:
    """Target positions that a source position may reach, and the tent weight of one of them (column ``_{axis}``)."""
    reach = max(1.0, src / dst)
    at = lambda x: (x + F.lit(0.5)) * F.lit(float(dst)) / F.lit(float(src)) - F.lit(0.5)
    first, last = F.floor(at(F.col(axis) - F.lit(reach))), F.ceil(at(F.col(axis) + F.lit(reach)))
    targets = F.sequence(F.greatest(first.cast("int"), F.lit(0)), F.least(last.cast("int"), F.lit(dst - 1)))
    centre = (F.col(f"_{axis}") + F.lit(0.5)) * F.lit(float(src)) / F.lit(float(dst)) - F.lit(0.5)
    return targets, F.lit(1.0) - F.abs(F.col(axis) - centre) / F.lit(reach)


def regrid_footprint(
    cells: DataFrame, src: tuple[int, int], dst: tuple[int, int], value: str = "value", keys: list[str] = ()
) -> DataFrame:
    """Resample with a tent as wide as the coarser of source and target cells, axis by axis; shapes are (height, width).

    To a finer grid this is bilinear interpolation; to a coarser one every source cell under the tent of a target counts, so nothing
    aliases. Weights are normalised over valid cells. A source cell adds to at most three targets an axis when
    down-sampling, so there is no join and no halo: sums by target combine before their one shuffle.
    """
    rows, by_row = _tent("row", src[0], dst[0])
    cols, by_col = _tent("col", src[1], dst[1])
    reached = cells.where(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).cast("double").alias("_v"))
    reached = reached.withColumn("_row", F.explode(rows)).withColumn("_wr", by_row).where("_wr > 0")
    reached = reached.withColumn("_col", F.explode(cols)).withColumn("_wc", by_col).where("_wc > 0")
    w = F.col("_wr") * F.col("_wc")
    sums = reached.groupBy(*keys, F.col("_row").alias("row"), F.col("_col").alias("col")).agg(
        F.sum(w * F.col("_v")).alias("_t"), F.sum(w).alias("_w")
    )
    return sums.select(*keys, "row", "col", (F.col("_t") / F.col("_w")).alias("value"))


def regrid_average(
    cells: DataFrame, src: tuple[int, int], dst: tuple[int, int], value: str = "value", keys=()
) -> DataFrame:
    """Down-sampling as the mean of the source cells whose centre falls in a target cell."""

    def to(x, s, d):
        return F.floor((F.col(x) + F.lit(0.5)) * F.lit(d) / F.lit(s)).cast("int").alias(x)

    return (
        cells.where(F.col(value).isNotNull())
        .select(*keys, to("row", src[0], dst[0]), to("col", src[1], dst[1]), value)
        .groupBy(*keys, "row", "col")
        .agg(F.avg(value).alias("value"))
    )


def last_valid(cells: DataFrame, order: str, value: str = "value", keys: list[str] = ()) -> DataFrame:
    """Overlay of rasters: the valid value with the highest order number wins."""
    return (
        cells.where(F.col(value).isNotNull())
        .groupBy(*keys, "row", "col")
        .agg(F.max_by(value, order).alias("value"), F.max(order).alias(order))
    )


def covalid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells where both rasters are valid."""
    return a.where(F.col("value").isNotNull()).select("row", "col", F.col("value").alias("a")).join(
        b.where(F.col("value").isNotNull()).select("row", "col", F.col("value").alias("b")), ["row", "col"]
    )


def grid_scattered(bins: DataFrame, width: int, height: int, value: str = "value") -> DataFrame:
    """Values at bin centres (lat, lon) to a full grid, linear between centres, nearest outside.

    Bins come in latitude bands. Each band is interpolated along longitude, then neighbouring
    bands along latitude; planes are reproduced exactly. Cells are generated from the bins, so
    no bin table is shipped around and no distance to all bins is taken.
    """
    ppd_x, ppd_y = width / 360.0, height / 180.0
    centres = bins.groupBy("lat", "lon").agg(F.avg(value).alias("v"))
    band = W.partitionBy("lat").orderBy("lon")
    seg = (
        centres.withColumn("lon2", F.lead("lon").over(band))
        .withColumn("v2", F.lead("v").over(band))
        .withColumn("first", F.row_number().over(band) == 1)
    )

    def position(lon):
        return (lon + F.lit(180.0)) * F.lit(ppd_x) - F.lit(0.5)

    x1, x2 = position(F.col("lon")), position(F.col("lon2"))
    start = F.when(F.col("first"), F.lit(0)).otherwise(F.greatest(F.ceil(x1).cast("int"), F.lit(0)))
    stop = F.when(F.col("lon2").isNull(), F.lit(width - 1)).otherwise(
        F.least(F.ceil(x2).cast("int") - 1, F.lit(width - 1))
    )
    across = seg.withColumn("a", start).withColumn("b", stop).where(F.col("a") <= F.col("b"))
    across = across.withColumn("col", F.explode(F.sequence("a", "b")))
    along = F.greatest((F.col("col") - x1) / (x2 - x1), F.lit(0.0))
    across = across.select(
        "lat",
        "col",
        F.when(F.col("lon2").isNull(), F.col("v"))
        .otherwise(F.col("v") + (F.col("v2") - F.col("v")) * along)
        .alias("v"),
    )
    column = W.partitionBy("col").orderBy(F.col("lat").desc())
    bands = (
        across.withColumn("lat2", F.lead("lat").over(column))
        .withColumn("v2", F.lead("v").over(column))
        .withColumn("first", F.row_number().over(column) == 1)
    )

    def line(lat):
        return (F.lit(90.0) - lat) * F.lit(ppd_y) - F.lit(0.5)

    y1, y2 = line(F.col("lat")), line(F.col("lat2"))
    top = F.when(F.col("first"), F.lit(0)).otherwise(F.greatest(F.ceil(y1).cast("int"), F.lit(0)))
    bottom = F.when(F.col("lat2").isNull(), F.lit(height - 1)).otherwise(
        F.least(F.ceil(y2).cast("int") - 1, F.lit(height - 1))
    )
    rows = bands.withColumn("a", top).withColumn("b", bottom).where(F.col("a") <= F.col("b"))
    rows = rows.withColumn("row", F.explode(F.sequence("a", "b")))
    below = F.greatest((F.col("row") - y1) / (y2 - y1), F.lit(0.0))
    return rows.select(
        "row",
        "col",
        F.when(F.col("lat2").isNull(), F.col("v"))
        .otherwise(F.col("v") + (F.col("v2") - F.col("v")) * below)
        .alias("value"),
    )
