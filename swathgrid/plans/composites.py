"""Composite products: each function chains operators from raw cells to a finished layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.constants import MIN_CRATER_KM
from swathgrid.functions import values as V
from swathgrid.grid import Grid
from swathgrid.operators import mosaic as M
from swathgrid.operators import raster as R
from swathgrid.operators import stats as S
from swathgrid.operators import stencil
from swathgrid.operators import tiles as T
from swathgrid.operators import vector
from swathgrid.operators import zonal as Z
from swathgrid.operators.ranking import counted_join
from swathgrid.operators.sampling import uniform_sample
from swathgrid.sources import binary
from swathgrid.sources.workspace import written

Shape = tuple[int, int]


def _map_value(cells: DataFrame, expr) -> DataFrame:
    return cells.withColumn("value", expr)


def align(cells: DataFrame, src: Shape, dst: Shape, keys: list[str] = (), block: int = 256) -> DataFrame:
    """To the target grid; equal shapes pass through."""
    return cells if src == dst else R.regrid_bilinear(cells, src, dst, keys=keys, block=block)


def align_visible(cells: DataFrame, src: Shape, dst: Shape, block: int = 256) -> DataFrame:
    return align(cells, src, dst, block=block)


def align_laser_dem(cells: DataFrame, src: Shape, dst: Shape, nodata: float | None = None, block: int = 256) -> DataFrame:
    """Half-metre counts to metres, then the target grid."""
    return align(_map_value(cells, V.rescale(F.col("value"), 0.5, nodata=nodata)), src, dst, block=block)


def align_stereo_dem(cells: DataFrame, src: Shape, dst: Shape, nodata: float | None = None, block: int = 256) -> DataFrame:
    """Kilometres to metres, then the target grid."""
    return align(_map_value(cells, V.rescale(F.col("value"), 1000, nodata=nodata)), src, dst, block=block)


def align_radiometer(cells: DataFrame, label: DataFrame, src: Shape, dst: Shape, block: int = 256) -> DataFrame:
    """Scale and offset from the product label (column ``label``: map), 1 and 0 if it has none."""
    terms = label.select(
        F.struct(
            F.coalesce(F.col("label")["SCALING_FACTOR"].try_cast("double"), F.lit(1.0)).alias("scale"),
            F.coalesce(F.col("label")["OFFSET"].try_cast("double"), F.lit(0.0)).alias("offset"),
            F.col("label")["MISSING_CONSTANT"].try_cast("double").alias("nodata"),
        ).alias("t")
    ).scalar()
    held = cells.withColumn("_t", terms)
    valid = F.col("_t.nodata").isNull() | (F.col("value") != F.col("_t.nodata"))
    scaled = F.when(valid, F.col("value") * F.col("_t.scale") + F.col("_t.offset"))
    return align(_map_value(held, scaled).drop("_t"), src, dst, block=block)


def derive_terrain(
    laser: DataFrame, stereo: DataFrame | None, grid: Grid, pixel_m: float | None = None, block: int = 256
) -> DataFrame:
    """Blended elevation, slope and roughness as three channels (laser alone without stereo).

    The blend is stored once, as both derivatives read it. Cells that only one of the rasters holds take part.
    """
    dem = written(R.blend_dems(laser, stereo, keep_lat=True, size=grid.width * grid.height), "elevation")
    layers = {
        "elevation": dem.select("row", "col", F.col("elevation").alias("value")),
        "slope": stencil.slope(dem, grid, "elevation", "lat", pixel_m, block=block),
        "roughness": stencil.roughness(dem, grid, "elevation", block=block),
    }
    out = None
    for name, layer in layers.items():
        value = "value" if name == "elevation" else name
        part = layer.select(F.lit(name).alias("channel"), "row", "col", F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def align_gravity(cells: DataFrame, src: Shape, dst: Shape, nodata: float, block: int = 256) -> DataFrame:
    """Several gravity layers (channel) at once: nodata, half turn, finer grid."""
    valid = _map_value(cells, F.when(F.col("value") != nodata, F.col("value")))
    return align(R.roll_columns(valid, src[1]), src, dst, ["channel"], block)


def align_radar(cells: DataFrame, src: Shape, dst: Shape, block: int = 256) -> DataFrame:
    """Both radar layers (channel): nodata rules, half turn, target grid if sizes differ."""
    value = F.col("value")
    ruled = F.when(F.col("channel") == "minirf_cpr", V.radar_valid(value, "minirf_cpr")).otherwise(
        V.radar_valid(value, "minirf_s1")
    )
    rolled = R.roll_columns(_map_value(cells, ruled), src[1])
    return rolled if src == dst else R.regrid_bilinear(rolled, src, dst, keys=["channel"], block=block)


def fix_radar(aligned: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log1p of aligned radar layers, statistics restated, layers normalised.

    Always starts from aligned raw values, so running it again gives the same result. Zero is
    nodata here. Returns the normalised cells and the updated statistics table.
    """
    logged = _map_value(aligned, V.log1p_compress(F.col("value")))
    fresh = S.mean_std(logged, skip_zero=True)
    updated = S.upsert_stats(stats, fresh)
    known = counted_join(logged, updated, "channel")
    z = V.zscore(F.when(F.col("value") != 0, F.col("value")), F.col("mean"), F.col("std"))
    return known.select("channel", "row", "col", z.alias("value")), updated


def mosaic_bands(
    cells: DataFrame, layout: DataFrame, src: Shape, dst: Shape, grid: Grid, nodata: float | None = None, block: int = 256
) -> DataFrame:
    """Band tiles to one raster.

    ``cells``: tile, row, col, value; ``layout``: tile, ordinal, row0, col0 (target position of
    each tile's corner). Later ordinals overwrite earlier ones.
    """
    valid = _map_value(cells, V.reflectance_valid(F.col("value"), nodata))
    placed = counted_join(R.regrid_bilinear(valid, src, dst, keys=["tile"], block=block), layout, "tile")
    placed = placed.withColumn("row", F.col("row") + F.col("row0")).withColumn(
        "col", F.pmod(F.col("col") + F.col("col0"), F.lit(grid.width)).cast("int")
    )
    on_grid = placed.where(grid.contains(F.col("row"), F.col("col")))
    merged = R.last_valid(on_grid, "ordinal")
    return R.roll_if_right_heavy(merged, grid.width)


def align_albedo(cells: DataFrame, src: Shape, dst: Shape, nodata: float, block: int = 256) -> DataFrame:
    return align(_map_value(cells, F.when(F.col("value") != nodata, F.col("value"))), src, dst, block=block)


def abundance_map(bins: DataFrame, grid: Grid, element: str) -> DataFrame:
    """Element bins without nodata to the full grid."""
    return R.grid_scattered(bins.where(F.col(element) > -0.01), grid.width, grid.height, element)


def strip_mosaic(
    reflectance: DataFrame, location: DataFrame, geometry: DataFrame, grid: Grid, bands: dict[str, int]
) -> DataFrame:
    """Three cube manifests (strip_id, img_path, length, header fields) to the finished mosaic.

    Truncated reflectance files are dropped first. The three cubes of a strip meet on
    (strip_id, line, sample).
    """
    sized = reflectance.withColumn("item_bytes", binary.item_bytes(F.col("data_type")))
    key = ["strip_id", "line", "sample"]
    pixels = (
        binary.read_cubes(M.complete_files(sized), bands)
        .join(binary.read_locations(location), key)
        .join(binary.read_geometry(geometry), key)
    )
    return M.mosaic(pixels, grid, list(bands))


def geology_layers(polygons: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Unit raster with mare flag, and patch labels, from polygons in grid degrees."""
    ids = vector.unit_ids(polygons)
    cells = Z.with_mare(vector.attach_units(vector.polygon_raster(polygons, grid), polygons))
    zones = Z.name_units(Z.zonal_units(T.add_tile(cells, grid)), ids)
    return cells, zones


def crater_layer(craters: DataFrame, grid: Grid, min_km: float = MIN_CRATER_KM) -> DataFrame:
    return vector.crater_mask(craters.where(F.col("diam_km") >= min_km), grid)


def patch_dataset(cells: DataFrame, grid: Grid, lead: str, n_channels: int, max_nodata: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Usable patches with metadata, and their availability flags."""
    usable = T.usable_tiles(cells, grid, lead, max_nodata).select("tile_row", "tile_col")
    meta = T.patch_metadata(cells, grid, n_channels).join(usable, ["tile_row", "tile_col"], "left_semi")
    flags = T.channel_flags(cells, grid).join(usable, ["tile_row", "tile_col"], "left_semi")
    return meta, flags


def extend_patches(cells: DataFrame, grid: Grid, patches: DataFrame, *layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """More channels for the same patches: the stacked cells and the restated flags."""
    stacked = T.stack_channels(cells, *layers)
    flags = T.channel_flags(stacked, grid)
    keep = patches.select("tile_row", "tile_col")
    return stacked, flags.join(keep, ["tile_row", "tile_col"], "left_semi")


def write_multiangle(mosaicked: DataFrame, grid: Grid, path: str) -> None:
    """Observation counts (one byte) and mean angles of a finished mosaic, by patch."""
    placed = T.add_tile(mosaicked, grid)
    angles = [F.col(f"mean_{a}").cast("float").alias(f"mean_{a}") for a in M.ANGLES]
    counts = V.narrow_count(F.col("n_obs")).alias("n_obs")
    placed.select("tile_row", "tile_col", "idx", counts, *angles).write.parquet(path)


def validate(cells: DataFrame, grid: Grid, n_patches: int = 100, seed=42) -> DataFrame:
    """Range report over a seeded sample of patches."""
    tiled = T.add_tile(cells, grid)
    number = F.col("tile_row") * grid.tile_cols + F.col("tile_col")
    patches = tiled.select("tile_row", "tile_col").distinct().withColumn("patch_id", number)
    sample = uniform_sample(patches, "patch_id", n_patches, seed)
    part = counted_join(tiled, sample.select("tile_row", "tile_col"), ["tile_row", "tile_col"], "left_semi")
    return S.range_validation(S.patch_stats(part))
