"""Seeded samples, masks and crops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.functions.hashing import digest, hash_int
from swathgrid.grid import Grid
from swathgrid.operators.ranking import first_by_hash, hash_rank, small_join
from swathgrid.operators.stencil import array_column

# Above this, a per-key sample is cut by exact bucketed ranks instead of Spark's group limit.
GROUP_LIMIT = 1000


def few_shot(df: DataFrame, label: str, key: str, n: int, seed=42) -> DataFrame:
    """At most n rows per class, in seeded order."""
    hashed = df.withColumn("_h", digest(seed, F.col(key)))
    if n <= GROUP_LIMIT:
        return first_by_hash(hashed, [label], "_h", key, n).drop("_h", "rank")
    return hash_rank(hashed, [label], "_h", key).where(F.col("rank") <= n).drop("rank", "n_in_key")


def dense_positions(*samples: DataFrame, key: str) -> DataFrame:
    """Union of the keys of few-shot samples with positions 0.. in key order.

    Keys are numbered in two steps: stretches between 255 quantiles of the keys, and places in a stretch.
    The stretches hold about equally many keys however these are spread.
    """
    ids = None
    for s in samples:
        ids = s.select(key) if ids is None else ids.union(s.select(key))
    ids = ids.distinct()
    edges = ids.agg(F.percentile_approx(key, [i / 256 for i in range(1, 256)], 10_000)).scalar()
    ids = ids.withColumn("_e", edges).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(key)))).drop("_e")
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_s"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    return ids.join(starts, "_b").select(key, (F.col("_s") + place).alias("position"))


def uniform_sample(df: DataFrame, key: str, k: int, seed=42) -> DataFrame:
    """k rows without replacement: the first k in seeded order (Spark keeps k per task)."""
    h = digest(seed, F.col(key))
    return df.orderBy(h, key).limit(k)


def draw_with_replacement(df: DataFrame, key: str, n_rows: int, n: int, seed=123) -> DataFrame:
    """n draws among the ``n_rows`` keys of ``df``, each draw joined to its row; keys need not be dense."""
    spark = df.sparkSession
    draw = F.col("draw")
    # 32 bits of the digest are enough for 2^31 rows; beyond, 60 are taken.
    wide = F.conv(F.substring(digest(seed, draw), 1, 15), 16, 10).cast("bigint")
    pick = F.pmod(hash_int(seed, draw) if n_rows <= 1 << 31 else wide, F.lit(n_rows))
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("position", pick)
    return draws.join(dense_positions(df, key=key), "position").drop("position").join(df, key)


def evenly_spaced(ranked: DataFrame, position: str, n_rows: int, k: int = 100) -> DataFrame:
    """k evenly spaced rows by position; all rows if there are no more than k."""
    if n_rows <= k:
        return ranked
    spots = ranked.sparkSession.range(k).select(
        F.floor(F.col("id") * F.lit(n_rows - 1) / F.lit(k - 1)).cast("bigint").alias(position)
    )
    return small_join(ranked, spots.distinct(), k, position, "left_semi")


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order, for trial runs."""
    return df.orderBy(key).limit(n)


def random_mask(
    availability: DataFrame, n_patches: int, ratio: float, keys=("sample_id", "group_name"), seed=42
) -> DataFrame:
    """Visible patches per (sample, group): max(1, floor(N(1-r))) of N; none if unavailable.

    ``availability``: keys and ``available``; a ``ratio`` column overrides the argument.
    """
    r = F.col("ratio") if "ratio" in availability.columns else F.lit(float(ratio))
    keep = F.greatest(F.lit(1), F.floor(F.lit(n_patches) * (1 - r)))
    ids = [F.col(k) for k in keys]
    # The shuffled patch numbers of a row are an array made in place: no shuffle of rows.
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_patches - 1)),
            lambda p: F.struct(digest(seed, *ids, p).alias("h"), p.alias("patch")),
        )
    )
    rows = availability.select(*keys, "available", keep.alias("_keep"), F.posexplode(order).alias("_k", "p"))
    visible = (F.col("_k") < F.col("_keep")) & F.col("available")
    return rows.select(*keys, F.col("p.patch").alias("patch"), visible.alias("visible"))


def anchor_groups(availability: DataFrame, prob: float, seed=42, anchor_ratio=0.0, other_ratio=0.9,
                  base_ratio=0.75) -> DataFrame:
    """Mask ratio per (batch, group): complementary masking chosen once per batch.

    With the given probability one or two groups of the batch are anchors (fully visible) and
    all others are masked heavily; a batch with fewer than two available groups is left alone.
    """
    groups = availability.groupBy("batch_id", "group_name").agg(
        F.bool_or("available").alias("any_available")
    )
    batch = W.partitionBy("batch_id")
    coin = hash_int(seed, F.lit("use"), F.col("batch_id")) / F.lit(4294967296.0)
    n_anchor = 1 + hash_int(seed, F.lit("n"), F.col("batch_id")) % 2
    turn = F.row_number().over(
        W.partitionBy("batch_id", "any_available").orderBy(
            digest(seed, F.col("batch_id"), F.col("group_name")), "group_name"
        )
    )
    enough = F.count_if("any_available").over(batch) >= 2
    g = groups.withColumn("cross", (coin < prob) & enough)
    g = g.withColumn("anchor", F.col("cross") & F.col("any_available") & (turn <= n_anchor))
    ratio = (
        F.when(F.col("anchor"), anchor_ratio).when(F.col("cross"), other_ratio).otherwise(base_ratio)
    )
    return g.select("batch_id", "group_name", "cross", "anchor", ratio.alias("ratio"))


# ---- crops ---------------------------------------------------------------------------------


def prefix_sums(counts: DataFrame, width: int, height: int) -> DataFrame:
    """(row, col, n) to the sum of n above and left of each place of a grid, itself included: (row, col, upto).

    Counts are laid over an empty grid; a range frame gives both the same sum, and the
    grid's own rows are kept. Meant for grids of tiles, which have a row for some thousand cells.
    """
    i = F.col("id")
    empty = counts.sparkSession.range(width * height).select(
        F.floor(i / width).cast("int").alias("row"), (i % width).cast("int").alias("col"), F.lit(0).cast("bigint").alias("n")
    )
    known = counts.select("row", "col", F.col("n").cast("bigint").alias("n"), F.lit(False).alias("own"))
    along = W.partitionBy("row").orderBy("col").rangeBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    return (
        empty.withColumn("own", F.lit(True))
        .unionByName(known)
        .withColumn("n", F.sum("n").over(along))
        .where("own")
        .select("row", "col", F.sum("n").over(down).alias("upto"))
    )


def tile_prefixes(cells: DataFrame, tiles: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Summed-area tables of the valid cells inside the wanted tiles: (tile_row, tile_col, prefix).

    ``prefix`` has a row and a column of zeros in front, so that any rectangle is four look-ups. Cells of
    other tiles are dropped before the shuffle where the wanted tiles are few enough to be shipped.
    """
    t = grid.tile
    keys = ["tile_row", "tile_col"]
    placed = cells.where(F.col(value).isNotNull()).select(
        F.floor(F.col("row") / t).cast("int").alias("tile_row"),
        F.floor(F.col("col") / t).cast("int").alias("tile_col"),
        (F.col("row") % t * t + F.col("col") % t).cast("int").alias("idx"),
    )

    def build(key, table):
        inside = np.bincount(table["idx"].to_numpy(), minlength=t * t).reshape(t, t)
        prefix = np.zeros((t + 1, t + 1), np.int32)
        prefix[1:, 1:] = inside.cumsum(0).cumsum(1)
        row, col = (pa.array([k.as_py()], pa.int32()) for k in key)
        return pa.table({"tile_row": row, "tile_col": col, "prefix": pa.array([prefix.ravel()], pa.list_(pa.int32()))})

    hit = placed.join(tiles.select(*keys).distinct(), keys, "left_semi")
    return hit.groupBy(*keys).applyInArrow(build, "tile_row int, tile_col int, prefix array<int>")


def window_counts(cells: DataFrame, windows: DataFrame, keys: list[str], grid: Grid, size: int, value: str = "value") -> DataFrame:
    """Valid cells in each square window (``keys``, row0, col0): keys, n_valid.

    Two levels: tiles that a window covers whole come from prefix sums over tile totals, four look-ups a window; its edge
    tiles come from summed-area tables, made for tiles that some window cuts. No grid of single cells is laid out.
    """
    t = grid.tile
    spans, inner = {}, {}
    for name in ("row", "col"):
        first = F.col(f"{name}0")
        spans[name] = F.sequence(F.floor(first / t).cast("int"), F.floor((first + size - 1) / t).cast("int"))
        inner[name] = (F.ceil(first / t).cast("int"), (F.floor((first + size) / t) - 1).cast("int"))
    covered = (inner["row"][0] <= inner["row"][1]) & (inner["col"][0] <= inner["col"][1])
    touched = windows.withColumn("tile_row", F.explode(spans["row"])).withColumn("tile_col", F.explode(spans["col"]))
    whole = F.col("tile_row").between(*inner["row"]) & F.col("tile_col").between(*inner["col"])
    edges = touched.where(~whole)

    def at(row_end: str, col_end: str):
        place = []
        for name, end in (("row", row_end), ("col", col_end)):
            start = F.col(f"{name}0") - F.col(f"tile_{name}") * t
            place.append(F.greatest(start, F.lit(0)) if end == "low" else F.least(start + size, F.lit(t)))
        return F.get("prefix", (place[0] * (t + 1) + place[1]).cast("int"))

    inside = at("high", "high") - at("low", "high") - at("high", "low") + at("low", "low")
    cut = edges.join(tile_prefixes(cells, edges, grid, value), ["tile_row", "tile_col"]).select(*keys, inside.cast("bigint").alias("n"))
    if size >= t:
        tile = [F.floor(F.col(c) / t).cast("int").alias(c) for c in ("row", "col")]
        totals = cells.where(F.col(value).isNotNull()).select(*tile).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
        upto = prefix_sums(totals, grid.tiles_across, grid.tiles_down)
        corners = F.array(
            *[
                F.struct(
                    (inner["row"][1] if dr else inner["row"][0] - 1).alias("row"),
                    (inner["col"][1] if dc else inner["col"][0] - 1).alias("col"),
                    F.lit(1 if dr == dc else -1).alias("sign"),
                )
                for dr in (0, 1)
                for dc in (0, 1)
            ]
        )
        looked = windows.where(covered).select(*keys, F.explode(corners).alias("c")).select(*keys, "c.*")
        cut = cut.unionByName(looked.join(upto, ["row", "col"]).select(*keys, (F.col("sign") * F.col("upto")).alias("n")))
    counted = cut.groupBy(*keys).agg(F.sum("n").alias("n_valid"))
    return windows.select(*keys).join(counted, keys, "left").select(*keys, F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def crop_origins(
    spark: SparkSession, grid: Grid, n: int, size: int, tries: int = 20,
    rows: tuple[int, int] | None = None, seed=42,
) -> DataFrame:
    """All candidate origins (crop, try, row0, col0), uniform in the allowed rows."""
    lo, hi = rows if rows is not None else (0, grid.height - size)
    c = spark.range(n).withColumnRenamed("id", "crop_id")
    c = c.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    key = (F.col("crop_id"), F.col("try"))
    return c.withColumn(
        "row0", (F.lit(lo) + hash_int(seed, F.lit("row"), *key) % F.lit(hi - lo + 1)).cast("int")
    ).withColumn("col0", (hash_int(seed, F.lit("col"), *key) % F.lit(grid.width - size + 1)).cast("int"))


def latitude_rows(grid: Grid, size: int, lat_min: float, lat_max: float) -> tuple[int, int]:
    """Range of crop origins whose crops start inside a latitude band."""
    top = max(0, int((90.0 - lat_max) * grid.ppd))
    bottom = min(grid.height - size, int((90.0 - lat_min) * grid.ppd) - size)
    return top, max(top, bottom)


def sample_crops(
    cells: DataFrame, grid: Grid, n: int, size: int, min_valid: float = 0.3, tries: int = 20,
    rows: tuple[int, int] | None = None, seed=42,
) -> DataFrame:
    """First acceptable origin per crop: valid share of the lead channel at least ``min_valid``.

    Valid cells are counted in two levels, see :func:`window_counts`: the work follows the tiles that candidates
    touch, and not the grid. Crops without an acceptable try have ``accepted = false`` and NULL origin.
    """
    origins = crop_origins(cells.sparkSession, grid, n, size, tries, rows, seed)
    keys = ["crop_id", "try"]
    share = F.col("n_valid") / F.lit(float(size * size))
    scored = origins.join(window_counts(cells, origins, keys, grid, size), keys).withColumn("valid_fraction", share)
    good = F.when(F.col("valid_fraction") >= min_valid, F.col("try"))
    best = scored.groupBy("crop_id").agg(
        F.min(good).alias("try"),
        F.min_by("row0", good).alias("row0"),
        F.min_by("col0", good).alias("col0"),
        F.min_by("valid_fraction", good).alias("valid_fraction"),
    )
    return best.withColumn("accepted", F.col("try").isNotNull())


def blank_crops(crops: DataFrame, channels: list[str], size: int) -> DataFrame:
    """Samples of crops without an acceptable origin: zeros, and no channel available."""
    return crops.where(~F.col("accepted")).select(
        "crop_id",
        F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"),
        F.lit(False).alias("has_channel"),
        F.array_repeat(F.lit(0.0).cast("float"), size * size).alias("pixels"),
    )


def crop_pixels(crops: DataFrame, tiles: DataFrame, grid: Grid, size: int) -> DataFrame:
    """Crop arrays per channel, put together from the tiles each accepted crop touches.

    With tiles no smaller than crops those are four at most.
    """
    t = grid.tile

    def span(origin):
        return F.explode(F.sequence(F.floor(F.col(origin) / t), F.floor((F.col(origin) + size - 1) / t)))

    touched = crops.where("accepted").select("crop_id", "row0", "col0")
    touched = touched.withColumn("tile_row", span("row0")).withColumn("tile_col", span("col0"))
    parts = touched.join(tiles, ["tile_row", "tile_col"])

    def build(key, table):
        crop_id, channel = key[0].as_py(), key[1].as_py()
        out = np.full((size, size), np.nan)
        for i in range(table.num_rows):
            r0, c0 = table["row0"][i].as_py(), table["col0"][i].as_py()
            top, left = table["tile_row"][i].as_py() * t, table["tile_col"][i].as_py() * t
            m = table["data"][i].values.to_numpy(zero_copy_only=False).reshape(t, t)
            a, b = max(r0, top), min(r0 + size, top + t)
            c, d = max(c0, left), min(c0 + size, left + t)
            out[a - r0 : b - r0, c - c0 : d - c0] = m[a - top : b - top, c - left : d - left]
        return pa.table(
            {
                "crop_id": pa.array([crop_id], pa.int64()),
                "channel": pa.array([channel]),
                "has_channel": pa.array([bool(np.isfinite(out).any())]),
                "pixels": array_column([out]),
            }
        )

    return (
        parts.select("crop_id", "channel", "row0", "col0", "tile_row", "tile_col", "data")
        .groupBy("crop_id", "channel")
        .applyInArrow(build, "crop_id bigint, channel string, has_channel boolean, pixels array<float>")
    )
