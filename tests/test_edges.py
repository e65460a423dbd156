"""Hand-made edge cases, against NumPy where a closed form is easier to trust."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.functions import labels as L
from swathgrid.functions import text as X
from swathgrid.functions import values as V
from swathgrid.functions.geo import wrap_lon
from swathgrid.grid import Grid
from swathgrid.operators import catalog as C
from swathgrid.operators import metrics as M
from swathgrid.operators import mosaic, ranking, raster, registration, sampling, stencil, vector, zonal
from swathgrid.operators import stats as S
from swathgrid.operators import tiles as T

NAN = float("nan")


def cells(spark, matrix, **extra):
    rows = [
        (r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(matrix) for c, v in enumerate(line)
    ]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return df


def matrix(df, value, shape):
    out = np.full(shape, np.nan)
    for row in df.collect():
        if row[value] is not None:
            out[row["row"], row["col"]] = row[value]
    return out


def column(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def field(seed, h, w, holes=0.1):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 100, (h, w))
    m[rng.random((h, w)) < holes] = np.nan
    return m


# ---- grid ----------------------------------------------------------------------------------


def test_positions_at_the_edges(spark):
    grid = Grid(360, 180, 1.0)
    rows = [("edge", 0.5, 180.0), ("wrap", 0.5, 180.0001), ("north", 90.0, 1.0), ("south", -90.0, 1.0),
            ("nan", NAN, 1.0), ("west", 0.5, -180.4)]
    df = spark.createDataFrame(rows, "k string, lat double, lon double")
    got = {r["k"]: (r["row"], r["col"]) for r in mosaic.geolocate(df, grid).collect()}
    # -180.4 gives column -0.4, which truncates to 0.
    assert got == {"wrap": (89, 0), "north": (0, 181), "west": (89, 0)}
    assert column(spark, wrap_lon(F.col("x")), [(180.0,), (181.0,)], "x double") == [180.0, -179.0]


def test_nodata_rules(spark):
    rows = [(NAN,), (float("inf"),), (-999.0,), (0.0,), (7.0,)]
    assert column(spark, V.finite(F.col("x")), rows, "x double") == [None, None, -999.0, 0.0, 7.0]
    scaled = V.rescale(V.finite(F.col("x")), 2, 1, nodata=-999.0)
    assert column(spark, scaled, rows, "x double") == [None, None, None, 1.0, 15.0]
    logs = column(spark, V.log1p_compress(F.col("x")), [(-2.0,), (-1.0,), (-0.5,), (0.0,), (1.0,)], "x double")
    assert logs == [None, 0.0, 0.0, 0.0, math.log(2)]


# ---- stencils ------------------------------------------------------------------------------


def slope_twin(m, px, lat):
    h, w = m.shape
    gy, gx = np.full(m.shape, np.nan), np.full(m.shape, np.nan)
    for r in range(h):
        for c in range(w):
            up, down = max(r - 1, 0), min(r + 1, h - 1)
            left, right = max(c - 1, 0), min(c + 1, w - 1)
            gy[r, c] = (m[down, c] - m[up, c]) / (down - up)
            gx[r, c] = (m[r, right] - m[r, left]) / (right - left)
    gx = gx / (px * np.maximum(np.cos(np.radians(lat)), 0.01))[:, None]
    return np.where(np.isnan(m), np.nan, np.degrees(np.arctan(np.sqrt(gx**2 + (gy / px) ** 2))))


def rough_twin(m, k=2):
    h, w = m.shape
    out = np.full(m.shape, np.nan)
    for r in range(h):
        for c in range(w):
            rows = np.clip(np.arange(r - k, r + k + 1), 0, h - 1)
            cols = np.clip(np.arange(c - k, c + k + 1), 0, w - 1)
            if not np.isnan(m[r, c]):
                out[r, c] = np.nanstd(m[np.ix_(rows, cols)])
    return out


@pytest.mark.parametrize("block", [4, 7, 256])
def test_slope_and_roughness_equal_numpy(spark, block):
    m = field(3, 12, 15)
    grid = Grid(15, 12, 0.5)
    lat = 90 - (np.arange(12) + 0.5) / 0.5
    s = stencil.slope(cells(spark, m), grid, pixel_m=50.0, block=block)
    np.testing.assert_allclose(matrix(s, "slope", m.shape), slope_twin(m, 50.0, lat), atol=1e-9)
    r = stencil.roughness(cells(spark, m), grid, block=block)
    assert r.count() == m.size
    np.testing.assert_allclose(matrix(r, "roughness", m.shape), rough_twin(m), atol=1e-6)


def test_slope_null_centre_and_null_edge_neighbour(spark):
    m = np.array([[1.0, 2.0, 3.0], [NAN, NAN, 6.0], [7.0, 8.0, 9.0]])
    out = matrix(stencil.slope(cells(spark, m), Grid(3, 3, 1.0), pixel_m=1.0), "slope", (3, 3))
    assert np.isnan(out[1, 1])
    # One-sided at the border uses the missing inner neighbour: NULL, not a wider difference.
    assert np.isnan(out[1, 2]) and np.isnan(out[0, 0])


def test_roughness_constant_and_single_cell(spark):
    flat = np.full((6, 6), 1234.5)
    out = matrix(stencil.roughness(cells(spark, flat), Grid(6, 6, 1.0)), "roughness", (6, 6))
    assert np.all(out == 0)
    lone = np.full((7, 7), NAN)
    lone[3, 3] = 5000.0
    out = matrix(stencil.roughness(cells(spark, lone), Grid(7, 7, 1.0)), "roughness", (7, 7))
    assert out[3, 3] == 0 and np.isnan(out).sum() == 48


def test_tile_forms_equal_cell_forms(spark):
    m = field(5, 12, 16)
    grid = Grid(16, 12, 0.5, tile=4)
    tiles = T.pack_tiles(cells(spark, m, channel=F.lit("dem")), grid)
    pairs = [
        (stencil.slope_tiles(tiles, grid, 50.0), stencil.slope(cells(spark, m), grid, pixel_m=50.0), "slope"),
        (stencil.roughness_tiles(tiles, grid), stencil.roughness(cells(spark, m), grid), "roughness"),
    ]
    for dense, sparse, name in pairs:
        a = matrix(T.unpack_tiles(dense, grid), "value", m.shape)
        np.testing.assert_allclose(a, matrix(sparse, name, m.shape), rtol=1e-3, atol=1e-3)


def test_sparse_cells_are_like_null_cells(spark):
    m = field(8, 9, 9, 0.3)
    grid = Grid(9, 9, 0.5)
    full = cells(spark, m)
    some = full.where(F.col("value").isNotNull())
    for run, name in ((stencil.slope, "slope"), (stencil.roughness, "roughness")):
        np.testing.assert_allclose(
            matrix(run(some, grid), name, m.shape), matrix(run(full, grid), name, m.shape), atol=1e-9
        )


# ---- regridding ----------------------------------------------------------------------------


@pytest.mark.parametrize("dst", [(24, 40), (5, 7), (12, 15), (13, 15)])
def test_bilinear_equals_numpy(spark, dst):
    m = field(11, 12, 15, 0.2)
    out = raster.regrid_bilinear(cells(spark, m), m.shape, dst, block=4)
    want = np.full(dst, np.nan)
    for r in range(dst[0]):
        for c in range(dst[1]):
            y = (r + 0.5) * 12 / dst[0] - 0.5
            x = (c + 0.5) * 15 / dst[1] - 0.5
            t = w = 0.0
            for i in (math.floor(y), math.floor(y) + 1):
                for j in (math.floor(x), math.floor(x) + 1):
                    if 0 <= i < 12 and 0 <= j < 15 and not np.isnan(m[i, j]):
                        k = (1 - abs(y - i)) * (1 - abs(x - j))
                        t, w = t + k * m[i, j], w + k
            if w > 0:
                want[r, c] = t / w
    rows = out.collect()
    assert len(rows) == len({(x["row"], x["col"]) for x in rows}) == np.isfinite(want).sum()
    np.testing.assert_allclose(matrix(out, "value", dst), want, atol=1e-9)


def test_scattered_gridding_reproduces_planes_and_extends_flat(spark):
    plane = lambda lat, lon: 2 + 0.1 * lat - 0.05 * lon
    rows = [
        (float(lat), lon + (lat % 40) / 10.0, plane(lat, lon + (lat % 40) / 10.0))
        for lat in range(-80, 81, 20)
        for lon in np.arange(-150.0, 151.0, 30.0).tolist()
    ]
    df = spark.createDataFrame(rows, "lat double, lon double, value double")
    out = matrix(raster.grid_scattered(df, 72, 36), "value", (36, 72))
    assert np.isfinite(out).all()
    lat = 90 - (np.arange(36) + 0.5) * 5
    lon = -180 + (np.arange(72) + 0.5) * 5
    inner = np.ix_(np.abs(lat) < 79, np.abs(lon) < 140)
    np.testing.assert_allclose(out[inner], plane(lat[:, None], lon[None])[inner], atol=1e-9)
    np.testing.assert_allclose(out[0], out[1], atol=1e-9)


def test_shift_rules(spark):
    df = cells(spark, np.arange(12.0).reshape(3, 4))
    moved = matrix(raster.shift(df, 4, 3, 0.5, 1.5), "value", (3, 4))  # rounds to (0, 2)
    np.testing.assert_array_equal(moved[:, 2:], np.arange(12.0).reshape(3, 4)[:, :2])
    assert np.isnan(moved[:, :2]).all()
    assert raster.shift(df, 4, 3, 0.4, -0.4) is df
    with pytest.raises(ValueError):
        raster.shift(df, 4, 3, 11, 0)


def test_blend_limits(spark):
    rows = [
        (0, 0, 57.9, 1.0, None), (0, 1, 57.9, None, 2.0), (0, 2, 58.0, 1.0, 3.0), (0, 3, 60.0, 1.0, 3.0),
        (0, 4, 60.0, None, 3.0), (0, 5, -62.0, 1.0, 3.0), (0, 6, 61.0, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "row int, col int, lat double, l double, s double")
    out = raster.blend_dems(df.withColumnRenamed("l", "value"), df.withColumnRenamed("s", "value"))
    got = [r["elevation"] for r in out.orderBy("col").collect()]
    assert got == [1.0, 2.0, 3.0, 2.0, None, 1.0, 1.0]


# ---- vectors -------------------------------------------------------------------------------


def test_disks_wrap_and_clip(spark):
    grid = Grid(360, 180, 1.0)
    rows = [(1, 0.0, 179.9, 200.0), (2, 89.9, 10.0, 150.0), (3, -89.9, -179.9, 120.0), (4, 10.3, 20.7, 61.0)]
    df = spark.createDataFrame(rows, "crater_id int, lat double, lon double, diam_km double")
    got = {(r["row"], r["col"]) for r in vector.crater_mask(df, grid).collect()}
    want = set()
    for _, lat, lon, d in rows:
        r = d / (2 * math.pi * 1737.4 / 360) / 2
        cx, cy = lon + 180, 90 - lat
        centres = [cx] + ([cx + 360] if cx - r < 0 else [cx - 360] if cx + r > 360 else [])
        for x0 in centres:
            want |= {
                (y, x) for y in range(180) for x in range(360) if (x - x0) ** 2 + (y - cy) ** 2 <= r * r
            }
    assert got == want


def test_every_bit_of_a_word(spark):
    runs = spark.createDataFrame([(0, 0, 63), (1, 63, 64), (2, 5, 200), (2, 150, 260), (3, 127, 127)],
                                 "row int, first int, last int")
    got = {(r["row"], r["col"]) for r in vector.covered_cells(runs).collect()}
    want = {(0, c) for c in range(64)} | {(1, 63), (1, 64), (3, 127)} | {(2, c) for c in range(5, 261)}
    assert got == want


def test_polygon_with_hole_and_overwrite(spark):
    def ring(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    rows = [(1, "A", ring(-10.0, -10.0, 10.0, 10.0)), (1, "A", ring(-5.0, -5.0, 5.0, 5.0)),
            (2, "B", ring(8.0, 8.0, 12.0, 12.0))]
    df = spark.createDataFrame(rows, "ordinal int, unit string, ring array<struct<x:double,y:double>>")
    got = {(r["row"], r["col"]): r["ordinal"] for r in vector.polygon_raster(df, Grid(360, 180, 1.0)).collect()}
    assert sum(v == 2 for v in got.values()) == 16
    assert sum(v == 1 for v in got.values()) == 400 - 100 - 4
    assert (90, 180) not in got


# ---- zones and splits ----------------------------------------------------------------------


def test_ties_go_to_the_first_seen(spark):
    rows = [(0, 0, 0, 2, 0), (0, 0, 1, 1, 1), (0, 0, 2, 1, 1), (0, 0, 3, 2, 0), (0, 1, 0, None, None)]
    df = spark.createDataFrame(rows, "tile_row int, tile_col int, idx int, unit_id int, mare int")
    got = {r["tile_col"]: r for r in zonal.zonal_units(df).collect()}
    assert (got[0]["dominant_unit_id"], got[0]["n_geo_units"], got[0]["mare_fraction"]) == (2, 2, 0.5)
    assert (got[1]["dominant_unit_id"], got[1]["n_geo_units"], got[1]["mare_fraction"]) == (0, 0, None)


def test_small_categories_fill_test_first(spark):
    sizes = {0: 1, 1: 2, 2: 3, 3: 10}
    rows = [(100 * c + i, c) for c, n in sizes.items() for i in range(n)]
    out = zonal.split_blocks(spark.createDataFrame(rows, "block_id int, category int"))
    counts = {}
    for r in out.collect():
        counts.setdefault(r["category"], []).append(r["split"])
    assert sorted(counts[0]) == ["test"]
    assert sorted(counts[1]) == ["test", "val"]
    assert sorted(counts[2]) == ["test", "train", "val"]
    assert sorted(counts[3]) == ["test"] + ["train"] * 8 + ["val"]


def test_labels(spark):
    rows = [("pNb",), ("Nc",), ("EIp",), ("Im2",), ("Em",), ("Cc",), ("lIx",), ("x",)]
    assert column(spark, L.age_class(F.col("u")), rows, "u string") == [0, 1, 2, 2, 3, 4, -1, -1]
    cat = L.terrain_category(F.col("lat"), F.col("m"))
    rows = [(80.0, None), (80.5, None), (0.0, 0.7), (0.0, 0.71), (0.0, 0.31), (-81.0, 0.9)]
    assert column(spark, cat, rows, "lat double, m double") == [0, 3, 1, 2, 1, 3]


# ---- ranks, quantiles, samples -------------------------------------------------------------


@pytest.mark.parametrize("direct", [0, 50, 10**9])
def test_quantiles_on_ugly_values(spark, direct):
    rng = np.random.default_rng(1)
    groups = {
        "heavy": np.concatenate([[5.0] * 300, rng.normal(0, 1, 200), [1e300, -1e300]]),
        "cluster": 1e6 + rng.random(400) * 1e-7,
        "tail": np.exp(rng.normal(0, 12, 500)),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("heavy", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    out = ranking.quantiles(df, "v", probs, ["k"], buckets=16, direct_rows=direct)
    got = {(r["k"], r["prob"]): r["quantile"] for r in out.collect()}
    assert len(got) == len(groups) * len(probs)
    for k, vs in groups.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, p)


def test_ranks_cover_a_hot_key(spark):
    from swathgrid.functions.hashing import digest

    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("k"))
    out = ranking.hash_rank(df.withColumn("_h", digest(1, F.col("id"))), ["k"], "_h", "id")
    rows = out.collect()
    assert sorted(r["rank"] for r in rows if r["k"] == "hot") == list(range(1, 2001))
    assert {r["n_in_key"] for r in rows if r["k"] == "cold"} == {1000}
    hashed = df.withColumn("_h", digest(1, F.col("id")))
    short = ranking.first_by_hash(hashed, ["k"], "_h", "id", 7)
    # Spark cuts each task's share before the shuffle.
    assert "WindowGroupLimit" in short._jdf.queryExecution().toString()
    by_rank = {(r["k"], r["id"]) for r in rows if r["rank"] <= 7}
    assert {(r["k"], r["id"]) for r in short.collect()} == by_rank


def test_crops_do_not_exceed_the_grid(spark):
    m = field(2, 30, 40, 0.4)
    grid = Grid(40, 30, 1.0, tile=5)
    out = sampling.sample_crops(cells(spark, m), grid, 60, 7, min_valid=0.6, tries=6).collect()
    assert len(out) == 60 and any(r["accepted"] for r in out)
    for r in out:
        if r["accepted"]:
            window = m[r["row0"] : r["row0"] + 7, r["col0"] : r["col0"] + 7]
            assert window.shape == (7, 7)
            assert np.isfinite(window).mean() == pytest.approx(r["valid_fraction"])
    rejected = sampling.sample_crops(cells(spark, m), grid, 5, 7, min_valid=1.1, tries=3).collect()
    assert [r["accepted"] for r in rejected] == [False] * 5
    none = sampling.sample_crops(cells(spark, m), grid, 5, 7, min_valid=1.1, tries=3)
    blank = sampling.blank_crops(none, ["slope", "elevation"], 7).collect()
    assert len(blank) == 10 and not any(r["has_channel"] or any(r["pixels"]) for r in blank)
    tiles = T.pack_tiles(cells(spark, m, channel=F.lit("slope")), grid)
    some = sampling.sample_crops(cells(spark, m), grid, 60, 7, min_valid=0.6, tries=6)
    made = {r["crop_id"]: r["pixels"] for r in sampling.crop_pixels(some, tiles, grid, 7).collect()}
    for r in out:
        if r["accepted"]:
            got = np.array([np.nan if v is None else v for v in made[r["crop_id"]]]).reshape(7, 7)
            want = m[r["row0"] : r["row0"] + 7, r["col0"] : r["col0"] + 7]
            np.testing.assert_allclose(got, want, rtol=1e-5)


def test_evenly_spaced_keeps_short_tables(spark):
    df = spark.range(40).withColumnRenamed("id", "i")
    assert sampling.evenly_spaced(df, "i", 40, 100).count() == 40
    assert sampling.evenly_spaced(spark.range(1000).withColumnRenamed("id", "i"), "i", 1000, 100).count() == 100


# ---- statistics and metrics ----------------------------------------------------------------


def test_robust_location(spark):
    rows = [("tight", x) for x in (2.0, 2.0, 2.25, 2.0, 40.0)]
    rows += [("wide", x) for x in (1.0, 2.0, 3.0, 4.0, 100.0)]
    df = spark.createDataFrame(rows, "k string, d double")
    got = {r["k"]: r["location"] for r in S.robust_location(df, "d", ["k"]).collect()}
    assert got == {"tight": 2.0, "wide": 2.5}
    assert S.robust_location(df.where("k = 'wide'"), "d").first()["location"] == 2.5


def test_absent_class_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "target int, pred int")
    row = M.classification(df, 3).first()
    assert row["accuracy"] == pytest.approx(2 / 3)
    assert row["macro_f1"] == pytest.approx(0.8 / 3)
    assert row["present_macro_f1"] == pytest.approx(0.4)


def test_degenerate_regressions(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "target double, pred double")
    row = M.regression(flat).first()
    assert row["pearson"] == 0 and row["r2"] == pytest.approx(1 - 5 / 1e-8)
    same = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "target double, pred double")
    assert M.regression(same).first()["pearson"] == 0


# ---- registration --------------------------------------------------------------------------


def test_registration_recovers_a_roll(spark):
    m = field(21, 32, 32, 0.05)
    moved = np.roll(m, (-3, 2), axis=(0, 1))
    assert registration.phase_offset(m, moved)[:2] == (3.0, -2.0)
    grid = Grid(32, 32, 1.0)
    regions = registration.lattice_regions(spark, grid, 16)
    fixed, rest = registration.register(cells(spark, m), cells(spark, moved), regions, grid)
    assert {(r["dy"], r["dx"]) for r in rest.collect()} == {(0.0, 0.0)}
    kept = matrix(fixed, "value", m.shape)
    inner = ~np.isnan(kept)
    np.testing.assert_array_equal(kept[inner], m[inner])
    assert registration.phase_offset(np.full((8, 8), 1.0), m[:8, :8]) is None


def test_named_regions(spark):
    rows = registration.named_regions(spark, Grid.lunar()).collect()
    assert len(rows) == 20
    assert all(r["r1"] - r["r0"] == 512 and r["c1"] - r["c0"] == 512 for r in rows)


# ---- catalogues and text -------------------------------------------------------------------


def test_pairing_last_wins_and_blank_rows(spark):
    schema = "external_url string, center_lat double, center_lon double, n int"
    left = [("http://a/d/M3G20090101T000000_V01_L2.LBL", 1.0, 2.0, 0), ("", 0.0, 0.0, 1),
            ("http://a/d/M3G20090102T000000_V01_L2.LBL", 1.0, 2.0, 2), ("http://a/d/odd_V01_L2.LBL", 0.0, 0.0, 3)]
    right = [("http://a/old/M3G20090101T000000_V03_L1B.LBL", 0.0, 0.0, 0),
             ("http://a/new/M3G20090101T000000_V03_L1B.LBL", 0.0, 0.0, 1), ("http://a/new/none_V03.LBL", 0.0, 0.0, 2)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rows = C.pair_products(a, b, "n").collect()
    assert [r["loc_img"] for r in rows] == ["http://a/new/M3G20090101T000000_V03_LOC.IMG"]
    lost = C.unmatched_products(a, b, "n").collect()
    assert {r["n"] for r in lost} == {2, 3}


def test_header_folding_and_last_key(spark):
    text = "ENVI\nSamples = 10\n; lines = 1\nlines = 2\nlines = 30\nband names = {a b,\n   c ,}\nx = 1 = 2\n"
    df = spark.createDataFrame([(text,)], "t string").select(X.parse_header(F.col("t")).alias("h"))
    h = df.first()["h"]
    assert h["samples"] == "10" and h["lines"] == "30" and h["x"] == "1 = 2"
    assert df.select(X.header_list(F.col("h")["band_names"])).first()[0] == ["a b", "c"]
    label = 'A = "x"\nB = 1\nA = "y"\n'
    row = spark.createDataFrame([(label,)], "t string").select(X.parse_label(F.col("t"))).first()[0]
    assert row == {"A": "y", "B": "1"}


def test_no_nan_leaves_the_packers(spark):
    m = field(4, 10, 10, 0.5)
    tiles = T.pack_tiles(cells(spark, m, channel=F.lit("slope")), Grid(10, 10, 1.0, tile=5))
    bad = tiles.select(F.exists("data", lambda v: F.isnan(v)).alias("b")).where("b").count()
    assert bad == 0
    z = T.normalise_tiles(tiles).select(F.explode("data").alias("v"))
    assert z.where(F.col("v").isNull()).count() == int(np.isnan(m).sum())
