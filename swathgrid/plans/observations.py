"""Queries on observation strips: filter, gridding, mosaic, daylight, streams, cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathgrid.functions.geo import illumination_weight, wrap_lon
from swathgrid.operators import mosaic as M
from swathgrid.operators.accumulate import mosaic_by_tiles
from swathgrid.operators.ranking import quantiles
from swathgrid.operators.tiles import stack_columns
from swathgrid.plans.files import write_cubes, write_flat_rasters
from swathgrid.plans.fixtures import LAYER_CHANNELS, LAYERS_SQL, OBS_GRID, dem_grid, fixture, table
from swathgrid.plans.registry import query
from swathgrid.sources import binary
from swathgrid.sources.workspace import scratch, written
from swathgrid.sources.writers import write_rasters
from swathgrid.streaming import admission, jobs

BANDS = ["b1", "b2"]

USABLE = """incidence > 0 AND incidence < 80 AND emission > 0 AND emission < 60
  AND b1 > 0 AND b1 < 1 AND b2 > 0 AND b2 < 1"""
WRAPPED = "(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END)"
ROW = "CAST(TRUNC((90e0 - lat) * 2e-1) AS INT)"
COL = f"CAST(TRUNC(({WRAPPED} + 180e0) * 2e-1) AS INT)"
ON_GRID = f"{ROW} BETWEEN 0 AND 35 AND {COL} BETWEEN 0 AND 71"

GRIDDED = f"""
SELECT *, {ROW} AS row, {COL} AS col, cos(radians(incidence)) AS w
FROM obs WHERE {USABLE} AND {ON_GRID}"""

MOSAIC_SQL = f"""
SELECT row, col, round(sum(w * b1) / sum(w), 6) AS b1, round(sum(w * b2) / sum(w), 6) AS b2,
       CAST(count(*) AS BIGINT) AS n_obs, round(sum(w * incidence) / sum(w), 6) AS mean_incidence,
       round(sum(w * emission) / sum(w), 6) AS mean_emission, round(sum(w * phase) / sum(w), 6) AS mean_phase
FROM ({GRIDDED}) g GROUP BY row, col"""

MEANS = [*BANDS, "mean_incidence", "mean_emission", "mean_phase"]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("mosaic_weighted", "F1 P4 P6 P25 A1 A2", MOSAIC_SQL)
def mosaic_weighted(spark, sf):
    return rounded(M.mosaic(fixture(spark, sf, "obs"), OBS_GRID, BANDS), *MEANS)


@query("mosaic_tiles", "A1 A2", MOSAIC_SQL)
def mosaic_tiles(spark, sf):
    return rounded(mosaic_by_tiles(fixture(spark, sf, "obs"), OBS_GRID, BANDS, block=8), *MEANS)


@query(
    "mosaic_coverage",
    "A2 A12",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_cells, round(count(*) * 100e0 / (72 * 36), 6) AS coverage_pct,
    round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(avg(v), 6) AS mean_value
    FROM (SELECT sum(w * b1) / sum(w) AS v FROM ({GRIDDED}) g GROUP BY row, col) m""",
)
def mosaic_coverage(spark, sf):
    out = M.coverage(M.mosaic(fixture(spark, sf, "obs"), OBS_GRID, BANDS), OBS_GRID, "b1")
    return rounded(out, "coverage_pct", "min_value", "max_value", "mean_value")


@query(
    "quality_filter",
    "F1 P25 S14",
    f"""SELECT strip_id, row, col, round(w, 6) AS w, CAST(count(*) AS BIGINT) AS n
    FROM ({GRIDDED}) g GROUP BY strip_id, row, col, round(w, 6)""",
)
def quality_filter(spark, sf):
    obs = M.usable_observations(fixture(spark, sf, "obs"), OBS_GRID, BANDS)
    w = F.round(illumination_weight(F.col("incidence")), 6).alias("w")
    return obs.groupBy("strip_id", "row", "col", w).agg(F.count(F.lit(1)).alias("n"))


@query(
    "location_cells",
    "P4 P6 P7 S6",
    f"""SELECT {ROW} AS row, {COL} AS col, CAST(count(*) AS BIGINT) AS n, round(min({WRAPPED}), 6) AS min_lon,
    round(90e0 - ({ROW} + 5e-1) / 2e-1, 6) AS cell_lat, round(-180e0 + ({COL} + 5e-1) / 2e-1, 6) AS cell_lon
    FROM obs WHERE {ON_GRID} GROUP BY 1, 2, 5, 6""",
)
def location_cells(spark, sf):
    cells = M.geolocate(fixture(spark, sf, "obs"), OBS_GRID)
    out = cells.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(wrap_lon(F.col("lon"))), 6).alias("min_lon")
    )
    return out.withColumn("cell_lat", F.round(OBS_GRID.lat_of(F.col("row")), 6)).withColumn(
        "cell_lon", F.round(OBS_GRID.lon_of(F.col("col")), 6)
    )


@query(
    "strip_bbox",
    "A29",
    f"""SELECT strip_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat,
    round(min({WRAPPED}), 6) AS min_lon, round(max({WRAPPED}), 6) AS max_lon, CAST(count(*) AS BIGINT) AS n_valid
    FROM ({GRIDDED}) g GROUP BY strip_id""",
)
def strip_bbox(spark, sf):
    out = M.strip_bounds(M.usable_observations(fixture(spark, sf, "obs"), OBS_GRID, BANDS))
    return rounded(out, "min_lat", "max_lat", "min_lon", "max_lon")


def strip_lines(obs):
    return obs.groupBy("strip_id").agg((F.max("line") + 1).alias("lines"))


SAMPLED = """SELECT o.strip_id, o.incidence FROM obs o
    JOIN (SELECT strip_id, max(line) + 1 AS lines FROM obs GROUP BY strip_id) s ON o.strip_id = s.strip_id
    WHERE o.line = 0 OR o.line = CAST(FLOOR(lines / 2e0) AS INT) OR o.line = lines - 1"""


@query(
    "strip_daytime",
    "F5",
    f"""SELECT strip_id, CAST(count(*) AS BIGINT) AS n_samples,
    CAST(count(*) FILTER (WHERE incidence > 0 AND incidence < 80) AS BIGINT) AS n_valid,
    count(*) FILTER (WHERE incidence > 0 AND incidence < 80) > 0 AS is_daytime
    FROM ({SAMPLED}) s GROUP BY strip_id""",
)
def strip_daytime(spark, sf):
    obs = fixture(spark, sf, "obs")
    strips = strip_lines(obs)
    out = M.daylight(M.sampled_lines(obs.select("strip_id", "line", "incidence"), strips), strips)
    return out.select("strip_id", "n_samples", "n_valid", "is_daytime")


@query(
    "strip_incidence_summary",
    "A30 F5",
    f"""SELECT strip_id, CAST(count(*) AS BIGINT) AS n_samples,
    round(count(*) FILTER (WHERE incidence > 0 AND incidence < 80) * 100e0 / count(*), 6) AS pct_valid,
    min(incidence) AS inc_min, max(incidence) AS inc_max,
    quantile_cont(incidence, 0.5) AS inc_median FROM ({SAMPLED}) s GROUP BY strip_id""",
)
def strip_incidence_summary(spark, sf):
    obs = fixture(spark, sf, "obs")
    strips = strip_lines(obs)
    lines = M.sampled_lines(obs.select("strip_id", "line", "incidence"), strips)
    median = quantiles(lines, "incidence", [0.5], ["strip_id"])
    out = M.daylight(lines, strips).join(
        median.select("strip_id", F.col("quantile").alias("inc_median")), "strip_id", "left"
    )
    return out.select(
        "strip_id", "n_samples", F.round("pct_valid", 6).alias("pct_valid"), "inc_min", "inc_max", "inc_median"
    )


@query(
    "truncated_files",
    "F8",
    """SELECT strip_id, length FROM (
      SELECT CAST(l_suppkey AS STRING) AS strip_id, CAST(max(l_linenumber) AS BIGINT) * 85 * 300 * 4 AS expected,
      CAST(FLOOR(max(l_linenumber) * 85 * 300 * 4e0 * (8e-1 + (l_suppkey % 7) / 2e1)) AS BIGINT) AS length
      FROM lineitem GROUP BY l_suppkey) f WHERE length >= 9e-1 * expected""",
)
def truncated_files(spark, sf):
    per_strip = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_linenumber").alias("lines"))
    size = F.col("lines") * 85 * 300 * 4.0 * (0.8 + (F.col("l_suppkey") % 7) / 20.0)
    files = per_strip.select(
        F.col("l_suppkey").cast("string").alias("strip_id"),
        "lines",
        F.lit(85).alias("bands"),
        F.lit(300).alias("samples"),
        binary.item_bytes(F.lit(4)).alias("item_bytes"),
        F.floor(size).alias("length"),
    )
    return M.complete_files(files).select("strip_id", "length")


# ---- streams -------------------------------------------------------------------------------


def state_session(spark):
    """A session whose state stores are as many as the cluster has cores."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


def _stream(spark, path, schema, glob, **options):
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(path)


def _obs_from(df):
    """The observation fixture on a streaming table."""
    return df.select(
        (F.col("l_partkey") % 1800).cast("double").alias("_p"),
        (F.col("l_orderkey") % 3600).cast("double").alias("_o"),
        (F.col("l_extendedprice") / 100000.0).alias("b1"),
        (F.col("l_quantity") / 55.0).alias("b2"),
        (F.col("l_quantity") * 2.0).alias("incidence"),
        (F.col("l_discount") * 800.0).alias("emission"),
        (F.col("l_tax") * 1000.0).alias("phase"),
    ).select(
        (F.col("_p") / 10.0 - 90.0 + 0.05).alias("lat"),
        (F.col("_o") / 10.0 + 0.05).alias("lon"),
        *BANDS,
        *M.ANGLES,
    )


@query("stream_mosaic", "T1", MOSAIC_SQL)
def stream_mosaic(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    strips = _obs_from(_stream(spark, sf, schema, "lineitem.parquet"))
    sink = scratch(spark, "mosaic")
    job = jobs.stream_mosaic(strips, OBS_GRID, BANDS, sink, scratch(spark, "mosaic-log"))
    partials = jobs.drain(job, lambda: spark.read.parquet(sink))
    return rounded(jobs.current_mosaic(partials.drop("batch"), BANDS), *MEANS)


@query("stream_mosaic_tiles", "T1 A1", MOSAIC_SQL)
def stream_mosaic_tiles(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    strips = _obs_from(_stream(spark, sf, schema, "lineitem.parquet"))
    sink = scratch(spark, "tiles")
    job = jobs.stream_tiles(strips, OBS_GRID, BANDS, sink, scratch(spark, "tiles-log"), block=8)
    partials = jobs.drain(job, lambda: spark.read.parquet(sink))
    return rounded(jobs.current_tiles(partials, OBS_GRID, BANDS, block=8), *MEANS)


@query(
    "stream_stats",
    "T2",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS channel, CAST(count({c}) AS BIGINT) AS n, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
        round(avg({c}), 6) AS mean, round(stddev_pop({c}), 5) AS std FROM obs"""
        for c in (*BANDS, "incidence", "emission", "phase")
    ),
)
def stream_stats(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    strips = _obs_from(_stream(state_session(spark), sf, schema, "lineitem.parquet"))
    cells = stack_columns(strips, {c: c for c in (*BANDS, *M.ANGLES)}, keep=())
    sink = scratch(spark, "stats")
    job = jobs.stream_stats(cells, sink, scratch(spark, "stats-log"))
    updates = jobs.drain(job, lambda: spark.read.parquet(sink))
    return rounded(rounded(jobs.current_stats(updates), "min", "max", "mean"), "std", digits=5)


@query(
    "stream_admission",
    "T3",
    """SELECT CAST(event_id AS STRING) AS product_id, round(value, 6) AS incidence FROM events
    WHERE value IS NULL OR (value > 0 AND value < 80)""",
)
def stream_admission(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("product_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("incidence"),
    )
    landing = scratch(spark, "arrivals")
    # Every product is delivered twice.
    events.write.parquet(landing)
    events.write.mode("append").parquet(landing)
    arrivals = _stream(state_session(spark), landing, events.schema, "*.parquet")
    out = scratch(spark, "admitted")
    job = jobs.admit_strips(arrivals, "product_id", "ts", "3650 days", out, scratch(spark, "admit-log"))
    admitted = jobs.drain(job, lambda: spark.read.parquet(out))
    return rounded(admitted.select("product_id", "incidence"), "incidence")


@query(
    "stream_verdicts",
    "T3 F5",
    f"""SELECT strip_id, CAST(count(*) AS BIGINT) AS n_samples,
    CAST(count(*) FILTER (WHERE incidence > 0 AND incidence < 80) AS BIGINT) AS n_valid,
    count(*) FILTER (WHERE incidence > 0 AND incidence < 80) > 0 AS is_daytime
    FROM ({SAMPLED}) s GROUP BY strip_id""",
)
def stream_verdicts(spark, sf):
    """Lines of strips in several batches, each delivered twice; a strip is judged when its three lines are there."""
    obs = fixture(spark, sf, "obs")
    good = (F.col("incidence") > 0) & (F.col("incidence") < 80)
    per_line = obs.groupBy("strip_id", "line").agg(
        F.count("incidence").alias("n_samples"), F.count_if(good).alias("n_valid"), F.min("obs_ts").cast("timestamp").alias("ts")
    )
    lines = per_line.join(strip_lines(obs), "strip_id").select(
        "strip_id", F.col("line").cast("int").alias("line"), F.col("lines").cast("int").alias("lines"), "n_samples", "n_valid", "ts"
    )
    landing, session = scratch(spark, "lines"), admission.keyed_session(spark)
    # Even lines come first, then all of them.
    lines.where("line % 2 = 0").coalesce(2).write.parquet(landing)
    lines.coalesce(2).write.mode("append").parquet(landing)
    arrivals = _stream(session, landing, lines.schema, "*.parquet", maxFilesPerTrigger=1)
    long = 10_000 * 86_400_000
    out = scratch(spark, "verdicts")
    job = admission.start_judging(admission.judge_strips(arrivals, "10000 days", long, long), out, scratch(spark, "verdict-log"))
    verdicts = jobs.drain(job, lambda: spark.read.schema(admission.VERDICT).parquet(out))
    return verdicts.select("strip_id", "n_samples", "n_valid", "is_daytime")


# KLL sketches of this size keep ranks within 1.33 % of the rows with 99 % certainty, so 3 % is safe.
RANK_ERROR = 0.03


@query(
    "stream_quantiles",
    "T2 A7 K6",
    f"""SELECT channel, prob, CAST(n AS BIGINT) AS n, true AS within FROM (
      {" UNION ALL ".join(f"SELECT '{c}' AS channel, count({c}) AS n FROM obs" for c in (*BANDS, "incidence"))}) c
    CROSS JOIN (SELECT 1e-2 AS prob UNION ALL SELECT 5e-1 UNION ALL SELECT 99e-2) p""",
)
def stream_quantiles(spark, sf):
    """Running quantiles from merged sketches: the exact rank of each must be near the wanted one."""
    obs, names = fixture(spark, sf, "obs"), (*BANDS, "incidence")
    cells = stack_columns(obs, {c: c for c in names}, keep=())
    landing = scratch(spark, "cells")
    cells.repartition(5).write.parquet(landing)
    arrivals = _stream(spark, landing, cells.schema, "*.parquet", maxFilesPerTrigger=2)
    sink = scratch(spark, "sketches")
    job = jobs.stream_sketches(arrivals, sink, scratch(spark, "sketch-log"))
    sketches = jobs.drain(job, lambda: spark.read.parquet(sink))
    found = jobs.current_quantiles(sketches, [0.01, 0.5, 0.99])
    ranks = cells.join(F.broadcast(found), "channel").groupBy("channel", "prob", "n").agg(
        F.count_if(F.col("value") < F.col("quantile")).alias("below"), F.count_if(F.col("value") <= F.col("quantile")).alias("upto")
    )
    slack, at = F.col("n") * RANK_ERROR, F.col("prob") * F.col("n")
    return ranks.select("channel", "prob", "n", ((F.col("below") - slack <= at) & (at <= F.col("upto") + slack)).alias("within"))


# ---- binary files derived from the tables --------------------------------------------------

STRIP_LINES = 8
CUBE_BANDS = ["lon", "lat", "incidence", "emission", "phase"]


def dem_strips(spark, sf):
    d = fixture(spark, sf, "dem")
    return d.select(
        F.floor(F.col("row") / STRIP_LINES).cast("string").alias("strip_id"),
        (F.col("row") % STRIP_LINES).alias("line"),
        F.col("col").alias("sample"),
        (F.col("col") * 2.88 + 1.44).alias("lon"),
        "lat",
        F.coalesce(F.col("lola") / 50, F.lit(-999.0)).alias("incidence"),
        F.lit(7.0).alias("emission"),
        F.coalesce(F.col("sldem") / 50, F.lit(-999.0)).alias("phase"),
    )


def cube_manifest(spark, sf):
    """Cubes and headers in the shared folder, and their manifest parsed from the headers."""
    folder = scratch(spark, "cubes").removeprefix("file:")
    files = written(write_cubes(dem_strips(spark, sf), folder, CUBE_BANDS), "files")
    headers = binary.cube_headers(spark, f"{folder}/*.hdr")
    strip = F.regexp_extract("hdr_path", r"([^/]+)\.hdr$", 1)
    return files.join(headers.withColumn("strip_id", strip), "strip_id")


STRIPS_SQL = """SELECT CAST(CAST(FLOOR(row / 8e0) AS INT) AS STRING) AS strip_id, row % 8 AS line, col AS sample,
    CAST(CAST(col * 288e-2 + 144e-2 AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat,
    CAST(CAST(coalesce(lola / 50, -999e0) AS FLOAT) AS DOUBLE) AS incidence,
    CAST(CAST(coalesce(sldem / 50, -999e0) AS FLOAT) AS DOUBLE) AS phase FROM dem"""


@query(
    "envi_cube",
    "S3 S4",
    f"""SELECT strip_id, line, sample, round(incidence, 3) AS incidence, round(lat, 3) AS lat
    FROM ({STRIPS_SQL}) s""",
)
def envi_cube(spark, sf):
    pixels = binary.read_cubes(cube_manifest(spark, sf), {"incidence": 2, "lat": 1}, lines_per_task=3)
    return _as_double(pixels, "incidence", "lat")


@query(
    "envi_location",
    "S6",
    f"""SELECT strip_id, line, sample, round(lat, 3) AS lat,
    round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 3) AS lon FROM ({STRIPS_SQL}) s""",
)
def envi_location(spark, sf):
    return _as_double(binary.read_locations(cube_manifest(spark, sf)), "lat", "lon")


@query(
    "envi_geometry",
    "S7",
    f"""SELECT strip_id, line, sample, round(lat, 3) AS incidence, 7e0 * 0 + round(emission, 3) AS emission, round(phase, 3) AS phase
    FROM (SELECT *, 7e0 AS emission FROM ({STRIPS_SQL}) s) t""",
)
def envi_geometry(spark, sf):
    return _as_double(binary.read_geometry(cube_manifest(spark, sf)), "incidence", "emission", "phase")


def _as_double(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in columns})


@query(
    "strip_daytime_files",
    "F5 S3",
    f"""SELECT s.strip_id, CAST(count(*) AS BIGINT) AS n_samples,
    CAST(count(*) FILTER (WHERE incidence > 0 AND incidence < 80) AS BIGINT) AS n_valid,
    count(*) FILTER (WHERE incidence > 0 AND incidence < 80) > 0 AS is_daytime
    FROM ({STRIPS_SQL}) s JOIN (SELECT strip_id, max(line) + 1 AS lines FROM ({STRIPS_SQL}) a GROUP BY strip_id) n
      ON s.strip_id = n.strip_id
    WHERE line = 0 OR line = CAST(FLOOR(lines / 2e0) AS INT) OR line = lines - 1 GROUP BY s.strip_id""",
)
def strip_daytime_files(spark, sf):
    """The daytime filter on cube files: the scan reads one band of three lines of each."""
    binary.register(spark)
    manifest, path = cube_manifest(spark, sf), scratch(spark, "manifest")
    manifest.write.parquet(path)
    cubes = spark.read.format("envi_bil").options(manifest=path, select="2", pushdown=True).load().where("sampled")
    lines = cubes.select(F.col("file").alias("strip_id"), "line", F.col("bands")[0].cast("double").alias("incidence"))
    out = M.daylight(lines, spark.read.parquet(path).select("strip_id", "lines"))
    return out.select("strip_id", "n_samples", "n_valid", "is_daytime")


@query(
    "cube_window",
    "S3 S14",
    f"""SELECT strip_id, line, sample, round(phase, 3) AS phase, round(lat, 3) AS lat FROM ({STRIPS_SQL}) s
    WHERE strip_id IN ('0', '1') AND line >= 2 AND line < 7 AND (sample BETWEEN 10 AND 19 OR sample = 30)""",
)
def cube_window(spark, sf):
    """Two bands of a window of lines and samples from two of the files."""
    binary.register(spark)
    path = scratch(spark, "manifest")
    cube_manifest(spark, sf).write.parquet(path)
    window = {"file": ["0", "1"], "line": [(2, 7)], "sample": [(10, 20), (30, 31)]}
    hit = binary.scan(spark, "envi_bil", window, manifest=path, select="4,1", linesPerTask=2)
    bands = [F.col("bands")[i].alias(n) for i, n in enumerate(("phase", "lat"))]
    return _as_double(hit.select(F.col("file").alias("strip_id"), "line", "sample", *bands), "phase", "lat")


FLAT_ROWS = 50


FLAT_SQL = "SELECT row, col, round(CAST(CAST(lola AS FLOAT) AS DOUBLE), 3) AS value FROM dem"


def flat_folder(spark, sf):
    folder = scratch(spark, "flat").removeprefix("file:")
    dem = fixture(spark, sf, "dem").select("row", "col", F.col("lola").alias("value"))
    written(write_flat_rasters(dem, folder, 125, FLAT_ROWS), "flat-files")
    return folder


def _part_row(name):
    return (F.regexp_extract(name, r"part-(\d+)", 1).cast("int") * FLAT_ROWS + F.col("row")).cast("int")


@query("flat_raster", "S1", FLAT_SQL)
def flat_raster(spark, sf):
    """The data source over a folder of raster files."""
    binary.register(spark)
    raster = spark.read.format("flat_raster").option("rowsPerTask", 20).load(flat_folder(spark, sf))
    return _as_double(raster.withColumn("row", _part_row("file")).drop("file"), "value")


@query("flat_raster_labels", "S1 S2", FLAT_SQL)
def flat_raster_labels(spark, sf):
    """The same files through a manifest that Spark parses from the labels."""
    manifest = binary.flat_manifest(spark, f"{flat_folder(spark, sf)}/*.lbl")
    cells = binary.read_cubes(manifest, {"value": 0}).withColumnsRenamed({"line": "row", "sample": "col"})
    return _as_double(cells.withColumn("row", _part_row("strip_id")).drop("strip_id"), "value")


@query(
    "raster_writer",
    "K2 K3 S1",
    f"""SELECT channel, row, col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM ({LAYERS_SQL}) l
    WHERE channel IN ('elevation', 'lpgrs_feo', 'mystery') AND row BETWEEN 3 AND 9""",
)
def raster_writer(spark, sf):
    """All layers through the raster sink, then rows of three of them through the scan."""
    binary.register(spark)
    path = scratch(spark, "layers").removeprefix("file:")
    grid = dem_grid(spark, sf)
    layers = stack_columns(fixture(spark, sf, "rasters"), {c: c for c in LAYER_CHANNELS})
    write_rasters(layers, path, grid.width, grid.height, rows_per_file=4)
    parts = [f"{c}/part-{i}.img" for c in ("elevation", "lpgrs_feo", "mystery") for i in range(3)]
    raster = binary.scan(spark, "flat_raster", {"file": parts}, path=path)
    row = (F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 4 + F.col("row")).alias("row")
    cells = raster.select(F.regexp_extract("file", "^[^/]+", 0).alias("channel"), row, "col", "value")
    return _as_double(cells.where(F.col("row").between(3, 9)), "value")


@query(
    "strip_product",
    "C12 K4",
    """SELECT row, col, round(sum(w * value) / sum(w), 4) AS value, CAST(count(*) AS BIGINT) AS n_obs FROM (
      SELECT CAST(TRUNC((90e0 - lat) * 2e-1) AS INT) AS row,
             CAST(TRUNC(((CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) + 180e0) * 2e-1) AS INT) AS col,
             cos(radians(inc)) AS w, value
      FROM (SELECT CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat, CAST(CAST(col * 288e-2 + 144e-2 AS FLOAT) AS DOUBLE) AS lon,
                   CAST(CAST(lola / 50 AS FLOAT) AS DOUBLE) AS inc,
                   CAST(CAST(sldem / 50 AS FLOAT) AS DOUBLE) / 100 AS value FROM dem) d
      WHERE inc > 0 AND inc < 80 AND value > 0 AND value < 1) g WHERE col < 72 GROUP BY row, col""",
)
def strip_product(spark, sf):
    """Cubes to mosaic: size check, band-selected scan, filter, observation table, weighted mean."""
    manifest = cube_manifest(spark, sf).withColumn("item_bytes", binary.item_bytes(F.col("data_type")))
    manifest = M.complete_files(manifest)
    pixels = binary.read_cubes(manifest, {"lon": 0, "lat": 1, "incidence": 2, "emission": 3, "value": 4})
    pixels = pixels.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat", "incidence", "value")})
    pixels = pixels.withColumn("phase", F.col("value")).withColumn("value", F.col("value") / 100)
    obs = M.usable_observations(pixels, OBS_GRID, ["value"]).select(
        "strip_id", "row", "col", "value", *M.ANGLES
    )
    stored = written(obs, "observations")
    out = M.finalise(M.weighted_sums(stored, ["value"]), ["value"])
    return out.select("row", "col", F.round("value", 4).alias("value"), "n_obs")
