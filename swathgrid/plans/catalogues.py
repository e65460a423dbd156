"""Queries on product listings, labels and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathgrid.operators import catalog as C
from swathgrid.operators import raster as R
from swathgrid.operators.metrics import best_epoch, metric_means
from swathgrid.plans.fixtures import fixture, table
from swathgrid.plans.rasters import gridded_bins_sql, off_tie, rounded
from swathgrid.plans.registry import query
from swathgrid.sources import tables as IO
from swathgrid.sources.workspace import scratch

PID = "regexp_extract(external_url, '([^/]+)_V0', 1)"
TS = "regexp_extract(external_url, '([0-9]{8}T[0-9]{6})', 1)"
DIR = """CASE WHEN external_url LIKE 'http://pds-imaging%' THEN 'https://planetarydata.jpl.nasa.gov/img/data/D' ELSE 'http://arch.example/data/D' END"""


def _files(kind, version, names):
    return ", ".join(
        f"concat({DIR}, '/', {PID}, '_{version}_{n.upper()}.{x.upper()}') AS {n}_{x}" for n in names for x in ("hdr", "img")
    )


REFLECTANCE_SQL = f"""SELECT *, {PID} AS product_id, {TS} AS timestamp, {_files('rfl', 'V01', ['rfl'])} FROM products WHERE level = 'L2' AND external_url <> ''"""
GEOMETRY_SQL = f"""SELECT *, {TS} AS timestamp, {_files('geo', 'V03', ['loc', 'obs'])} FROM products WHERE level = 'L1B' AND external_url <> ''"""
LAST_GEOMETRY = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY event_id DESC) AS k FROM ({GEOMETRY_SQL}) g) h WHERE k = 1"
PAIRS_SQL = f"""SELECT l.timestamp, l.product_id, l.center_lat, l.center_lon, rfl_hdr, rfl_img, loc_hdr, loc_img, obs_hdr, obs_img
    FROM ({REFLECTANCE_SQL}) l JOIN ({LAST_GEOMETRY}) r ON l.timestamp = r.timestamp"""


def levels(spark, sf):
    p = fixture(spark, sf, "products")
    return p.where(F.col("level") == "L2"), p.where(F.col("level") == "L1B")


def pairs(spark, sf):
    return C.pair_products(*levels(spark, sf), "event_id")


@query(
    "product_urls",
    "SC1",
    f"SELECT event_id, product_id, {DIR} AS base_dir, timestamp, rfl_hdr, rfl_img FROM ({REFLECTANCE_SQL}) r",
)
def product_urls(spark, sf):
    parsed = C.parse_products(levels(spark, sf)[0], "reflectance")
    return parsed.select("event_id", "product_id", "base_dir", "timestamp", "rfl_hdr", "rfl_img")


@query("catalog_pairing", "J1 N9 SC1", PAIRS_SQL)
def catalog_pairing(spark, sf):
    return pairs(spark, sf)


@query(
    "catalog_unmatched",
    "J1",
    f"""SELECT event_id, product_id FROM ({REFLECTANCE_SQL}) l WHERE timestamp NOT IN (SELECT timestamp FROM ({GEOMETRY_SQL}) g)""",
)
def catalog_unmatched(spark, sf):
    return C.unmatched_products(*levels(spark, sf), "event_id").select("event_id", "product_id")


NAMES_SQL = f"""SELECT product_id, regexp_extract(f, '([^/]+)$', 1) AS name FROM (
    SELECT product_id, unnest([rfl_hdr, rfl_img, loc_hdr, loc_img, obs_hdr, obs_img]) AS f FROM ({PAIRS_SQL}) p) e"""
PRESENT = "substr(md5(name), 1, 1) <> '0'"


def listing(spark, sf):
    """Files that have arrived: those whose name hash does not start with 0."""
    names = C._file_rows(pairs(spark, sf)).select("name").distinct()
    return names.where(F.substring(F.md5(F.col("name").cast("binary")), 1, 1) != "0")


@query(
    "catalog_on_disk",
    "J2",
    f"""SELECT product_id FROM (SELECT DISTINCT product_id, name FROM ({NAMES_SQL}) n WHERE {PRESENT}) d GROUP BY product_id HAVING count(*) = 6""",
)
def catalog_on_disk(spark, sf):
    return C.pairs_on_disk(pairs(spark, sf), listing(spark, sf))


@query("catalog_todo", "J3 U2", f"SELECT DISTINCT product_id, name FROM ({NAMES_SQL}) n WHERE NOT ({PRESENT})")
def catalog_todo(spark, sf):
    return C.files_to_fetch(pairs(spark, sf), listing(spark, sf)).select("product_id", "name")


@query(
    "catalog_reload",
    "S12 K5",
    f"SELECT timestamp, CAST(count(*) AS BIGINT) AS n, min(rfl_img) AS first_img FROM ({PAIRS_SQL}) p GROUP BY timestamp",
)
def catalog_reload(spark, sf):
    """Catalogue written as JSON and read back with its schema."""
    p = pairs(spark, sf)
    path = scratch(spark, "catalog")
    IO.write_catalog(p, path)
    back = IO.read_catalog(spark, path, p.schema)
    return back.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"), F.min("rfl_img").alias("first_img"))


def json_pages(spark, sf, field):
    """API pages of up to three products each; a page of one holds an object, not a list."""
    p = fixture(spark, sf, "products")
    item = field(p)
    size = F.when(F.floor(F.col("event_id") / 12) % 2 == 0, 3).otherwise(1)
    pages = p.withColumn("page", F.floor(F.col("event_id") / 12) * 12 + F.floor((F.col("event_id") % 12) / size))
    one = pages.groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.when(F.size("items") == 1, F.col("items")[0]).otherwise(
        F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    )
    return one.select(
        "page", F.concat(F.lit('{"ODEResults":{"Count":"9","Products":{"Product":'), body, F.lit("}}}")).alias("payload")
    )


@query(
    "json_products",
    "S10",
    """SELECT concat('P', CAST(event_id AS VARCHAR)) AS product_name, external_url, '' AS description, concat(day, 'T00:00:00') AS start_time,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(day, 'T12:00:00') END AS stop_time FROM products""",
)
def json_products(spark, sf):
    def item(p):
        return F.to_json(
            F.struct(
                F.concat(F.lit("P"), F.col("event_id")).alias("Product_name"),
                F.col("external_url").alias("External_url"),
                F.concat("day", F.lit("T00:00:00")).alias("UTC_start_time"),
                F.when(F.col("event_id") % 5 != 0, F.concat("day", F.lit("T12:00:00"))).alias("UTC_stop_time"),
            )
        )

    out = C.products_from_json(json_pages(spark, sf, item))
    return out.select("product_name", "external_url", "description", "start_time", "stop_time")


@query(
    "json_locations",
    "S11",
    """SELECT external_url, CASE WHEN event_id % 4 = 0 THEN 0 ELSE center_lat END AS center_lat, center_lon FROM products""",
)
def json_locations(spark, sf):
    def item(p):
        return F.to_json(
            F.struct(
                F.col("external_url").alias("External_url"),
                F.when(F.col("event_id") % 4 != 0, F.col("center_lat")).alias("Center_latitude"),
                F.col("center_lon").cast("string").alias("Center_longitude"),
            )
        )

    return C.locations_from_json(json_pages(spark, sf, item)).drop("page")


@query(
    "catalog_summary",
    "A27",
    """SELECT CAST(count(*) AS BIGINT) AS n_products, min(day) FILTER (WHERE event_id % 3 <> 0) AS first_start, max(day) FILTER (WHERE event_id % 5 <> 0) AS last_stop FROM products""",
)
def catalog_summary(spark, sf):
    p = fixture(spark, sf, "products")
    t = F.concat("day", F.lit("T00:00:00"))
    return C.catalog_summary(
        p.select(
            F.when(F.col("event_id") % 3 == 0, "").otherwise(t).alias("start_time"),
            F.when(F.col("event_id") % 5 == 0, "").otherwise(t).alias("stop_time"),
        )
    )


@query(
    "status_tally",
    "A28",
    """SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n, round(count(*) * 117e-3, 6) AS reflectance_gb, round(count(*) * 515e-3, 6) AS geometry_gb,
    round(count(*) * 440 / 1024e0, 6) AS estimated_gb FROM products GROUP BY event_type""",
)
def status_tally(spark, sf):
    out = C.status_tally(fixture(spark, sf, "products").withColumnRenamed("event_type", "status"))
    return rounded(out, "reflectance_gb", "geometry_gb", "estimated_gb")


STRIP_ID = f"concat('M3G', {TS})"


@query(
    "strip_file_pairs",
    "S19",
    f"""WITH r AS (SELECT DISTINCT {TS} AS ts, CAST(SUBSTR({TS}, 15, 1) AS INT) % 4 AS k FROM products WHERE level = 'L2' AND external_url <> '')
    SELECT concat('M3G', ts) AS product_id, concat('/l2/M3G', ts, '_rfl.img') AS rfl_img, concat('/l2/M3G', ts, '_rfl.hdr') AS rfl_hdr,
      concat(CASE k WHEN 0 THEN '/l1b/M3G' ELSE '/l1b/C_' END, ts, CASE k WHEN 0 THEN '' ELSE 'x' END, '_loc.img') AS loc_img,
      concat('/l1b/M3G', ts, '_obs.img') AS obs_img FROM r WHERE k < 2""",
)
def strip_file_pairs(spark, sf):
    """Geometry names equal the id (k=0), only contain its time stamp (k=1), or are absent."""
    ts = F.regexp_extract("external_url", r"(\d{8}T\d{6})", 1)
    ids = levels(spark, sf)[0].where(F.col("external_url") != "").select(ts.alias("ts")).distinct()
    ids = ids.withColumn("k", F.substring("ts", 15, 1).cast("int") % 4)
    loc = F.when(F.col("k") == 0, F.concat(F.lit("/l1b/M3G"), "ts", F.lit("_loc.img"))).when(
        F.col("k") == 1, F.concat(F.lit("/l1b/C_"), "ts", F.lit("x_loc.img"))
    )
    paths = F.array(
        F.concat(F.lit("/l2/M3G"), "ts", F.lit("_rfl.img")),
        F.concat(F.lit("/l2/M3G"), "ts", F.lit("_rfl.hdr")),
        loc,
        F.concat(F.lit("/l1b/M3G"), "ts", F.lit("_obs.img")),
    )
    files = ids.select(F.explode(F.array_compact(paths)).alias("path")).withColumn("length", F.lit(1))
    return C.pair_strip_files(files)


@query(
    "largest_file",
    "O5",
    """SELECT event_type, max(event_id * 7919 % 10007) AS length, min(path) AS path FROM (
      SELECT *, concat('/z/', CAST(event_id AS VARCHAR), '.csv') AS path, max(event_id * 7919 % 10007) OVER (PARTITION BY event_type) AS top FROM products) p
    WHERE event_id * 7919 % 10007 = top GROUP BY event_type""",
)
def largest_file(spark, sf):
    files = fixture(spark, sf, "products").select(
        "event_type",
        F.concat(F.lit("/z/"), F.col("event_id"), F.lit(".csv")).alias("path"),
        (F.col("event_id") * 7919 % 10007).alias("length"),
    )
    return C.largest_file(files, ".csv", ["event_type"])


# ---- text inputs ---------------------------------------------------------------------------


@query(
    "label_parse",
    "S2",
    """SELECT s_suppkey AS part, CAST(s_nationkey + 10 AS INT) AS lines, s_name AS product, round(s_acctbal, 2) AS offset_value FROM supplier""",
)
def label_parse(spark, sf):
    from swathgrid.functions.text import parse_label

    s = table(spark, sf, "supplier")
    text = F.concat(
        F.lit("PDS_VERSION_ID = PDS3\nLINES = 1\nPRODUCT_ID = \""), "s_name", F.lit("\"\r\n/* note */\nOFFSET  = "),
        F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit("\nLINES = "),
        (F.col("s_nationkey") + 10).cast("string"), F.lit("\nEND\n"),
    )
    m = s.select("s_suppkey", parse_label(text).alias("m"))
    return m.select(
        F.col("s_suppkey").alias("part"),
        F.col("m")["LINES"].cast("int").alias("lines"),
        F.col("m")["PRODUCT_ID"].alias("product"),
        F.round(F.col("m")["OFFSET"].cast("double"), 2).alias("offset_value"),
    )


@query(
    "header_parse",
    "S4",
    """SELECT s_suppkey AS part, CAST(s_nationkey + 1 AS INT) AS lines, 5 AS bands, 4 AS data_type, 0 AS byte_order,
    concat('b', CAST(s_nationkey AS VARCHAR)) AS second_band, CAST(3 AS BIGINT) AS n_names FROM supplier""",
)
def header_parse(spark, sf):
    from swathgrid.functions.text import header_int, header_list, parse_header

    s = table(spark, sf, "supplier")
    text = F.concat(
        F.lit("ENVI\n; comment = 1\nLines = "), (F.col("s_nationkey") + 1).cast("string"),
        F.lit("\nbands=5\ndata type = 4\nband names = {a, b"), F.col("s_nationkey").cast("string"),
        F.lit(",\n   c}\n"),
    )
    h = F.col("h")
    return s.select("s_suppkey", parse_header(text).alias("h")).select(
        F.col("s_suppkey").alias("part"),
        header_int(h, "lines").alias("lines"),
        header_int(h, "bands").alias("bands"),
        header_int(h, "data_type", 4).alias("data_type"),
        header_int(h, "byte_order", 0).alias("byte_order"),
        header_list(h["band_names"])[1].alias("second_band"),
        F.size(header_list(h["band_names"])).cast("bigint").alias("n_names"),
    )


@query(
    "crater_scan",
    "S9 F6",
    """SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(diam_km, 4) AS diam_km FROM craters WHERE diam_km >= 10 AND crater_id % 13 <> 0""",
)
def crater_scan(spark, sf):
    """A CSV whose columns are found by name; every 13th row has a broken number."""
    c = fixture(spark, sf, "craters")
    path = scratch(spark, "craters")
    lat = F.when(F.col("crater_id") % 13 == 0, "n/a").otherwise(F.col("lat").cast("string"))
    c.select(
        "crater_id", lat.alias("LAT_CIRC_IMG"), F.col("lon").alias("LON_CIRC_IMG"), F.col("diam_km").alias("DIAM_CIRC_IMG")
    ).write.option("header", True).csv(path)
    return rounded(rounded(IO.read_craters(spark, path), "lat", "lon"), "diam_km", digits=4)


def abundance_lines(spark, sf):
    b = fixture(spark, sf, "bins")
    fields = [
        F.col("bin_id"), F.col("lat") - 1, F.col("lat") + 1, F.col("lon") - 2, F.col("lon") + 2,
        *[F.lit(0.5)] * 6, F.col("tio2"), F.col("feo"), F.lit(1), F.lit("2e-3"),
    ]
    good = F.concat(F.lit("  "), F.array_join(F.array(*[f.cast("string") for f in fields]), "   "))
    text = F.when(F.col("bin_id") % 11 == 3, F.lit("bad line 1 2 3")).when(
        F.col("bin_id") % 11 == 5, F.concat(good, F.lit(" ")).substr(1, 40)
    ).when(F.col("bin_id") % 11 == 7, F.concat(F.lit("x"), good)).otherwise(good)
    path = scratch(spark, "abundance")
    b.select(text.alias("value")).write.text(path)
    return spark.read.text(path)


USED_BINS = "SELECT * FROM bins WHERE bin_id % 11 NOT IN (3, 5, 7)"


@query(
    "abundance_scan",
    "S8",
    f"SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, round(tio2, 8) AS lpgrs_tio2, round(feo, 8) AS lpgrs_feo FROM ({USED_BINS}) b",
)
def abundance_scan(spark, sf):
    out = IO.parse_abundances(abundance_lines(spark, sf))
    return rounded(rounded(out, "lat", "lon"), "lpgrs_tio2", "lpgrs_feo", digits=8)


def _abundance_sql(value):
    sql = gridded_bins_sql(value)
    return sql.replace("FROM bins WHERE", f"FROM ({USED_BINS}) bb WHERE")


@query(
    "abundance_maps",
    "C11 S8 F10 J11",
    f"""SELECT 'lpgrs_feo' AS channel, * FROM ({_abundance_sql('feo')}) f UNION ALL SELECT 'lpgrs_tio2' AS channel, * FROM ({_abundance_sql('tio2')}) t""",
)
def abundance_maps(spark, sf):
    """Both element maps from the whitespace table."""
    bins = IO.parse_abundances(abundance_lines(spark, sf))
    # Text round trip: bring centres back to the lattice they came from.
    bins = bins.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))
    out = None
    for name in ("lpgrs_feo", "lpgrs_tio2"):
        one = R.grid_scattered(bins.where(F.col(name) > -0.01), 180, 90, name).withColumn("channel", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return off_tie(out, "value")


# ---- logs ----------------------------------------------------------------------------------


@query(
    "metric_means",
    "A25",
    "SELECT metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_batches FROM metric_log GROUP BY metric",
)
def metric_means_query(spark, sf):
    return rounded(metric_means(fixture(spark, sf, "metric_log")), "value")


@query(
    "best_epoch",
    "A26",
    """SELECT 'max' AS goal, min(epoch) AS epoch, max(value) AS value FROM metric_log WHERE metric = 'view' AND value = (SELECT max(value) FROM metric_log WHERE metric = 'view')
    UNION ALL SELECT 'min', min(epoch), min(value) FROM metric_log WHERE metric = 'view' AND value = (SELECT min(value) FROM metric_log WHERE metric = 'view')""",
)
def best_epoch_query(spark, sf):
    log = fixture(spark, sf, "metric_log")
    top = best_epoch(log, "view", True).withColumn("goal", F.lit("max"))
    return top.unionByName(best_epoch(log, "view", False).withColumn("goal", F.lit("min")))
