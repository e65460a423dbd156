"""The given tables seen as observation data. The SQL text runs unchanged in any engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.grid import Grid

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES = {
    "obs": """
SELECT CAST(l_suppkey AS STRING) AS strip_id, l_linenumber - 1 AS line,
       CAST(l_partkey % 1800 AS DOUBLE) / 10e0 - 90e0 + 5e-2 AS lat,
       CAST(l_orderkey % 3600 AS DOUBLE) / 10e0 + 5e-2 AS lon,
       l_extendedprice / 100000e0 AS b1, l_quantity / 55e0 AS b2,
       l_quantity * 2e0 AS incidence, l_discount * 800e0 AS emission, l_tax * 1000e0 AS phase,
       l_shipdate AS obs_ts
FROM lineitem""",
    "dem": """
SELECT CAST(FLOOR(o_orderkey / 125e0) AS INT) AS row, CAST(o_orderkey % 125 AS INT) AS col,
       90e0 - (CAST(FLOOR(o_orderkey / 125e0) AS INT) % 120 + 5e-1) * 15e-1 AS lat,
       CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_totalprice / 100e0 - 2000e0 END AS lola,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 100e0 - 2000e0 + o_custkey % 50 END AS sldem
FROM orders""",
    "rasters": """
SELECT CAST(FLOOR(o_orderkey / 125e0) AS INT) AS row, CAST(o_orderkey % 125 AS INT) AS col,
       CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_totalprice / 100e0 - 2000e0 END AS elevation,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 50e0 END AS roughness,
       CASE WHEN o_custkey % 11 < 2 THEN NULL ELSE o_totalprice / 1000000e0 END AS m3_750,
       CASE WHEN o_custkey % 13 <> 5 THEN NULL ELSE o_custkey % 97 / 10e0 - 1e0 END AS minirf_s1,
       CASE WHEN o_custkey % 13 = 7 THEN 0e0 ELSE o_totalprice % 1000 / 5000e0 END AS lpgrs_tio2,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 40 / 100e0 END AS lpgrs_feo,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 40e0 + o_custkey % 30 END AS clementine_uvvis_750nm,
       o_custkey * 1e0 AS mystery
FROM orders""",
    "units": """
SELECT CAST(FLOOR(o_orderkey / 125e0) AS INT) AS row, CAST(o_orderkey % 125 AS INT) AS col,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Em' WHEN '2' THEN 'Im2' WHEN '3' THEN 'pNb' WHEN '4' THEN 'Cc' END AS unit
FROM orders""",
    "patches": """
SELECT c_custkey AS patch_id, CAST(FLOOR(c_custkey / 50e0) AS INT) AS tile_row, CAST(c_custkey % 50 AS INT) AS tile_col,
       90e0 - (CAST(FLOOR(c_custkey / 50e0) AS INT) % 30 + 5e-1) * 6e0 AS center_lat,
       -180e0 + (c_custkey % 50 + 5e-1) * 72e-1 AS center_lon,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 10000e0 END AS mare_fraction,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'pNt' WHEN 'MACHINERY' THEN 'Nc' WHEN 'BUILDING' THEN 'EIp'
                         WHEN 'AUTOMOBILE' THEN 'Em' ELSE 'lIx' END AS unit_name
FROM customer""",
    "craters": """
SELECT s_suppkey AS crater_id, (s_suppkey * 37) % 170 - 85e0 + 5e-1 AS lat, (s_suppkey * 53) % 360 - 180e0 + 25e-2 AS lon,
       abs(s_acctbal) / 20e0 AS diam_km
FROM supplier""",
    "diamonds": """
SELECT n_nationkey AS ordinal, n_name AS unit, -168e0 + 14e0 * n_nationkey + 3e-1 AS cx,
       (n_nationkey * 29) % 120 - 60e0 + 1e-1 AS cy, 10e0 + 3e0 * (n_nationkey % 5) AS a
FROM nation""",
    "products": """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'L2' ELSE 'L1B' END AS level,
       CASE WHEN event_id % 50 = 7 THEN '' ELSE concat(
           CASE WHEN event_id % 3 = 0 THEN 'http://pds-imaging.jpl.nasa.gov/data/D/' ELSE 'http://arch.example/data/D/' END,
           'M3G', replace(CAST(CAST(ts AS DATE) AS STRING), '-', ''), 'T', lpad(CAST(user_id AS STRING), 6, '0'),
           CASE WHEN event_type IN ('view', 'click') THEN '_V01_L2.LBL' ELSE '_V03_L1B.LBL' END) END AS external_url,
       CAST(user_id % 180 - 90 AS DOUBLE) AS center_lat, CAST(event_id % 360 - 180 AS DOUBLE) AS center_lon,
       CAST(CAST(ts AS DATE) AS STRING) AS day, value, event_type
FROM events""",
    "preds_cls": """
SELECT l.doc_id, l.quality AS target, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pred
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "preds_reg": "SELECT l_extendedprice AS target, l_quantity * 2100e0 AS pred, l_returnflag AS output FROM lineitem",
    "preds_ord": "SELECT vec_id, label % 5 AS target, CAST((label * 3 + vec_id) % 5 AS INT) AS pred FROM embeddings",
    "bins": """
SELECT CAST(FLOOR(c_custkey / 50e0) AS INT) % 30 * -6e0 + 87e0 AS lat,
       c_custkey % 50 * 72e-1 - 1764e-1 + CAST(FLOOR(c_custkey / 50e0) AS INT) % 3 * 1e0 AS lon,
       c_acctbal / 50000e0 AS feo, c_acctbal / 90000e0 AS tio2, c_custkey AS bin_id
FROM customer""",
    "metric_log": """
SELECT user_id AS epoch, event_type AS metric, value FROM events""",
}

GROUP_COUNT = 7
TOKENS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    found = _sources(sql)
    for t in found:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in found})


def with_fixtures(body: str) -> str:
    """Oracle text with the fixtures it names in front."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in used)
    return f"WITH {ctes}\nSELECT * FROM (\n{body.strip()}\n) AS result"


# ---- shapes --------------------------------------------------------------------------------

OBS_GRID = Grid(72, 36, 0.2, tile=4)
LATTICE = Grid(360, 180, 1.0, tile=10)
DEM_PIXEL_M = 1000.0


def dem_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """125 columns; the height follows from the number of orders (a footer count)."""
    n = table(spark, sf_dir, "orders").count()
    return Grid(125, -(-n // 125), 1 / 1.5, tile=5)


def dem(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return fixture(spark, sf_dir, "dem").select("row", "col", "lat", F.col(column).alias("value"))


LAYER_CHANNELS = [
    "elevation", "roughness", "m3_750", "minirf_s1", "lpgrs_tio2", "lpgrs_feo",
    "clementine_uvvis_750nm", "mystery",
]

LAYERS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS channel, row, col, {c} AS value FROM rasters" for c in LAYER_CHANNELS
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature tokens: seven groups of nine values, each as three tokens of three."""
    from swathgrid.constants import GROUP_NAMES

    e = table(spark, sf_dir, "embeddings")
    spots = F.array(
        *[
            F.struct(F.lit(g).alias("g"), F.lit(name).alias("group_name"), F.lit(t).alias("token"))
            for g, name in enumerate(GROUP_NAMES)
            for t in range(TOKENS)
        ]
    )
    e = e.withColumn("s", F.explode(spots))
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch_id"),
        "s.group_name",
        "s.token",
        ((F.col("vec_id") + F.col("s.g")) % 5 != 0).alias("available"),
        F.slice("embedding", F.col("s.g") * 9 + F.col("s.token") * 3 + 1, F.lit(3)).alias("vec"),
    )


def _groups_values() -> str:
    from swathgrid.constants import GROUP_NAMES

    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(GROUP_NAMES))


FIXTURES["groups"] = "SELECT * FROM (VALUES " + _groups_values() + ") AS v(g, group_name)"
