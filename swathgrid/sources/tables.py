"""Text, CSV, JSON and Parquet inputs, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.constants import ABUNDANCE_COLUMNS, ABUNDANCE_FIELDS, CRATER_COLUMNS, MIN_CRATER_KM
from swathgrid.functions.text import parse_header, parse_label


def resolve(columns: list[str], wanted: dict[str, list[str]]) -> dict[str, str]:
    """First candidate name present, per wanted field."""
    found = {k: next((c for c in names if c in columns), None) for k, names in wanted.items()}
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise ValueError(f"no column for {missing} among {columns}")
    return found


def number(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col).try_cast("double")


def read_craters(spark: SparkSession, path: str, min_km: float = MIN_CRATER_KM) -> DataFrame:
    """Crater CSV with any of the usual column names; rows with bad numbers are skipped."""
    raw = spark.read.option("header", True).csv(path)
    names = resolve(raw.columns, CRATER_COLUMNS)
    out = raw.select(*[number(F.col(f"`{c}`")).alias(k) for k, c in names.items()])
    return out.where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("diam_km") >= min_km)
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), parse_label(F.col("value")).alias("label"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), parse_header(F.col("value")).alias("header"))


def parse_abundances(lines: DataFrame, text: str = "value") -> DataFrame:
    """Whitespace rows with at least 15 numeric fields to (lat, lon, one column per element)."""
    fields = F.split(F.trim(text), r"\s+")
    nums = F.transform(F.slice(fields, 1, ABUNDANCE_FIELDS), lambda s: s.try_cast("double"))
    ok = lines.where(F.size(fields) >= ABUNDANCE_FIELDS).withColumn("_n", nums)
    ok = ok.where(F.forall("_n", lambda x: x.isNotNull()))
    n = F.col("_n")
    return ok.select(
        ((n[1] + n[2]) / 2).alias("lat"),
        ((n[3] + n[4]) / 2).alias("lon"),
        *[n[i].alias(name) for name, i in ABUNDANCE_COLUMNS.items()],
    )


def pick_layer(names: list[str]) -> str:
    """Polygon layer choice: 'geounits', then a unit layer that is not a contact layer, then first."""
    low = [(n.lower(), n) for n in sorted(names)]
    tests = (lambda s: "geounits" in s or "geo_units" in s, lambda s: "unit" in s and "contact" not in s, lambda s: True)
    for test in tests:
        hits = [n for s, n in low if test(s)]
        if hits:
            return hits[0]
    raise ValueError("no layer")


# Column names tried, in order, for the unit symbol of a polygon layer.
UNIT_COLUMNS = ["GEO_UNIT", "UNIT", "Unit", "unit", "UnitSymbol", "UNITSYMBOL", "MapUnit", "FIRST_Unit"]


def unit_column(df: DataFrame) -> str:
    """Unit column by name, else the first text column that is not geometry."""
    for c in UNIT_COLUMNS:
        if c in df.columns:
            return c
    texts = [n for n, t in df.dtypes if t == "string" and n.lower() not in ("geometry", "wkt")]
    if not texts:
        raise ValueError(f"no unit column among {df.columns}")
    return texts[0]


# ---- sinks ---------------------------------------------------------------------------------


def write_tiles(tiles: DataFrame, path: str, mode: str = "error") -> None:
    """Dense tiles, one folder per channel, sorted by tile inside the files.

    Rows are placed by a range of (channel, tile_row), so a channel spreads over many files.
    """
    placed = tiles.repartitionByRange("channel", "tile_row", "tile_col")
    placed.sortWithinPartitions("channel", "tile_row", "tile_col").write.mode(mode).partitionBy(
        "channel"
    ).parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_once(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Write unless the target exists already."""
    df.write.mode("ignore").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in the data."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by
    ).parquet(path)


def write_observations(obs: DataFrame, path: str, mode: str = "append") -> None:
    """Usable pixels only, by observation date; a hot date still spreads over many files."""
    obs.withColumn("obs_date", F.to_date("obs_ts")).write.mode(mode).partitionBy("obs_date").parquet(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_catalog(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
