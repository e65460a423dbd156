"""Product listings: payload parsing, pairing, file checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.constants import GB_PER_GEOMETRY, GB_PER_REFLECTANCE, MB_PER_STRIP
from swathgrid.functions.text import (
    file_name,
    geometry_files,
    product_dir,
    product_id,
    product_timestamp,
    reflectance_files,
)

FILE_COLUMNS = ["rfl_hdr", "rfl_img", "loc_hdr", "loc_img", "obs_hdr", "obs_img"]
PRODUCT_FIELDS = {
    "product_name": "Product_name",
    "description": "Description",
    "external_url": "External_url",
    "label_url": "LabelURL",
    "files_url": "FilesURL",
    "product_url": "ProductURL",
    "start_time": "UTC_start_time",
    "stop_time": "UTC_stop_time",
    "observation_time": "Observation_time",
    "resolution": "Map_resolution_text",
}


def _payload_items(pages: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """Product objects of each JSON page; a lone object counts as a list of one."""
    raw = F.get_json_object(payload, "$.ODEResults.Products.Product")
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    schema = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    keep = [c for c in pages.columns if c != payload]
    return pages.select(*keep, F.explode(F.from_json(listed, schema)).alias("p")).select(*keep, "p.*")


def products_from_json(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """All ten descriptive fields, missing ones as empty strings."""
    items = _payload_items(pages, payload, list(PRODUCT_FIELDS.values()))
    keep = [c for c in pages.columns if c != payload]
    return items.select(
        *keep, *[F.coalesce(F.col(f), F.lit("")).alias(name) for name, f in PRODUCT_FIELDS.items()]
    )


def locations_from_json(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """External address and centre of each product; missing centres are 0."""
    items = _payload_items(pages, payload, ["External_url", "Center_latitude", "Center_longitude"])
    keep = [c for c in pages.columns if c != payload]

    def number(name):
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    return items.select(
        *keep,
        F.coalesce(F.col("External_url"), F.lit("")).alias("external_url"),
        number("Center_latitude").alias("center_lat"),
        number("Center_longitude").alias("center_lon"),
    )


def parse_products(df: DataFrame, kind: str) -> DataFrame:
    """Product id, directory, timestamp and file addresses of rows with an address."""
    files = reflectance_files if kind == "reflectance" else geometry_files
    url = F.col("external_url")
    pid = product_id(url)
    return df.where(url != "").select(
        *df.columns,
        pid.alias("product_id"),
        product_dir(url).alias("base_dir"),
        product_timestamp(pid).alias("timestamp"),
        *[c.alias(n) for n, c in files(url).items()],
    )


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key by order number. The aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("_r"))
        .select(key, "_r.*")
    )


def _parsed_pair(reflectance: DataFrame, geometry: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    left = parse_products(reflectance, "reflectance")
    right = parse_products(geometry, "geometry").where(F.col("timestamp") != "")
    right = latest(
        right.select("timestamp", order, "loc_hdr", "loc_img", "obs_hdr", "obs_img"), "timestamp", order
    )
    return left, right.drop(order)


def pair_products(reflectance: DataFrame, geometry: DataFrame, order: str) -> DataFrame:
    """Reflectance products with the geometry product of the same timestamp (last one wins)."""
    left, right = _parsed_pair(reflectance, geometry, order)
    return left.where(F.col("timestamp") != "").join(right, "timestamp").select(
        "timestamp", "product_id", "center_lat", "center_lon", *FILE_COLUMNS
    )


def unmatched_products(reflectance: DataFrame, geometry: DataFrame, order: str) -> DataFrame:
    left, right = _parsed_pair(reflectance, geometry, order)
    return left.join(right, "timestamp", "left_anti")


def _file_rows(pairs: DataFrame) -> DataFrame:
    names = F.array(*[file_name(F.col(c)) for c in FILE_COLUMNS])
    return pairs.select("product_id", F.explode(names).alias("name"))


def pairs_on_disk(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Products whose six files all exist in the listing (name)."""
    found = _file_rows(pairs).join(listing.select("name"), "name", "left_semi")
    whole = found.distinct().groupBy("product_id").agg(F.count(F.lit(1)).alias("n_files"))
    return whole.where(F.col("n_files") == len(FILE_COLUMNS)).select("product_id")


def files_to_fetch(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    return _file_rows(pairs).distinct().join(listing.select("name"), "name", "left_anti")


def _stem(suffix: str) -> Column:
    name = file_name(F.col("path"))
    return F.substring(name, F.lit(1), F.length(name) - len(suffix))


def pair_strip_files(listing: DataFrame) -> DataFrame:
    """Pair files of a listing (path, length) by product: same id, else the id's last 15 characters.

    The fallback asks whether a geometry name contains the 15 characters anywhere; names are cut
    into all their 15-character pieces, which turns the question into an equi-join.
    """
    rfl = listing.where(F.col("path").endswith("_rfl.img")).select(
        _stem("_rfl.img").alias("product_id"), F.col("path").alias("rfl_img")
    )
    headers = listing.where(F.col("path").endswith("_rfl.hdr")).select(
        _stem("_rfl.hdr").alias("product_id"), F.col("path").alias("rfl_hdr")
    )
    out = rfl.join(headers, "product_id")
    for kind in ("loc", "obs"):
        geo = listing.where(F.col("path").endswith(f"_{kind}.img")).select(
            _stem(f"_{kind}.img").alias("stem"), "path"
        )
        exact = geo.groupBy(F.col("stem").alias("product_id")).agg(F.min("path").alias("exact"))
        pieces = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("stem") - 14, F.lit(1))),
            lambda i: F.substring(F.col("stem"), i, F.lit(15)),
        )
        near = (
            geo.select("path", F.explode(pieces).alias("tail"))
            .groupBy("tail")
            .agg(F.min("path").alias("near"))
        )
        out = (
            out.withColumn("tail", F.right(F.col("product_id"), F.lit(15)))
            .join(exact, "product_id", "left")
            .join(near, "tail", "left")
            .withColumn(f"{kind}_img", F.coalesce("exact", "near"))
            .drop("tail", "exact", "near")
            .where(F.col(f"{kind}_img").isNotNull())
        )
    return out.select("product_id", "rfl_img", "rfl_hdr", "loc_img", "obs_img")


def catalog_summary(products: DataFrame) -> DataFrame:
    """Count, first start and last stop date; empty times are left out."""

    def known(c):
        return F.when(F.col(c) != "", F.substring(c, 1, 10))

    return products.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.min(known("start_time")).alias("first_start"),
        F.max(known("stop_time")).alias("last_stop"),
    )


def status_tally(strips: DataFrame) -> DataFrame:
    """Strips per status with the download volume they stand for."""
    n = F.count(F.lit(1))
    return strips.groupBy("status").agg(
        n.alias("n"),
        (n * GB_PER_REFLECTANCE).alias("reflectance_gb"),
        (n * GB_PER_GEOMETRY).alias("geometry_gb"),
        (n * MB_PER_STRIP / 1024).alias("estimated_gb"),
    )


def largest_file(listing: DataFrame, suffix: str, keys: list[str] = ()) -> DataFrame:
    """Largest file with a suffix (ties: the smallest path), per key."""
    sized = listing.where(F.col("path").endswith(suffix)).groupBy(*keys, "length").agg(
        F.min("path").alias("path")
    )
    return sized.groupBy(*keys).agg(
        F.max_by("path", "length").alias("path"), F.max("length").alias("length")
    )
