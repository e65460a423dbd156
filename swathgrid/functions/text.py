"""Labels, headers and product names as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathgrid.constants import ARCHIVE_PREFIXES

HEADER_INTS = ["samples", "lines", "bands", "data_type", "byte_order", "header_offset"]


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) structs in which the last entry of a key is kept."""
    keys = F.transform(entries, lambda e: e["key"])
    distinct = F.array_distinct(keys)
    backwards = F.reverse(entries)
    values = F.transform(
        distinct, lambda k: F.element_at(F.filter(backwards, lambda e: e["key"] == k), 1)["value"]
    )
    return F.map_from_arrays(distinct, values)


def _pairs(lines: Column, key) -> Column:
    entries = F.transform(
        lines,
        lambda line: F.struct(
            key(F.substring_index(line, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(line, "^[^=]*=", "")).alias("value"),
        ),
    )
    return entries


def parse_label(text: Column) -> Column:
    """``KEY = value`` lines to a map; quotes are stripped, the last key wins."""
    lines = F.filter(F.split(text, "\r?\n"), lambda s: s.contains("="))
    entries = _pairs(lines, F.trim)
    bare = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.regexp_replace(e["value"], '^"+|"+$', "").alias("value"),
        ),
    )
    return _last_wins(bare)


def parse_header(text: Column) -> Column:
    """Image header text to a map: folded lines joined, ``;`` lines skipped, keys normalised."""
    unfolded = F.regexp_replace(F.regexp_replace(text, "\r", ""), "\n\\s+", " ")
    lines = F.filter(
        F.transform(F.split(unfolded, "\n"), lambda s: F.trim(s)),
        lambda s: s.contains("=") & ~s.startswith(";"),
    )
    return _last_wins(_pairs(lines, lambda k: F.replace(F.lower(F.trim(k)), F.lit(" "), F.lit("_"))))


def header_int(header: Column, key: str, default: int | None = None) -> Column:
    value = F.expr("CAST(NULL AS INT)") if default is None else F.lit(default)
    return F.coalesce(header[key].cast("int"), value)


def header_list(value: Column) -> Column:
    """``{a, b, c}`` to an array of trimmed, non-empty items."""
    inner = F.regexp_replace(F.trim(value), "^\\{|\\}$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def product_id(url: Column) -> Column:
    """Name of the product: file name up to the version mark ``_V``."""
    return F.substring_index(file_name(url), "_V", 1)


def product_dir(url: Column) -> Column:
    """Directory of a product with legacy archive prefixes replaced by the current one."""
    base = F.substring(url, F.lit(1), F.greatest(F.length(url) - F.length(file_name(url)) - 1, F.lit(0)))
    for old, new in ARCHIVE_PREFIXES.items():
        base = F.replace(base, F.lit(old), F.lit(new))
    return base


def product_timestamp(pid: Column) -> Column:
    """``yyyyMMddTHHmmss`` inside a product name, or an empty string."""
    return F.regexp_extract(pid, r"(\d{8}T\d{6})", 1)


def reflectance_files(url: Column) -> dict[str, Column]:
    stem = F.concat(product_dir(url), F.lit("/"), product_id(url))
    return {f"rfl_{ext}": F.concat(stem, F.lit(f"_V01_RFL.{ext.upper()}")) for ext in ("hdr", "img")}


def geometry_files(url: Column) -> dict[str, Column]:
    stem = F.concat(product_dir(url), F.lit("/"), product_id(url))
    return {
        f"{kind}_{ext}": F.concat(stem, F.lit(f"_V03_{kind.upper()}.{ext.upper()}"))
        for kind in ("loc", "obs")
        for ext in ("hdr", "img")
    }
