"""Deterministic pseudo-randomness that any SQL engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *parts: Column) -> Column:
    """md5 of ``seed:part:part...`` as 32 hex digits; ordering by it is a seeded shuffle."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.md5(text.cast("binary"))


def hash_int(seed, *parts: Column) -> Column:
    """The first 32 bits of the digest as a non-negative long."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint")
