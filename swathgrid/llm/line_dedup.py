"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its token count and its first `depth` tokens; tokens that look like
fields (with digits, addresses) are `<*>` from the start. At a leaf, lines that are equal after
this masking are one constant template. The other lines of a leaf are generalised: a position
keeps the token that half of the leaf's documents have there, and is variable otherwise. A line belongs to
that template if `similar` of its constant tokens agree. What is left of a leaf can hold any number of further
templates, of unlike sizes: for `min_docs` documents and each doubling of that, the tokens that so many of the
leaf's documents have at their position are constant, and lines with the same constants are one template. A
family of n documents so shows at the threshold between n / 2 and n, where fields vary and its own words do not.
Its lines must agree in all constants. Templates found in `min_docs` documents or
more are recurring; their lines go from all documents but the one with the smallest id. How many documents
a constant template needs depends on its length: lines of `long_tokens` tokens are passages, which `long_docs`
documents do not share by chance; lines under `min_tokens` need `short_docs`, and are never generalised.

Only hashes of lines are shuffled to find what recurs. Every count combines before its shuffle, so a line that
a third of all documents share costs a row per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.sources.workspace import written

FIELD = re.compile(rb"[0-9@]|://")
LAST = 2**63 - 1  # a null id comes after all others


def tokens(line: str) -> list[bytes]:
    return [b"<*>" if FIELD.search(t) else t for t in line.encode("utf-8", "surrogatepass").split()]


def _hash(parts: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b"%d " % len(parts) + b" ".join(parts)) - 2**63


def leaf(parts: list[bytes], depth: int) -> int:
    return xxhash.xxh64_intdigest(b"%d|" % len(parts) + b" ".join(parts[:depth])) - 2**63


def _keyed(docs: DataFrame) -> DataFrame:
    """id and h name a row: rows equal in both have equal lines."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _lines(rows: DataFrame, depth: int, min_tokens: int, needed: Callable[[int], int]) -> DataFrame:
    """Hashes of every line that has tokens, and the documents it needs to recur; short lines have no leaf."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for i, h, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for n, line in enumerate(text.split("\n")):
                        parts = tokens(line)
                        if parts:
                            own = leaf(parts, depth) if len(parts) >= min_tokens else None
                            out.append((i, h, n, own, _hash(parts), needed(len(parts))))
                columns = list(zip(*out, strict=True)) or [()] * 6
                names = ["id", "h", "line", "leaf", "full", "needed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.mapInArrow(run, "id long, h long, line long, leaf long, full long, needed long")


def _recurring(lines: DataFrame, by: str, needed: Column) -> DataFrame:
    """by, docs, first (smallest id) of what occurs in `needed` documents."""
    docs = lines.select(by, "id", needed.alias("needed")).distinct().groupBy(by)
    docs = docs.agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"), F.min("needed").alias("needed"))
    return docs.filter(F.col("docs") >= F.col("needed")).drop("needed")


def _token_hashes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h, line, leaf, t (token hashes) of the wanted lines."""
    by_row = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("line", "leaf")).alias("lines"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, h, text, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = text.split("\n")
                for x in lines:
                    out.append((i, h, x["line"], x["leaf"], [xxhash.xxh64_intdigest(t) - 2**63 for t in tokens(split[x["line"]])]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int64()))],
                names=["id", "h", "line", "leaf", "t"],
            )

    same = rows.join(by_row, ["id", "h"]).select("id", "h", "text", "lines").dropDuplicates(["id", "h"])
    return same.mapInArrow(run, "id long, h long, line long, leaf long, t array<long>")


def recurring_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_tokens: int = 3,
    depth: int = 3,
    similar: float = 0.8,
    constants: int = 4,
    short_docs: int = 50,
    long_tokens: int = 50,
    long_docs: int | None = None,
) -> DataFrame:
    """Lines to drop: id, h (a row's key), line (number from 0). Without `long_docs`, long lines need `min_docs` too."""
    rows = _keyed(docs)

    def needed(tokens: int) -> int:
        if tokens < min_tokens:
            return max(short_docs, min_docs)
        return long_docs if long_docs is not None and tokens >= long_tokens else min_docs

    lines = written(_lines(rows, depth, min_tokens, needed), "line-hashes")
    constant = written(_recurring(lines, "full", F.col("needed")), "line-constant")
    drop = lines.join(constant, "full").filter(F.col("id") != F.col("first")).select("id", "h", "line")
    rest = lines.filter("leaf IS NOT NULL").join(constant.select("full"), "full", "left_anti")
    leaves = written(_recurring(rest, "leaf", F.lit(min_docs)).select("leaf", "docs"), "line-leaves")
    varied = written(_token_hashes(rows, rest.join(leaves.select("leaf"), "leaf", "left_semi").select("id", "h", "line", "leaf")), "line-tokens")
    places = varied.select("leaf", "id", F.posexplode("t").alias("pos", "token")).distinct().groupBy("leaf", "pos", "token").count()
    usual = places.join(leaves, "leaf").filter(F.col("count") * 2 >= F.col("docs"))
    # Two tokens can have half of the documents each; the smaller hash stands for the position.
    usual = usual.groupBy("leaf", "pos").agg(F.max(F.struct("count", (-F.col("token").cast("decimal(20,0)")).alias("least"), "token")).alias("best"))
    template = usual.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "best.token"))).alias("template"))
    agree = F.size(F.filter("t", lambda t, i: F.col("template")[i] == t))
    matched = varied.join(template, "leaf").filter(
        (F.size("template") >= F.greatest(F.lit(constants), F.ceil(F.size("t") * 0.6)))
        & (agree >= F.ceil(F.size("template") * similar))
    )
    matched = written(matched.select("id", "h", "line", "leaf"), "line-matched")
    matched = written(matched.join(_recurring(matched, "leaf", F.lit(min_docs)), "leaf").select("id", "h", "line", "first"), "line-variable")
    others = varied.join(matched.select("id", "h", "line"), ["id", "h", "line"], "left_anti")
    further = _further_templates(written(others, "line-others"), min_docs, constants)
    variable = matched.unionByName(further).filter(F.col("id") != F.col("first"))
    return drop.unionByName(variable.select("id", "h", "line"))


def _further_templates(lines: DataFrame, min_docs: int, constants: int) -> DataFrame:
    """id, h, line, first of the lines that share their frequent tokens with lines of min_docs documents.

    Constants at a higher threshold are among those at a lower one, so templates nest, and the
    smallest id of the widest one keeps its line in all.
    """
    tokens = lines.select("id", "h", "line", "leaf", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token"))
    frequent = tokens.select("leaf", "pos", "token", "id").distinct().groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("docs"))
    frequent = frequent.filter(F.col("docs") >= min_docs)
    needed = F.greatest(F.lit(constants), F.ceil(F.col("n") * 0.6))
    known = (
        tokens.join(frequent, ["leaf", "pos", "token"])
        .groupBy("id", "h", "line", "leaf", "n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "docs"))).alias("known"))
        .filter(F.size("known") >= needed)
    )
    doublings = F.floor(F.log2(F.array_max(F.transform("known", lambda x: x["docs"])) / min_docs)).cast("int")
    at_least = F.transform(
        F.sequence(F.lit(0), doublings), lambda k: F.filter("known", lambda x: x["docs"] >= F.pow(F.lit(2), k) * min_docs)
    )
    keys = known.withColumn("own", F.explode(F.array_distinct(at_least))).filter(F.size("own") >= needed)
    keys = written(keys.select("id", "h", "line", F.xxhash64("leaf", "own").alias("key")), "line-further")
    return keys.join(_recurring(keys, "key", F.lit(min_docs)), "key").select("id", "h", "line", "first")


def drop_recurring_lines(docs: DataFrame, **settings) -> DataFrame:
    """The same rows and columns, `text` without the lines of recurring templates.

    The document with the smallest id keeps its lines, so nothing is lost from the corpus; no row
    goes, though a text can become empty. Null texts stay null, empty ones empty; a null id
    counts as the largest. Repeated rows are one document. Lines without tokens never recur.
    """
    gone = recurring_lines(docs, **settings).groupBy("id", "h").agg(F.collect_set("line").alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "__gone")
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col("__id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__h")
    )
    return docs.join(gone, key, "left").withColumn("text", _without(F.col("text"))).select(*docs.columns)


def _without(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i.cast("long")))
    return F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
