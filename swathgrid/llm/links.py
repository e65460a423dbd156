"""From index keys to linked classes, for set similarity joins of any index: compare, confirm on full sets, connect.

Every key compares its members with the member that meets most others; then, as long as its members lie in
several components, those outside its largest component with all members of other components. So all pairs under
a key have been compared or lie in one component already, and a group of near copies costs its pairs
only where it falls apart. Pairs are dropped where sizes and parity sketches rule out a link, inside the join that makes
them, and confirmed on full sets otherwise. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import Drafts, slices
from swathgrid.llm.graph import components
from swathgrid.llm.shingles import SKETCH, U, Shingles
from swathgrid.sources.workspace import written

CHUNK_BYTES = 4 << 20
NO_ID = -(2**63)


def hashed(base: DataFrame) -> DataFrame:
    """`base` (doc_id, text) with `h`, a hash of the text."""
    return base.select("doc_id", "text", F.xxhash64("text").alias("h"))


def one_text() -> Column:
    """Of rows (doc_id, h) with one set, the document that stands for them."""
    return F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h")).alias("at")


def one_key_a_group(keys: DataFrame, drafts: Drafts) -> DataFrame:
    """Of rows (key, node) those of keys with two nodes or more, with `g`, their number; one key for each set of nodes."""
    groups = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("g"),
        F.bit_xor(F.xxhash64("node")).alias("x1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    )
    groups = groups.filter("g > 1").groupBy("g", "x1", "x2").agg(F.min("key").alias("key"))
    return drafts.written(keys.join(drafts.written(groups.select("key", "g"), "link-groups"), "key"), "link-members")


def _may_link(num: int, den: int) -> Column:
    """Whether sizes and parity sketches of a pair allow a link; sketches differ in no more bits than sets do in elements."""
    differ = reduce(Column.__add__, (F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("p_bits")[i])) for i in range(SKETCH)))
    both = F.col("n") + F.col("p_n")
    return (F.least("n", "p_n") * (num + den) >= both * num) & (differ.cast("long") * (num + den) <= both * (den - num))


def _sets_of(base: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, s (shingle hashes) of the wanted nodes, made again from one text of each.

    The wanted texts grow with the input, so they are never shipped to all tasks: the join is a shuffle at every size, and the
    only one, as `at` names one text for each node. Repeated rows come out of the sorted join one after
    the other; should a split of a large partition part them, a node comes twice, which makes equal links.
    """
    texts = hashed(base).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h", "text")
    own = texts.join(wanted.select("at.id", "at.h", "node", "print").hint("merge"), ["id", "h"]).select("node", "print", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, last = Shingles(n), None
        for batch in slices(batches, "text", CHUNK_BYTES):
            nodes = batch.column("node").to_pylist()
            fresh = [i for i, node in enumerate(nodes) if node != (nodes[i - 1] if i else last)]
            last = nodes[-1] if nodes else last
            batch = batch.take(pa.array(fresh, pa.int64()))
            sets = make.sets(batch.column("text").to_pylist())
            # Another text of the same id and hash has another print.
            own = [xxhash.xxh3_128_digest(s.tobytes()) == p for s, p in zip(sets, batch.column("print").to_pylist(), strict=True)]
            batch, sets = batch.filter(pa.array(own, pa.bool_())), [s for s, good in zip(sets, own, strict=True) if good]
            flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["node", "s"])

    return own.mapInArrow(run, "node long, s array<long>")


def _linked(pairs: DataFrame, base: DataFrame, nodes: DataFrame, n: int, num: int, den: int, drafts: Drafts) -> DataFrame:
    """Of pairs (a, b) those whose full sets link. Sets are made only for nodes of some pair, and go when the links are written."""
    used = drafts.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "link-used")
    wanted = Drafts()
    sets = wanted.written(_sets_of(base, nodes.select("node", "print", "at").join(used, "node"), n), "link-sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    union = F.size("s_a") + F.size("s_b") - shared
    links = drafts.written(both.filter(shared * den >= union * num).select("a", "b"), "links")
    wanted.drop()
    return links


def _as_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _first_round(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members of a key with the one of them that meets most others."""
    meets = members.groupBy("node").agg(F.sum("g").alias("meets"))
    members = members.join(meets, "node")
    order = F.struct("meets", F.xxhash64("node").alias("h"), F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("bits").alias("p_bits"))
    lead = members.groupBy("key").agg(F.max(order).alias("lead")).select("key", "lead.p", "lead.p_n", "lead.p_bits")
    return _as_pairs(members.join(lead, "key").filter((F.col("node") != F.col("p")) & _may_link(num, den)))


def _last_round(members: DataFrame, labels: DataFrame, num: int, den: int, drafts: Drafts) -> DataFrame:
    """Members outside a key's largest component with its members of other components."""
    own = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
    main = drafts.written(main.filter("comps > 1").select("key", "main"), "link-open")
    own = drafts.written(own.join(main, "key"), "link-open-members")
    names = [F.col(c).alias(f"p_{c}") for c in ("comp", "n", "bits")]
    outside = own.filter("comp != main").select(F.col("key").alias("p_key"), *names, F.col("node").alias("p"))
    # Two members outside the largest component meet once only.
    once = (F.col("comp") == F.col("main")) | (F.col("node") < F.col("p"))
    meet = (F.col("key") == F.col("p_key")) & (F.col("comp") != F.col("p_comp")) & once & _may_link(num, den)
    return _as_pairs(own.join(outside, meet))


def linked_nodes(base: DataFrame, nodes: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, comp (smallest node reachable) of nodes with a link.

    `base`: doc_id, text. `nodes`: node, print, at (see `one_text`), n (set size), bits (parity sketch).
    `members`: key, node, g, as of `one_key_a_group`. Of the tables written here only the result is left.
    """
    drafts = Drafts()
    facts = members.select("node").distinct().join(nodes.select("node", "n", "bits"), "node")
    members = drafts.written(members.join(drafts.written(facts, "link-facts"), "node"), "link-members")
    pairs = drafts.written(_first_round(members, num, den), "link-pairs")
    links = _linked(pairs, base, nodes, n, num, den, drafts)
    labels = components(links)
    more = drafts.written(_last_round(members, labels, num, den, drafts).join(pairs, ["a", "b"], "left_anti"), "link-pairs")
    if not more.isEmpty():
        labels = components(links.unionByName(_linked(more, base, nodes, n, num, den, drafts)))
    drafts.drop()
    return labels


def classes(facts: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`facts` (print, doc_id, n) as doc_id, n_shingles, component_id; a row without shingles is its own class."""
    comps = nodes.select("print", "node", "least").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    comps = written(comps.join(least, "comp").select("print", "component_id"), "link-classes")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return facts.join(comps, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), own)
