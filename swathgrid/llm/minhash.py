"""Near-duplicate classes by MinHash with tensored banding.

A table that catches pairs at similarity s needs a key of several minhashes, and many tables are needed to miss none.
Two collections of `side` short keys, of `width` minhashes each, are drawn instead, and table (i, j) takes the i-th
key of the one with the j-th of the other: side^2 tables with keys of 2 * width minhashes cost 2 * side * width minhashes and not
2 * width * side^2. A pair of similarity s meets in some table with probability (1 - (1 - s^width)^side)^2: 0.998 at 0.8, more above, for
the defaults.

A table key can only be shared if both its halves are. So the short keys are counted first, by an aggregate that combines before its
shuffle, and table keys are made of shared halves alone, which leaves out nearly all texts that resemble no other.

Texts of equal shingle sets are one node. Candidates are compared and confirmed on full sets, see `links`; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import Drafts, id_and_text, slices
from swathgrid.llm.links import classes, hashed, linked_nodes, one_key_a_group, one_text
from swathgrid.llm.shingles import Shingles, U, mix, parities
from swathgrid.sources.workspace import written

CHUNK_BYTES = 2 << 20
FACTS = "uid long, doc_id long, n long, print binary, halves binary, h long, bits array<long>"


class Halves:
    """The short keys of sets: first those of one collection, then those of the other."""

    def __init__(self, side: int, width: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.side, self.width = side, width
        self.factors = rng.integers(0, 1 << 63, 2 * side * width, dtype=U) * U(2) + U(1)
        self.terms = rng.integers(0, 1 << 63, 2 * side * width, dtype=U)
        self.places = mix(np.arange(1, 2 * side + 1, dtype=U) * U(0x9E3779B97F4A7C15))

    def of(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[set, 2 * side] keys of sets that lie one after the other in `flat`, none of them empty."""
        least = np.empty((len(self.factors), len(starts)), U)
        work = np.empty_like(flat)
        for i, (a, b) in enumerate(zip(self.factors, self.terms, strict=True)):
            np.multiply(flat, a, out=work)
            np.add(work, b, out=work)
            least[i] = np.minimum.reduceat(work, starts)
        keys = np.repeat(self.places[:, None], len(starts), 1)
        for w in range(self.width):
            keys = mix(keys ^ least[w :: self.width])
        return keys.T


def set_facts(n: int, side: int, width: int):
    """Task function: a row of facts for every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, halves, task, seen = Shingles(n), Halves(side, width), TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            sets = make.sets(batch.column("text").to_pylist())
            full = [s for s in sets if len(s)]
            keys = iter([])
            if full:
                starts = np.cumsum([0, *map(len, full[:-1])])
                keys = iter(halves.of(np.concatenate(full), starts))
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(keys).tobytes()) if len(s) else (None, None) for s in sets]
            columns = [
                pa.array(task + seen + np.arange(len(sets))),
                batch.column("doc_id"),
                pa.array(list(map(len, sets)), pa.int64()),
                *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)),
                batch.column("h"),
                pa.array([parities(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            seen += len(sets)
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "print", "halves", "h", "bits"])

    return run


def _each_half(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (node, slot, half) for every short key of a node."""
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("halves").to_pylist()), np.int64).reshape(batch.num_rows, -1)
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(slots), pa.array(keys.ravel())], names=["node", "slot", "half"])


def _table_keys(side: int):
    """Task function: a row (key, node) for every pair of a node's shared short keys, one from each collection."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots, halves, node in zip(*(batch.column(c).to_pylist() for c in ("slots", "halves", "node")), strict=True):
                slot, half = np.array(slots), np.array(halves, np.int64).view(U)
                first, second = half[slot < side], half[slot >= side]
                # A short key already tells its place, so the table's number need not be in the key.
                keys = mix(mix(first)[:, None] + second[None, :]).ravel().view(np.int64)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), node))], names=["key", "node"])

    return run


def _grouped(batches: Iterable[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def table_members(nodes: DataFrame, side: int, drafts: Drafts) -> DataFrame:
    """key, node of every table key that two nodes or more share; of keys with the same members one is enough."""
    halves = drafts.written(nodes.select("node", "halves").mapInArrow(_each_half, "node long, slot int, half long"), "minhash-halves")
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    own = halves.join(drafts.written(shared, "minhash-shared"), "half")
    own = own.groupBy("node").agg(F.collect_list("slot").alias("slots"), F.collect_list("half").alias("halves"))
    make = _table_keys(side)
    keys = drafts.written(own.mapInArrow(lambda batches: _grouped(make(batches)), "key long, node long"), "minhash-keys")
    return one_key_a_group(keys, drafts)


def near_duplicate_classes(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, side: int = 10, width: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when den * |intersection| >= num * |union| of their sets of n-word shingles, as 64-bit hashes; a text
    of fewer words is one shingle. Null, empty and blank texts have none and link with nothing: their
    component is their own id. Words are lower-cased in A-Z and cut at ASCII white space; whole texts count, however long. component_id is
    the smallest id reachable; null ids take part but are never the smallest, and their rows are kept only
    where the component has no id at all. Repeated rows give repeated results; other columns are not read.
    """
    base, drafts = id_and_text(docs), Drafts()
    facts = written(hashed(base).mapInArrow(set_facts(n, side, width), FACTS), "minhash-facts")
    nodes = facts.filter("print IS NOT NULL").groupBy("print").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "halves", "bits")), one_text()
    )
    nodes = written(nodes, "minhash-nodes")
    members = table_members(nodes, side, drafts)
    drafts.drop(but_last=True)
    labels = linked_nodes(base, nodes, members, n, num, den)
    drafts.drop()
    found = classes(facts.select("print", "doc_id", "n"), nodes, labels)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
