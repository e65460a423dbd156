"""Exact Jaccard self-join on word shingles by universe partition and the pigeonhole principle.

Sets are banded by size so that a set links only within its band or the next. Two linked sets
of which the smaller lies in band b differ in k_b elements at most. A hash deals the universe of
shingles into k_b + 1 segments, so two such sets agree in at least one of them. Each set is
indexed under its segments for its own band, and as a possible larger partner for the band before.

An empty segment agrees with every other empty one, and as an index key would cost a pair for each pair of sets. Its
share of the budget is spent elsewhere: let e segments be empty in both sets and the others all differ; then at
most e - 1 of the others differ in two elements or more. Walking round the segments, each empty
one claims the next that holds two elements or more (those passed on the way count too), and a claimed segment is
indexed under its one-deletion neighbourhood, which finds partners that differ in one element.
More empty segments only claim more, so sets that share e empty ones share e claims, one of
which differs in exactly one element. A set with fewer such segments than empty ones is also indexed under
pairs of its empty segments, as a subset of segments that both have.

Copies of one set are one node. Candidates are compared and confirmed exactly, see `links`; nothing is capped.
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

EXACT, DELETED, EMPTIES = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
CHUNK_BYTES = 4 << 20
HOT = 32  # documents of a chunk under one key, beyond which they travel as rows


class Bands:
    """Size bands for a threshold of num / den, and the largest difference k of linked sets in each."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        starts = [1]
        while starts[-1] <= most:
            starts.append(starts[-1] * den // num + 1)
        self.num, self.den = num, den
        self.starts = np.array(starts)
        self.last = self.starts[1:] - 1
        self.k = self.last * (den - num) // num

    def of(self, size: int) -> list[int]:
        """The set's own band, and the one before if a set there can be its smaller partner."""
        b = int(np.searchsorted(self.starts, size, "right")) - 1
        before = b > 0 and size * self.num <= int(self.last[b - 1]) * self.den
        return [b, b - 1] if before else [b]


def claimed(sizes: np.ndarray) -> np.ndarray:
    """Segments with elements that are reached while a claim of an empty segment is open, going round."""
    step = np.where(sizes == 0, 1, np.where(sizes >= 2, -1, 0))
    walk = np.cumsum(np.concatenate([step, step]))
    open_claims = walk - np.minimum(np.minimum.accumulate(walk), 0)
    before = open_claims[len(sizes) - 1 : -1]
    return (before > 0) & (sizes > 0)


def keys_of(s: np.ndarray, band: int, segments: int) -> np.ndarray:
    """Index keys of a set for one band."""
    z = mix(s ^ U(band + 1))
    seg = (((z >> U(32)) * U(segments)) >> U(32)).astype(np.int64)
    sums = np.zeros(segments, U)
    np.add.at(sums, seg, z)
    sizes = np.bincount(seg, minlength=segments)
    place = mix(np.arange(segments, dtype=U) * U(0x100000001B3) + U(band))
    full = np.flatnonzero(sizes)
    out = [mix(sums[full] ^ place[full] ^ EXACT)]
    if len(full) < segments:
        claims = claimed(sizes)
        if claims.any():
            out.append(mix(sums[claims] ^ place[claims] ^ DELETED))
            part = claims[seg] & (sizes[seg] > 1)
            out.append(mix((sums[seg[part]] - z[part]) ^ place[seg[part]] ^ DELETED))
        empty = np.flatnonzero(sizes == 0)
        if (sizes >= 2).sum() < len(empty):
            i, j = np.triu_indices(len(empty), 1)
            out.append(mix(place[empty[i]] * U(3) + place[empty[j]] ^ EMPTIES))
    return np.unique(np.concatenate(out))


def index_chunks(n: int, bands: Bands, shards: int):
    """Task function: documents to rows (shard, data) of facts and index keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, task, seen = Shingles(n), TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            sets = make.sets(batch.column("text").to_pylist())
            uids = task + seen + np.arange(len(sets))
            seen += len(sets)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = [
                (int(u) % shards, 0, None, int(u), d, len(s), p, None, a, parities(s) if len(s) else None)
                for u, d, s, p, a in zip(uids, ids, sets, prints, batch.column("h").to_pylist(), strict=True)
            ]
            first: dict[bytes, int] = {}  # one of the chunk's copies is enough for the index
            for i, p in enumerate(prints):
                if p is not None:
                    first.setdefault(p, i)
            keys, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for i in first.values():
                for b in bands.of(len(sets[i])):
                    got = keys_of(sets[i], b, int(bands.k[b]) + 1)
                    keys.append(got)
                    docs.append(np.full(len(got), i))
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            sort = np.argsort(keys, kind="stable")
            keys, docs = keys[sort], docs[sort]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(keys)))
            hot = np.repeat(counts > HOT, counts)
            # Members of a key that is hot here go out one by one; a mark tells the key's shard.
            for at, (key, doc) in enumerate(zip(keys[hot].view(np.int64).tolist(), docs[hot].tolist(), strict=True)):
                rows.append((at % shards, 1, key, int(uids[doc]), None, None, None, None, None, None))
            marks = starts[counts > HOT]
            cold_keys = np.concatenate([keys[~hot], keys[marks]])
            cold_docs = np.concatenate([docs[~hot], np.full(len(marks), 0xFFFF)]).astype(np.uint16)
            shard = (cold_keys >> U(40)).astype(np.int64) % shards
            sort = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=shards))
            at = 0
            for k, end in enumerate(ends.tolist()):
                if end > at:
                    own = sort[at:end]
                    data = cold_keys[own].tobytes() + cold_docs[own].tobytes()
                    rows.append((k, 2, None, int(uids[0]), None, None, None, data, None, None))
                    at = end
            yield _rows(rows)

    return run


ROWS = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64())]
    + [("n", pa.int64()), ("print", pa.binary()), ("data", pa.binary()), ("h", pa.int64()), ("bits", pa.list_(pa.int64()))]
)
ROWS_DDL = "shard int, kind int, key long, uid long, doc_id long, n long, print binary, data binary, h long, bits array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(ROWS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


def shared_keys(rows: pa.Table) -> pa.Table:
    """Facts and single members as they are; of packed keys, members of those with two or more."""
    kind = np.asarray(rows["kind"])
    whole = rows.filter(pa.array(kind < 2)).select(["key", "uid", "doc_id", "n", "print", "h", "bits"])
    keys, uids = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for base, data in zip(*(rows.filter(pa.array(kind == 2))[c].to_pylist() for c in ("uid", "data")), strict=True):
        count = len(data) // 10
        keys.append(np.frombuffer(data, U, count))
        docs = np.frombuffer(data, np.uint16, count, 8 * count).astype(np.int64)
        uids.append(np.where(docs == 0xFFFF, -1, base + docs))
    keys, uids = np.concatenate(keys), np.concatenate(uids)
    sort = np.argsort(keys, kind="stable")
    keys, uids = keys[sort], uids[sort]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[:-1] |= same[1:]  # a mark next to a key counts as a member elsewhere
    same &= uids >= 0
    null = lambda t: pa.nulls(int(same.sum()), t)
    found = [pa.array(keys[same].view(np.int64)), pa.array(uids[same]), *(null(f.type) for f in list(whole.schema)[2:])]
    return pa.concat_tables([whole.combine_chunks(), pa.table(found, schema=whole.schema)])


def _shards(docs: DataFrame) -> int:
    """In proportion to the input: some per partition of it."""
    return max(32, 4 * docs.rdd.getNumPartitions())


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when den * |intersection| >= num * |union| of their sets of n-word shingles; a
    text of fewer words is one shingle. Null, empty and blank texts have no shingles and link with
    nothing: their component is their own id. Words are lower-cased in A-Z and cut at ASCII white
    space; whole texts count. component_id is the smallest id reachable; null ids take part but
    are never the smallest. Repeated rows give repeated results; other columns are not read.
    """
    base, bands, drafts = id_and_text(docs), Bands(num, den), Drafts()
    shards = _shards(base)
    found = drafts.written(
        hashed(base).mapInArrow(index_chunks(n, bands, shards), ROWS_DDL)
        .groupBy("shard")
        .applyInArrow(shared_keys, "key long, uid long, doc_id long, n long, print binary, h long, bits array<long>"),
        "jaccard-index",
    )
    facts = written(found.filter("key IS NULL").select("uid", "doc_id", "n", "print", "h", "bits"), "jaccard-facts")
    # Copies of a set are one node, named by one of its rows.
    nodes = written(
        facts.filter("print IS NOT NULL").groupBy("print").agg(
            F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.first("bits").alias("bits"), one_text()
        ),
        "jaccard-nodes",
    )
    named = facts.filter("print IS NOT NULL").join(nodes.select("print", "node"), "print").select("uid", "node")
    keys = found.filter("key IS NOT NULL").select("key", "uid").join(named, "uid").select("key", "node").distinct()
    members = one_key_a_group(drafts.written(keys, "jaccard-keys"), drafts)
    drafts.drop(but_last=True)
    labels = linked_nodes(base, nodes, members, n, num, den)
    drafts.drop()
    return classes(facts, nodes, labels)


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` without those that are not their component's smallest id, columns unchanged.

    Rows with a null id stay. Rows that repeat an id stay or go together.
    """
    groups = jaccard_components(docs, n, num, den)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
