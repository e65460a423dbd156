"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class). The most frequent words are classes of
their own; the other words fall into classes by their letters and by whether they occurred once or
more often. Words that training never saw share the once-seen class of their letters. Class features
are bias, the previous class, the skipped one before it, both together (hashed), and the class three
back in coarse groups; the weights are trained by gradient updates over the whole training corpus.

Within a class, P(word | class) is proportional to the word's share of the class times exp(its features): the hashed pair
of previous word and word, for every such pair of the training corpus, and the coarse skipped class with the word's hashed bucket.
Only words seen after the previous word depart from the bucket's factor, so the sum over the whole class follows from them
and from sums by bucket. Pairs are dealt by previous word and class to as many shards as the input needs; a shard
holds all that its sums need and trains its weights by iterative scaling, without an exchange. Seen pairs are aimed at their counts less
a discount, which leaves probability to words not seen there.

Texts are read once, in chunks. Words of a chunk go to the shard of their hash with their
counts, and only their totals come back, so a frequent word is one entry per chunk. Class n-grams are
merged the same way. The n-gram table is bounded by the classes, as are the weights that each
round broadcasts and collects. Word pairs go to their shards once a chunk, and their log probabilities come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import Drafts, crc_mod, id_and_text, slices, words
from swathgrid.llm.shingles import U, mix
from swathgrid.sources.workspace import written

HEAD, SIGNS = 96, 16
CLASSES = HEAD + 2 * SIGNS
COARSE, PAIR_ROWS = 32, 8192
START = CLASSES - 1  # stands for what lies before a text
END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # a blank: no word has one
CHUNK_BYTES = 4 << 20
#: Rows of the weight matrix: bias, previous, skipped, coarse third, hashed pair.
OFFSETS = np.cumsum([0, 1, CLASSES, CLASSES, COARSE])
ROWS = int(OFFSETS[-1]) + PAIR_ROWS
#: Within a class: coarse groups of the skipped class, buckets of words, pseudo-tokens of a skip group.
SKIPS, BUCKETS, PRIOR = 32, 16, 64.0
BEFORE = U(xxhash.xxh64_intdigest(b" before"))  # the word before a text
CODE_BITS, PAIR_BITS = 24, 30  # of an event: class (5), previous word with class, word, skip group (5)
CONTEXTS = 8192  # worked on at once
TASKS = 8  # of a training round: the n-gram table does not grow beyond its bound
DDL = "kind int, shard int, chunk long, data binary"
NAMES = ["kind", "shard", "chunk", "data"]


def planes(a: np.ndarray) -> np.ndarray:
    """First the first bytes of all, then the second ones: high bytes compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.ravel()


def of_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed buffer."""
    sink = pa.BufferOutputStream()
    table = [pa.array(a) for a in arrays]
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for a in table:
            batch = pa.record_batch([a], names=["a"])
            with pa.ipc.new_stream(out, batch.schema) as w:
                w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    reader, out = pa.BufferReader(raw), []
    while reader.tell() < len(raw):
        with pa.ipc.open_stream(reader) as r:
            out.append(r.read_all()["a"].combine_chunks().to_numpy(zero_copy_only=False))
    return out


def sign(word: bytes) -> int:
    """A word's letters in 16 groups: its last character beyond ASCII, else its last two bytes."""
    for i in range(len(word) - 1, -1, -1):
        if word[i] >= 128:
            return 8 + word[i] % 8
    return zlib.crc32(word[-2:]) % 8


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def word_order(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words by shard, and where each shard ends."""
    shard = (hashes % U(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))


def read_chunks(shards: int):
    """Documents to chunk rows (kind 0) and the chunk's words by shard (kind 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            known: dict[bytes, int] = {}
            ids, lengths = [], []
            for text in batch.column("text").to_pylist():
                ws = words(text)
                for w in set(ws).difference(known):
                    known[w] = len(known) + 1
                own = np.zeros(len(ws) + 1, np.int32)  # word 0 is the end
                own[:-1] = np.fromiter(map(known.__getitem__, ws), np.int32, len(ws))
                ids.append(own)
                lengths.append(len(own))
            held = np.asarray(batch.column("held_out"))
            ids, lengths = np.concatenate(ids), np.array(lengths)
            common = np.argsort(-np.bincount(ids), kind="stable")  # frequent words first: their numbers compress
            ids = np.argsort(common)[ids].astype(np.int32)
            hashes = np.array([END, *map(xxhash.xxh64_intdigest, known)], np.uint64)[common]
            signs = np.array([0, *map(sign, known)], np.uint8)[common]
            counts = np.bincount(ids[np.repeat(~held, lengths)], minlength=len(hashes))
            order, ends = word_order(hashes, shards)
            chunk, made = task + made, made + 1
            doc_ids = batch.column("doc_id")
            known_id = np.asarray(doc_ids.is_valid())
            values = np.asarray(doc_ids.fill_null(0))
            rows = [(0, None, chunk, packed(planes(ids), lengths.astype(np.int32), held.astype(np.uint8), values, known_id.astype(np.uint8), signs, hashes))]
            at = 0
            for k, end in enumerate(ends.tolist()):
                if end > at:
                    own = order[at:end]
                    rows.append((1, k, chunk, squeezed(hashes[own], counts[own], signs[own])))
                    at = end
            yield _rows(rows)

    return run


def word_codes(hashes: np.ndarray) -> np.ndarray:
    """A word's code within its class; 0 is left to words never seen."""
    return np.maximum((hashes >> U(13)) & U(2**CODE_BITS - 1), U(1))


def count_words(rows: pa.Table) -> pa.Table:
    """Totals of a shard's words, back to each chunk (kind 1), and the shard's statistics (kind 2)."""
    shard = rows["shard"][0].as_py()
    chunks = rows["chunk"].to_pylist()
    parts = [unsqueezed(d, "u8", "i8", "u1") for d in rows["data"].to_pylist()]
    hashes, counts, signs = (np.concatenate([p[i] for p in parts]) for i in range(3))
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    out = [(1, shard, c, squeezed(t)) for c, t in zip(chunks, np.split(total[inverse], ends), strict=True)]
    top = np.argsort(-total, kind="stable")[:HEAD]
    top = top[total[top] > 0]
    s = signs[first].astype(np.int64)
    cell = s * BUCKETS + (word_codes(distinct) % U(BUCKETS)).astype(np.int64)
    by = lambda mask, weight=None: np.bincount(cell[mask], None if weight is None else weight[mask], SIGNS * BUCKETS).astype(np.int64)
    facts = np.concatenate([[total.sum(), (total > 0).sum(), (total == 2).sum()], by(total == 1), by(total > 1, total)])
    out.append((2, shard, None, packed(distinct[top], total[top], s[top], facts.astype(np.int64))))
    return pa.Table.from_batches([_rows(out)])


@dataclass(frozen=True)
class Vocabulary:
    n: int
    v: int
    head: np.ndarray  # hashes, sorted
    head_class: np.ndarray
    once: np.ndarray  # words seen once, by sign
    often: np.ndarray  # tokens of other words, by sign
    unseen: float  # share of a once-class that words never seen get
    shares: np.ndarray | None = None  # of the buckets of each class in its words' shares

    def heads(self, hashes: np.ndarray) -> np.ndarray:
        """Classes of words that are one of their own, -1 of others. Decided from hashes."""
        if not len(self.head):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.head, hashes).clip(0, len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.head_class[at], -1)

    def classes(self, hashes_in_head: np.ndarray, counts: np.ndarray, signs: np.ndarray) -> np.ndarray:
        tail = HEAD + signs.astype(np.int64) + SIGNS * (counts > 1)
        return np.where(hashes_in_head >= 0, hashes_in_head, tail)

    def share(self, counts: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Of words in their classes, without features."""
        once, often = np.maximum(self.once, 1)[signs], np.maximum(self.often, 1)[signs]
        unseen = np.where(self.once > 0, self.unseen, 1.0)[signs]
        return np.where(counts > 1, counts / often, np.where(counts == 1, (1 - self.unseen) / once, unseen))

    def within(self, classes: np.ndarray, counts: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """log10 P(word | class), without features."""
        return np.where(classes < HEAD, 0.0, np.log10(np.maximum(self.share(counts, signs), 1e-300)))


def vocabulary(stats: list[bytes]) -> Vocabulary:
    parts = [unpacked(d) for d in stats]
    hashes, counts, signs = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    facts = np.sum([p[3] for p in parts], axis=0) if parts else np.zeros(3 + 2 * SIGNS * BUCKETS, np.int64)
    best = np.lexsort((hashes, -counts))[:HEAD]
    best = best[counts[best] > 1]
    once, often = facts[3:].reshape(2, SIGNS, BUCKETS).copy()
    np.subtract.at(often, (signs[best].astype(np.int64), (word_codes(hashes[best].astype(U)) % U(BUCKETS)).astype(np.int64)), counts[best])
    sort = np.argsort(hashes[best])
    unseen = float((once.sum() + 1) / (once.sum() + 2 * facts[2] + 2))
    rare = (1 - unseen) * once / np.maximum(once.sum(1, keepdims=True), 1)
    rare[:, 0] += np.where(once.sum(1) > 0, unseen, 1.0)  # bucket of the words never seen
    shares = np.concatenate([rare, often / np.maximum(often.sum(1, keepdims=True), 1)])
    return Vocabulary(int(facts[0]), int(facts[1]), hashes[best][sort], np.arange(len(best))[sort], once.sum(1), often.sum(1), unseen, shares)


def to_classes(voc: Vocabulary, shards: int):
    """Cogroup of a chunk and its words' totals: words, classes and base scores (kind 3), training n-grams (kind 4), skip counts (kind 6)."""

    def run(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_batches([_rows([])])
        ids, lengths, held, doc_ids, known_id, signs, hashes = unpacked(chunk["data"][0].as_py())
        ids, order = of_planes(ids, "i4"), word_order(hashes, shards)[0]
        got = dict(zip(totals["shard"].to_pylist(), totals["data"].to_pylist(), strict=True))
        counts = np.zeros(len(signs), np.int64)
        counts[order] = np.concatenate([unsqueezed(got[k], "i8")[0] for k in sorted(got)])
        classes = voc.classes(voc.heads(hashes), counts, signs)
        base = np.log10((counts + 0.1) / (voc.n + 0.1 * (voc.v + 1)))
        starts = np.cumsum(lengths) - lengths
        per_doc = lambda x: np.add.reduceat(x[ids], starts)  # noqa: E731  every text has its end
        seq = classes[ids].astype(np.uint8)
        sums = per_doc((counts > 0).astype(np.int64)), per_doc(base)
        own = packed(planes(ids), lengths, held, doc_ids, known_id, hashes, counts, classes.astype(np.uint8), *sums)
        out = [(3, None, chunk["chunk"][0].as_py(), own)]
        learned = np.repeat(held == 0, lengths)
        at, key, _ = events(ids, lengths, hashes, counts, classes, 1)
        cell = ((key & U(SKIPS - 1)).astype(np.int64) * 2 * SIGNS + (key >> U(59)).astype(np.int64)) * BUCKETS + (key >> U(5)).astype(np.int64) % BUCKETS
        skipped = np.bincount(cell[learned[at]], minlength=SKIPS * 2 * SIGNS * BUCKETS)
        out += [(6, k, None, packed(part)) for k, part in enumerate(np.split(skipped, 4))]
        grams = n_grams(seq, lengths)[learned]
        grams, times = np.unique(grams, return_counts=True)
        shard = (grams >> np.uint32(8)) % shards
        sort = np.argsort(shard, kind="stable")
        at = 0
        for k, end in enumerate(np.cumsum(np.bincount(shard, minlength=shards)).tolist()):
            if end > at:
                out.append((4, k, None, packed(grams[sort[at:end]], times[sort[at:end]])))
                at = end
        return pa.Table.from_batches([_rows(out)])

    return run


def coarse(classes: np.ndarray) -> np.ndarray:
    return np.where(classes < HEAD, classes % 16, 16 + (classes - HEAD) % SIGNS)


def events(ids, lengths, hashes, counts, classes, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose class holds other words too: their places, event keys (class, previous word, word, skip group) and shards."""
    classes = classes.astype(np.int64)
    at = np.flatnonzero(classes[ids] >= HEAD)
    place = (at - np.repeat(np.cumsum(lengths) - lengths, lengths)[at]).astype(np.int32)
    h = np.where(place >= 1, hashes[ids[at - 1]], BEFORE)
    h = mix(h + ((classes - HEAD + 1).astype(U) * U(0x9E3779B97F4A7C15))[ids[at]])
    shard = ((h >> U(PAIR_BITS)) % U(shards)).astype(np.int32)
    key = (h & U(2**PAIR_BITS - 1)) << U(CODE_BITS + 5)
    key |= ((classes - HEAD).astype(U) << U(59) | np.where(counts > 0, word_codes(hashes), U(0)) << U(5))[ids[at]]
    key |= np.where(place >= 2, coarse(classes).astype(U)[ids[at - 2]], U(coarse(np.array(START))))
    return at, key, shard


def runs(key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard and key, and where runs of equal ones start in it."""
    order = np.lexsort((key, shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard))
    key, shard = key[order], shard[order]
    return order, np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])[: len(key)])


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte, compressed."""
    raw = b"".join(planes(a).tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(data: bytes, *types: str) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(sizes), "zstd", asbytes=True), np.uint8)
    ends = np.cumsum([0, *sizes]) * n
    return [of_planes(raw[a:b], t) for a, b, t in zip(ends, ends[1:], types, strict=False)]


def deal_events(shards: int):
    """Chunks (kind 3) to rows of their events for each shard: key, times in training texts, the word's count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                ids, lengths, held, _, _, hashes, counts, classes, *_ = unpacked(data)
                ids = of_planes(ids, "i4")
                at, key, shard = events(ids, lengths, hashes, counts, classes, shards)
                order, starts = runs(key, shard)
                if not len(starts):
                    continue
                times = np.add.reduceat(np.repeat(held == 0, lengths)[at][order].astype(np.uint32), starts)
                key, shard, counts = key[order[starts]], shard[order[starts]], counts[ids[at[order[starts]]]]
                ends = np.flatnonzero(np.append(shard[1:] != shard[:-1], True)) + 1
                rows = [
                    (7, int(shard[a]), chunk, squeezed(np.diff(key[a:b], prepend=U(0)), times[a:b].astype(np.uint32), counts[a:b]))
                    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
                ]
                yield _rows(rows)

    return run


def skip_factors(voc: Vocabulary, seen: np.ndarray) -> np.ndarray:
    """[skip group, class, bucket]: exp(weight), which keeps each class's sum at 1. `seen`: training tokens."""
    expected = np.broadcast_to(voc.shares, seen.shape)
    p = (seen + PRIOR * expected) / (seen.sum(2, keepdims=True) + PRIOR)
    return np.where(expected > 0, p / np.maximum(expected, 1e-300), 1.0)


def scaled(key, times, counts, voc: Vocabulary, factors: np.ndarray, rounds: int) -> np.ndarray:
    """log10 P(word | class, history) of distinct events in order; those of a context (class, previous word) are all here."""
    out = np.zeros(len(key))
    context = key >> U(CODE_BITS + 5)
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    tails = (key[starts] >> U(59)).astype(np.int64)
    for tail in np.unique(tails).tolist():
        own = np.flatnonzero(tails == tail)
        for at in range(0, len(own), CONTEXTS):
            a, last = starts[own[at]], own[min(at + CONTEXTS, len(own)) - 1]
            b = starts[last + 1] if last + 1 < len(starts) else len(key)
            out[a:b] = _scaled(key[a:b], times[a:b], counts[a:b], voc, tail, factors[:, tail, :], rounds)
    return out


def _scaled(key, times, counts, voc: Vocabulary, tail: int, factors: np.ndarray, rounds: int) -> np.ndarray:
    context, pair = key >> U(CODE_BITS + 5), key >> U(5)
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
    of_event = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
    n, first = int(of_event[-1]) + 1, np.flatnonzero(fresh)
    skip, bucket = (key & U(SKIPS - 1)).astype(np.int64), (pair % U(BUCKETS)).astype(np.int64)
    share = voc.share(counts, np.full(len(key), tail % SIGNS))
    met = np.add.reduceat(times.astype(np.float64), first)
    seen = np.flatnonzero(met > 0)
    where = np.full(len(met), -1)
    where[seen] = np.arange(len(seen))
    where = where[np.cumsum(fresh) - 1]  # the seen pair of an event, or none
    q, target, place, cell = share[first[seen]], met[seen] - voc.unseen, of_event[first[seen]], bucket[first[seen]]
    by_bucket = lambda x: np.bincount(place * BUCKETS + cell, x, n * BUCKETS).reshape(n, BUCKETS)
    total = np.bincount(of_event * SKIPS + skip, times, n * SKIPS).reshape(n, SKIPS)
    rest = np.maximum(1 - by_bucket(q) @ factors.T, 1e-9)  # of words not seen after this one
    # Start where the sums fit without the skip groups.
    held = np.maximum(1 - np.bincount(place, q, n), 1e-9) / (voc.unseen * np.maximum(np.bincount(place, minlength=n), 1))
    weight = np.log(target * held[place] / q)
    for _ in range(rounds):
        sums = rest + by_bucket(q * np.exp(weight)) @ factors.T
        expected = q * np.exp(weight) * ((total / sums) @ factors)[place, cell]
        weight += np.log(target / expected)
    sums = rest + by_bucket(q * np.exp(weight)) @ factors.T
    raised = np.where(where >= 0, np.append(weight, 0.0)[where], 0.0)
    return (np.log(share * factors[skip, bucket]) + raised - np.log(sums[of_event, skip])) / np.log(10)


def train_words(voc: Vocabulary, factors: np.ndarray, rounds: int):
    """Rows of a shard's events to rows of their log probabilities, chunk by chunk."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unsqueezed(d, "u8", "u4", "i8") for d in rows["data"].to_pylist()]
        keys = np.concatenate([np.cumsum(p[0], dtype=U) for p in parts])
        times, counts = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        logs = scaled(distinct, np.bincount(inverse, times, len(distinct)), counts[first], voc, factors, rounds)
        logs = np.split(logs.astype(np.float32)[inverse], np.cumsum([len(p[0]) for p in parts])[:-1])
        shard = rows["shard"][0].as_py()
        return pa.Table.from_batches([_rows([(8, shard, c, squeezed(x)) for c, x in zip(rows["chunk"].to_pylist(), logs, strict=True)])])

    return run


def n_grams(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token: coarse third, skipped and previous class, own class, eight bits each."""
    place = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    back = lambda k: np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), seq[: len(seq) - k]])[: len(seq)], START).astype(np.uint32)
    third = coarse(back(3)).astype(np.uint32)
    return third << 24 | back(2) << 16 | back(1) << 8 | seq.astype(np.uint32)


def merge_counts(rows: pa.Table) -> pa.Table:
    total = np.sum([unpacked(d)[0] for d in rows["data"].to_pylist()], axis=0)
    return pa.Table.from_batches([_rows([(6, rows["shard"][0].as_py(), None, packed(total))])])


def merge_grams(rows: pa.Table) -> pa.Table:
    parts = [unpacked(d) for d in rows["data"].to_pylist()]
    grams, times = (np.concatenate([p[i] for p in parts]) for i in range(2))
    distinct, inverse = np.unique(grams, return_inverse=True)
    total = np.bincount(inverse, times, len(distinct)).astype(np.int64)
    return pa.Table.from_batches([_rows([(4, rows["shard"][0].as_py(), None, packed(distinct, total))])])


def features(contexts: np.ndarray) -> np.ndarray:
    """Rows of the weight matrix that a context (third, skipped, previous) uses."""
    third, skip, last = contexts >> 16 & 255, contexts >> 8 & 255, contexts & 255
    pair = (skip * 40503 + last * 9973 + 17) % PAIR_ROWS
    return np.stack([np.zeros_like(last), OFFSETS[1] + last, OFFSETS[2] + skip, OFFSETS[3] + third, OFFSETS[4] + pair])


def log_probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[0]].copy()
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def gradient(grams: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Observed and expected counts of every weight, summed over all n-grams (2 x ROWS x CLASSES)."""
    shared = grams.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, out = shared.value, np.zeros((2, ROWS, CLASSES), np.float32)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, times = unpacked(data)
                contexts, inverse = np.unique(keys >> np.uint32(8), return_inverse=True)
                for at in range(0, len(contexts), 8192):
                    rows = features(contexts[at : at + 8192].astype(np.int64))
                    own = (inverse >= at) & (inverse < at + 8192)
                    seen = np.zeros((rows.shape[1], CLASSES), np.float32)
                    np.add.at(seen, (inverse[own] - at, (keys[own] & np.uint32(255)).astype(np.int64)), times[own])
                    expected = np.exp(log_probabilities(w, rows)) * seen.sum(1, keepdims=True)
                    for r in rows:
                        sort = np.argsort(r, kind="stable")
                        named, starts = np.unique(r[sort], return_index=True)
                        out[0, named] += np.add.reduceat(seen[sort], starts)
                        out[1, named] += np.add.reduceat(expected[sort], starts)
        blocks = np.array_split(np.arange(ROWS), 16)
        yield _rows([(5, k, None, out[:, b].tobytes()) for k, b in enumerate(blocks)])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(d, np.float32) for d in rows["data"].to_pylist()], axis=0, dtype=np.float64)
        return pa.Table.from_batches([_rows([(5, rows["shard"][0].as_py(), None, total.astype(np.float32).tobytes())])])

    parts = grams.mapInArrow(run, DDL).groupBy("shard").applyInArrow(add, DDL).collect()
    blocks = {r["shard"]: np.frombuffer(r["data"], np.float32).reshape(2, -1, CLASSES) for r in parts}
    return np.concatenate([blocks[k] for k in sorted(blocks)], axis=1) if blocks else np.zeros((2, ROWS, CLASSES), np.float32)


def train(grams: DataFrame, rounds: int, rate: float = 0.5) -> np.ndarray:
    """Gradient updates over the whole n-gram table, each scaled by the expected count (the diagonal of the curvature)."""
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for r in range(rounds):
        seen, expected = gradient(grams, weights)
        if not r:  # start from the class frequencies
            weights[0] = np.log((seen[0] + 0.5) / (seen[0].sum() + 0.5 * CLASSES))
            continue
        weights += rate * np.clip((seen - expected) / (np.maximum(seen, expected) * 0.5 + expected * 0.5 + 2.0), -1.5, 1.5)
    return weights


def score_chunks(weights, n: int, shards: int):
    """Cogroup of a chunk (kind 3) and its events' log probabilities: a row for each text."""

    def run(chunk: pa.Table, inner: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return SCORES.empty_table()
        ids, lengths, held, doc_ids, known_id, hashes, counts, classes, known, base = unpacked(chunk["data"][0].as_py())
        ids = of_planes(ids, "i4")
        score = base
        if n:
            seq, w = classes[ids], weights.value
            contexts, inverse = np.unique(n_grams(seq, lengths) >> np.uint32(8), return_inverse=True)
            logs = np.zeros(len(seq))
            order = np.argsort(inverse, kind="stable")
            ends = np.searchsorted(inverse[order], np.arange(0, len(contexts) + 8192, 8192))
            for k, at in enumerate(range(0, len(contexts), 8192)):
                own = order[ends[k] : ends[k + 1]]
                table = log_probabilities(w, features(contexts[at : at + 8192].astype(np.int64)))
                logs[own] = table[inverse[own] - at, seq[own]]
            logs /= np.log(10)
            at, key, shard = events(ids, lengths, hashes, counts, classes, shards)
            order, starts = runs(key, shard)
            got = dict(zip(inner["shard"].to_pylist(), inner["data"].to_pylist(), strict=True))
            own = np.concatenate([np.zeros(0, np.float32), *(unsqueezed(got[k], "f4")[0] for k in sorted(got))])
            logs[at[order]] += np.repeat(own.astype(np.float64), np.diff(np.append(starts, len(at))))
            score = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
        columns = [
            pa.array(doc_ids, mask=known_id == 0), pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64)),
            pa.array(known.astype(np.int64)), pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(score),
        ]
        return pa.Table.from_arrays(columns, schema=SCORES)

    return run


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score_texts(docs: DataFrame, fold: int = 10, rounds: int = 8) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) modulo `fold` is 0 are held out, all others are learned from. Null text
    is empty and has one token, its end. base_score is the smoothed unigram score, score the model's log10
    probability; with nothing to learn from, it is the base score. Repeated rows count and score
    each; a null id counts as an empty text for the fold; other columns are not read.
    """
    base = id_and_text(docs).withColumn("held_out", crc_mod(F.col("doc_id"), fold) == 0)
    shards, drafts = max(16, 2 * base.rdd.getNumPartitions()), Drafts()
    chunks = drafts.written(base.mapInArrow(read_chunks(shards), DDL), "lm-chunks", ["kind"])
    counted = drafts.written(chunks.filter("kind = 1").select(*NAMES).groupBy("shard").applyInArrow(count_words, DDL), "lm-counts")
    drafts.drop_part(0, "kind=1")
    voc = vocabulary([r["data"] for r in counted.filter("kind = 2").select("data").collect()])
    kept = Drafts()  # its table is read by the result
    classed = kept.written(
        chunks.filter("kind = 0")
        .select(*NAMES)
        .groupBy("chunk")
        .cogroup(counted.filter("kind = 1").groupBy("chunk"))
        .applyInArrow(to_classes(voc, shards), DDL),
        "lm-classes",
        ["kind"],
    )
    drafts.drop()
    merged = classed.filter("kind = 6").select(*NAMES).groupBy("shard").applyInArrow(merge_counts, DDL).select("shard", "data").collect()
    seen = np.concatenate([unpacked(r["data"])[0] for r in sorted(merged)]) if merged else np.zeros(SKIPS * 2 * SIGNS * BUCKETS)
    factors = skip_factors(voc, seen.reshape(SKIPS, 2 * SIGNS, BUCKETS))
    grams = drafts.written(classed.filter("kind = 4").select(*NAMES).groupBy("shard").applyInArrow(merge_grams, DDL), "lm-grams")
    kept.drop_part(0, "kind=4")
    kept.drop_part(0, "kind=6")
    weights = train(grams.coalesce(TASKS), rounds)
    drafts.drop()
    texts = classed.filter("kind = 3").select(*NAMES)
    dealt = texts.mapInArrow(deal_events(shards), DDL).groupBy("shard")
    inner = written(dealt.applyInArrow(train_words(voc, factors, rounds), DDL), "lm-words")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(inner.groupBy("chunk")).applyInArrow(score_chunks(shared, voc.n, shards), schema)
