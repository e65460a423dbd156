"""Importance resampling towards a target: documents whose word runs look like the target's are drawn more often.

Features are the runs of one to `n` consecutive words, and a feature's bucket is the CRC-32 of its bytes modulo
`buckets`. No feature is ever built as a string. A task scans the normalised words once and keeps the running CRC
after each of them. CRC-32 is linear over GF(2): appending a run Q to a prefix P shifts the CRC of P by |Q| zero
bytes and adds the CRC of Q, so crc(Q) = crc(PQ) xor shift(crc(P), |Q|). Both prefixes of any run are among the
stored CRCs, and shifting is four table look-ups, done with numpy for all runs of a chunk at once.

Bucket counts of both tables give a gain for each bucket. A document's weight is the mean gain of its runs, and Gumbel noise
seeded by its id turns the draw without replacement into taking the highest scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathgrid.llm.common import id_and_text, slices
from swathgrid.sources.workspace import written

#: Bytes of text in a chunk; a longer text is scanned in several, cut between words.
CHUNK_BYTES = 1 << 20
POLYNOMIAL = 0xEDB88320
#: Shifts up to this many bytes have tables of their own, longer ones are put together from powers of two.
NEAR = 64


def _byte_table() -> bytes:
    """A-Z in lower case, every other ASCII byte but digits and a-z a blank, bytes of longer characters as they are."""
    return bytes(
        b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
    )


NORMAL = _byte_table()


def segments(text: str | None, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in stretches of about `most` bytes."""
    flat, at = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL), 0
    while at < len(flat):
        end = flat.find(b" ", at + most)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


class Shifts:
    """Multiplication of CRCs by x^(8n) modulo the polynomial: n zero bytes appended."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        self.step = step
        # places[b, v]: the value v in byte b.
        places = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
        near = [places]
        for _ in range(NEAR):
            near.append(self.zero_byte(near[-1]))
        self.near = np.concatenate([t.ravel() for t in near[:NEAR]])
        self.powers = [near[NEAR]]  # NEAR, 2 * NEAR, 4 * NEAR ... bytes

    def zero_byte(self, c: np.ndarray) -> np.ndarray:
        return (c >> np.uint32(8)) ^ self.step[c & np.uint32(255)]

    def blank(self, crcs: np.ndarray) -> np.ndarray:
        """CRCs after one more blank."""
        c = ~crcs
        return ~((c >> np.uint32(8)) ^ self.step[(c ^ np.uint32(0x20)) & np.uint32(255)])

    @staticmethod
    def _looked_up(table: np.ndarray, base: np.ndarray | int, c: np.ndarray) -> np.ndarray:
        out = table[base + (c & np.uint32(255)).astype(np.int64)]
        for byte in (1, 2, 3):
            out = out ^ table[base + 256 * byte + ((c >> np.uint32(8 * byte)) & np.uint32(255)).astype(np.int64)]
        return out

    def by(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self._looked_up(self.near, (lengths % NEAR) * 1024, crcs)
        far, k = lengths // NEAR, 0
        while far.any():
            if k == len(self.powers):
                last = self.powers[-1]
                self.powers.append(self._looked_up(last.ravel(), 0, last))
            odd = np.flatnonzero(far & 1)
            out[odd] = self._looked_up(self.powers[k].ravel(), 0, out[odd])
            far, k = far >> 1, k + 1
        return out


class Runs:
    """Bucket of every run of one to n words in chunks of documents."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.shifts = n, np.uint32(buckets), Shifts()

    def chunks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document of each new word, document of each run, bucket of each run) for chunks of the texts."""
        words: list[bytes] = []
        spans: list[tuple[int, int, int]] = []  # document, words, words carried over from its last stretch
        held = 0
        for doc, text in enumerate(texts):
            carried: list[bytes] = []
            for part in segments(text):
                words += carried
                words += part
                spans.append((doc, len(carried) + len(part), len(carried)))
                held += sum(map(len, part))
                carried = (carried + part)[1 - self.n :] if self.n > 1 else []
                if held >= CHUNK_BYTES:
                    yield self._runs(words, spans)
                    words, spans, held = [], [], 0
        if words:
            yield self._runs(words, spans)

    def _runs(self, words: list[bytes], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs, counts, carried = np.array(spans, np.int64).T
        span = np.repeat(np.arange(len(docs)), counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = place >= carried[span]
        after = np.fromiter(accumulate(words, lambda c, w: crc32(b" " + w, c), initial=0), np.uint32, len(words) + 1)
        before = self.shifts.blank(after)  # as of the blank in front of each word
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]]) + 1
        owners, found = [], []
        for size in range(1, min(self.n, len(words)) + 1):
            first, last = np.arange(len(words) - size + 1), np.arange(size - 1, len(words))
            keep = (span[first] == span[last]) & new[last]
            first, last = first[keep], last[keep]
            crcs = after[last + 1] ^ self.shifts.by(before[first], ends[last] - starts[first])
            owners.append(docs[span[last]])
            found.append((crcs % self.buckets).astype(np.int64))
        return docs[span[new]], np.concatenate(owners), np.concatenate(found)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, c: how often the runs of `text` fall into each bucket; every task sums its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = Runs(n, buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", 4 * CHUNK_BYTES):
            for _, _, found in runs.chunks(batch.column("text").to_pylist()):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "c"])

    return texts.select("text").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """A gain for each bucket. The rows collected are at most two for each bucket."""
    counts = np.zeros((2, buckets), np.int64)
    sides = [bucket_counts(df, n, buckets).withColumn("side", F.lit(i)) for i, df in enumerate((docs, target))]
    for bucket, c, side in sides[0].unionByName(sides[1]).collect():
        counts[side, bucket] = c
    (s, t), (s_all, t_all) = counts.tolist(), counts.sum(axis=1).tolist()
    whole = float(s_all + buckets), float(t_all + buckets)
    share = [(t[b] + 1.0) * whole[0] / ((s[b] + 1.0) * whole[1]) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def weigh(texts: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of `texts`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(n, len(gains))
        for batch in slices(batches, "text", 4 * CHUNK_BYTES):
            words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for word_docs, run_docs, found in runs.chunks(batch.column("text").to_pylist()):
                words += np.bincount(word_docs, minlength=len(words))
                features += np.bincount(run_docs, minlength=len(words))
                # Sums of integers far below 2^53 are exact in doubles.
                sums += np.bincount(run_docs, gains[found], len(words)).astype(np.int64)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            columns = [batch.column("doc_id"), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """`rows` with `rank` (from 1, by falling `score`, then `doc_id`; null beyond `most`).

    Scores are cut into ranges that tasks sort alone; a row's rank is its range's start plus its place there.
    Rows that tie in both columns are spread by the task they come from.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_from")]
    placed = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the place there in the lower 33.
    placed = written(placed.drop("_from").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    rank = F.col("_start") + place + 1
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each partition
    return out.withColumn("rank", F.when(rank <= most, rank)).drop("_at", "_part", "_start")


def importance_ranks(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank; `rank` is null where it is not drawn.

    Words are maximal runs of ASCII letters and digits, A-Z in lower case, and of characters beyond ASCII. Null and
    empty texts, and those without a word, have weight 0. Documents of fewer than `min_words` words are never drawn.
    Whole texts count; very long ones are scanned stretch by stretch. Of N documents left, floor(percent * N / 100) with the highest
    scores are drawn, ties to the smaller doc_id, null ids last; repeated rows are rows of their own and tie in any order.
    An empty target makes all gains depend on the corpus alone. Other columns are not read.
    """
    texts = id_and_text(docs)
    gains = bucket_gains(texts, target.select(F.coalesce("text", F.lit("")).alias("text")), n, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = written(weigh(texts, gains, n).withColumn("score", F.col("weight") + noise), "importance")
    eligible = F.col("n_words") >= min_words
    # Whole scores differ by some 10^5 at most, as logarithms of counts do, so this table is short at any size.
    counts = scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy(F.desc("score")))
    most = F.expr(f"sum(c) over () * {percent} div 100")
    first = counts.select("score", (upto - F.col("c")).alias("above"), most.alias("most")).filter("above < most")
    cut, drawn = first.agg(F.min("score"), F.max("most")).first()
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = eligible & (F.col("score") >= cut)
    rest = scored.filter(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.filter(inside), drawn).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs`, columns unchanged. Rows that repeat an id stay if one of them is drawn; null ids never do."""
    drawn = importance_ranks(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn"))
    return docs.join(drawn, docs["doc_id"].cast("long") == F.col("__drawn"), "left_semi")
