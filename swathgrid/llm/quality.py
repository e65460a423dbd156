"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of its words, word shapes and endings, and a few shares that show
repetition. The space is the leading right singular vectors of the labelled sample's matrix. The labelled
vectors are broadcast: their number is bounded by `per_class`. Every document then gets exact cosine
products with all of them, in blocks, and the k nearest vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import crc_mod, id_and_text

WORDS, SHAPES, ENDINGS, SHARES = 1024, 512, 512, 16
WIDTH = WORDS + SHAPES + ENDINGS + SHARES
_KIND = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 else ord("0") if 48 <= b <= 57 else b if b < 128 else ord("u")
    for b in range(256)
)


def shape(word: bytes) -> bytes:
    """The word's kinds of characters with runs cut to one, its length in powers of two."""
    kinds = word[:64].translate(_KIND)
    runs = bytes(b for i, b in enumerate(kinds) if i == 0 or b != kinds[i - 1])
    return runs[:12] + b"%d" % len(word).bit_length()


class Features:
    """Feature vectors of texts; columns of each distinct word are kept until the store is full."""

    def __init__(self, most: int = 200_000):
        self.most, self.known, self.columns = most, {}, []

    def _column(self, word: bytes) -> tuple[int, int, int]:
        low = word.lower()
        return (
            zlib.crc32(low) % WORDS,
            WORDS + zlib.crc32(shape(word)) % SHAPES,
            WORDS + SHAPES + zlib.crc32(low[-3:]) % ENDINGS,
        )

    def matrix(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
            self.columns.clear()
        known, columns = self.known, self.columns
        out = np.zeros((len(texts), WIDTH), np.float32)
        for row, text in zip(out, texts, strict=True):
            split = text.encode("utf-8", "surrogatepass").split()
            if not split:
                continue
            for w in set(split):
                if w not in known:
                    known[w] = len(columns)
                    columns.append(self._column(w))
            ids = np.fromiter(map(known.__getitem__, split), np.int64, len(split))
            distinct, counts = np.unique(ids, return_counts=True)
            at = np.array([columns[i] for i in distinct])
            hist = np.bincount(at.ravel(), np.repeat(counts, 3), WIDTH)
            row[:] = np.log1p(hist)
            row[: WIDTH - SHARES] /= max(np.linalg.norm(row[: WIDTH - SHARES]), 1e-9)
            # Shares that show repetition: distinct words, adjacent equal words, the commonest word.
            repeated = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0.0
            shares = len(distinct) / len(ids), repeated, counts.max() / len(ids)
            row[WIDTH - SHARES : WIDTH - SHARES + 3] = [0.3 * s for s in shares]
        return out


@dataclass(frozen=True)
class Model:
    basis: np.ndarray  # WIDTH x rank
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float
    k: int

    def scores(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """Weighted votes; a text without any word has no neighbours and gets the prior."""
        z = _unit(x @ self.basis)
        best_sim = np.full((len(z), self.k), -np.inf, np.float32)
        best_lab = np.zeros((len(z), self.k), np.float32)
        for s in range(0, len(self.vectors), block):
            sims = z @ self.vectors[s : s + block].T
            sims = np.concatenate([best_sim, sims], axis=1)
            labs = np.concatenate([best_lab, np.broadcast_to(self.labels[s : s + block], (len(z), sims.shape[1] - self.k))], axis=1)
            top = np.argpartition(-sims, self.k - 1, axis=1)[:, : self.k]
            best_sim, best_lab = np.take_along_axis(sims, top, 1), np.take_along_axis(labs, top, 1)
        weight = np.where(np.isfinite(best_sim), np.maximum(best_sim, 0), 0).astype(np.float64) ** 8
        total = weight.sum(1)
        votes = (weight * best_lab).sum(1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` labelled ids of either class, by hash order: the bound of all that is learned.

    A document with several label rows counts as good only if none says otherwise.
    """
    clean = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    parts = [
        clean.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1536, rank: int = 64, k: int = 15) -> Model | None:
    """The model from labelled documents, or None where there are none of them."""
    sample = F.broadcast(labelled_sample(labels, per_class))  # 2 * per_class rows of two numbers

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            x = make.matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())],
                names=["doc_id", "quality", "x"],
            )

    rows = (
        id_and_text(docs)
        .join(sample, "doc_id")
        .select("doc_id", "text", "quality")
        .mapInArrow(features, "doc_id long, quality int, x binary")
        # Rows that repeat an id add nothing; this keeps the sample within its bound.
        .groupBy("doc_id")
        .agg(F.min(F.struct("x", "quality")).alias("row"))
        .select("doc_id", "row.x", "row.quality")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    y = np.array([r["quality"] for r in rows], np.float32)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
    return Model(basis, _unit(x @ basis), y, float(y.mean()), k)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1536, rank: int = 64, k: int = 15) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier).

    Only the text is an input of a score; labels are read for fitting alone, from `labels` as
    given, at most 2 * per_class of them. Whole texts count, however long. Null text is empty; texts
    without words get the learned sample's share of label 1, and 0.5 goes to all if nothing is
    labelled. Repeated rows get equal scores, ids may be null, other columns are not read.
    """
    model = fit(docs, labels, per_class, rank, k)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, learned = Features(), shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                if learned is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    score = learned.scores(make.matrix(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score.astype(np.float64))], names=["doc_id", "score"]
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents outside the held-out fold."""
    return labels.filter(crc_mod(F.col("doc_id"), 3) != 1)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores at least `threshold`, all columns unchanged.

    The row itself is filtered, so null and repeated ids need no join.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make, learned = Features(), shared.value
        for texts in batches:
            texts = texts.fillna("").tolist()
            parts = [learned.scores(make.matrix(texts[i : i + 512])) for i in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) >= threshold if parts else np.zeros(0, bool))

    return docs.filter(keep(F.col("text")))
