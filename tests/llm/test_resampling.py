import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from helpers import EDGE_ROWS, SF, docs_of, documents, edge_docs, empty_docs

from swathgrid.llm import resampling
from swathgrid.llm.resampling import Runs, Shifts, importance_ranks, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, n):
    ws = WORD.findall(lower(text))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def buckets_of(text, n, buckets):
    return [crc32(f.encode()) % buckets for f in features(text, n)[1]]


def brute(rows, target, n=2, buckets=10_000, min_words=20, percent=25, seed=7):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in buckets_of(text, n, buckets):
                counts[b] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)
    ]
    out = []
    for doc_id, text in rows:
        found = buckets_of(text, n, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(features(text, 1)[0])])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_shifts_cancel_prefixes():
    rng, shifts = random.Random(1), Shifts()
    for size in (0, 1, 2, 63, 64, 65, 127, 1000, 70_001):
        p, q = rng.randbytes(rng.randrange(50)), rng.randbytes(size)
        one = shifts.by(np.array([crc32(p)], np.uint32), np.array([size]))
        assert crc32(p + q) ^ int(one[0]) == crc32(q)


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_runs_across_stretches(n, chunk, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(resampling.segments, "__defaults__", (chunk,))
    texts = ["", None, "One, two;two THREE", "é" * 90, " . ", " ".join(f"w{i % 7}" for i in range(300)), "x", "中文 a1 中文"]
    per = [[] for _ in texts]
    words = [0] * len(texts)
    for word_docs, docs, found in Runs(n, 997).chunks(texts):
        for d in word_docs.tolist():
            words[d] += 1
        for d, b in zip(docs.tolist(), found.tolist(), strict=True):
            per[d].append(b)
    assert [sorted(p) for p in per] == [sorted(buckets_of(t, n, 997)) for t in texts]
    assert words == [len(features(t, 1)[0]) for t in texts]


def test_table(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute(rows, [r.text for r in target.collect()])
    assert got(importance_ranks(documents(spark), target)) == want
    assert sum(r[4] is not None for r in want) > 10
    chosen = resample(documents(spark), target)
    assert sorted(r.doc_id for r in chosen.collect()) == sorted(r[0] for r in want if r[4] is not None)
    assert chosen.columns == documents(spark).columns


def test_ties_and_repeats(spark):
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(25)) for i in range(40)]
    rows = [(i // 3, t) for i, t in enumerate(texts)] + [(99, texts[0])] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs_of(spark, ["w1 w2 w3", None, ""])
    result = got(importance_ranks(docs, target, percent=60))
    want = brute(rows, ["w1 w2 w3", None, ""], percent=60)
    # Equal rows may take each other's rank, and so may rows of one id and score.
    assert sorted(r[:4] for r in result) == sorted(r[:4] for r in want)
    assert sorted((r[4], r[0], r[3]) for r in result if r[4]) == sorted((r[4], r[0], r[3]) for r in want if r[4])


def test_edges(spark):
    target = docs_of(spark, ["alpha beta gamma"])
    rows = [r[:2] for r in EDGE_ROWS]
    for percent in (25, 100):
        result = importance_ranks(edge_docs(spark), target, min_words=1, percent=percent)
        assert got(result) == brute(rows, ["alpha beta gamma"], min_words=1, percent=percent)
    assert got(importance_ranks(edge_docs(spark), empty_docs(spark))) == brute(rows, [])
    assert importance_ranks(empty_docs(spark), target).count() == 0
    assert resample(empty_docs(spark), empty_docs(spark)).count() == 0
