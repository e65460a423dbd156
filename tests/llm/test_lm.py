import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from helpers import EDGE_ROWS, documents, edge_docs, empty_docs

from swathgrid.llm import lm


def brute(rows, fold=10):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    out_of = [crc32(str("" if d is None else d).encode()) % fold == 0 for d, _ in rows]
    c = Counter(w for (_, ws), h in zip(tokens, out_of, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, base(ws)) for (d, ws), h in zip(tokens, out_of, strict=True)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert math.isfinite(g[6]) and g[6] <= 0


def test_base_is_exact_and_model_beats_it_on_held_out_texts(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = lm.score_texts(docs).collect()
    same(got, brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert np.sum([r.score for r in held]) > 0.85 * np.sum([r.base_score for r in held])


def test_class_probabilities_sum_to_one():
    w = np.random.default_rng(0).normal(size=(lm.ROWS, lm.CLASSES)).astype("f4")
    logs = lm.log_probabilities(w, lm.features(np.array([0, 5 << 16 | 7 << 8 | 9])))
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)


def test_words_of_a_class_sum_to_one():
    # 3 words seen once and unseen ones in sign 2; words of sign 2 seen 4 and 6 times.
    once, often = np.zeros(16, int), np.zeros(16, int)
    once[2], often[2] = 3, 10
    voc = lm.Vocabulary(13, 5, np.zeros(0, np.uint64), np.zeros(0, int), once, often, 0.25)
    counts, signs = np.array([1, 1, 1, 0, 4, 6]), np.full(6, 2)
    classes = voc.classes(np.full(6, -1), counts, signs)
    p = 10 ** voc.within(classes, counts, signs)
    assert p[:4].sum() == pytest.approx(1) and p[4:].sum() == pytest.approx(1)


def test_edges(spark):
    same(lm.score_texts(edge_docs(spark), rounds=3).collect(), brute([r[:2] for r in EDGE_ROWS]))
    assert lm.score_texts(empty_docs(spark), rounds=2).count() == 0
    only_held = edge_docs(spark).limit(4)
    got = lm.score_texts(only_held, fold=1, rounds=2).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in got)


def test_word_features_keep_a_class_at_one_and_meet_their_counts():
    """Events of one class of 40 often words: brute-force softmax of each history, and counts less the discount come back."""
    rng = np.random.default_rng(1)
    codes, counts = rng.choice(2**20, 40, replace=False).astype("u8") + 1, rng.integers(2, 50, 40)
    tail, often = lm.SIGNS + 3, np.zeros(16, int)
    often[3] = counts.sum()
    shares = np.zeros((2 * lm.SIGNS, lm.BUCKETS))
    np.add.at(shares[tail], (codes % lm.BUCKETS).astype(int), counts / counts.sum())
    voc = lm.Vocabulary(1000, 60, np.zeros(0, "u8"), np.zeros(0, int), np.zeros(16, int), often, 0.4, shares)
    factors = lm.skip_factors(voc, rng.integers(0, 200, (lm.SKIPS, 2 * lm.SIGNS, lm.BUCKETS)) * (shares > 0))
    before, word, skip = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(40), np.arange(4), indexing="ij"))
    key = np.uint64(tail) << np.uint64(59) | before.astype("u8") << np.uint64(29) | codes[word] << np.uint64(5) | skip.astype("u8")
    times = np.where((before > 0) & (word % 7 == before), rng.integers(0, 4, len(key)), 0)
    sort = np.argsort(key)
    p = np.empty(len(key))
    p[sort] = 10 ** lm.scaled(key[sort], times[sort], counts[word][sort], voc, factors, 60)
    assert np.allclose(np.bincount(before * 4 + skip, p), 1)
    met = np.bincount(before * 40 + word, times)
    expected = np.bincount(before * 40 + word, p * np.bincount(before * 4 + skip, times)[before * 4 + skip])
    assert np.allclose(expected[met > 0], met[met > 0] - 0.4, rtol=1e-2)
    # Without a seen pair only the skip group tells.
    own = before == 0
    want = counts / counts.sum() * factors[:4, tail][:, (codes % lm.BUCKETS).astype(int)]
    assert np.allclose(p[own], want[skip[own], word[own]])


def test_pairs_of_words_outside_the_heads_are_learned(spark):
    heads = [f"h{i}" for i in range(120)] * 30
    first, second = [f"a{i}ing" for i in range(60)], [f"b{i}ing" for i in range(60)]
    texts = [" ".join(heads)] + [f"{a} {b}" for a, b in zip(first, second, strict=True)] * 4
    held = [i for i in range(1000) if crc32(str(i).encode()) % 10 == 0][:2]
    rows = list(zip((i for i in range(1000) if crc32(str(i).encode()) % 10), texts, strict=False))
    pairs = " ".join(f"{a} {b}" for a, b in zip(first, second, strict=True))
    swapped = " ".join(f"{a} {b}" for a, b in zip(first, second[1:] + second[:1], strict=True))
    docs = spark.createDataFrame([*rows, (held[0], pairs), (held[1], swapped)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    assert got[held[0]].held_out and got[held[1]].held_out
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 30  # before, only classes counted: equal scores
