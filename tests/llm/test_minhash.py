import random

import numpy as np
import pytest
from helpers import EDGE_ROWS, docs_of, documents, edge_docs, empty_docs
from test_jaccard import brute, mutated, shingles

from swathgrid.llm.minhash import Halves, near_duplicate_classes


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_halves_agree_as_often_as_sets_are_alike():
    rng, halves = np.random.default_rng(1), Halves(10, 3)
    met = []
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 160, dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for _ in range(2)]
        a, b = halves.of(np.concatenate(sets), np.array([0, len(sets[0])]))
        same = a == b
        met.append((same.mean(), same[:10].any() and same[10:].any()))
    assert abs(np.mean([m for m, _ in met]) - 0.8**3) < 0.03
    assert np.mean([m for _, m in met]) > 0.99


@pytest.mark.parametrize("n,num", [(4, 80), (1, 90)])
def test_matches_brute_force(spark, n, num):
    texts = mutated(n)
    assert got(near_duplicate_classes(docs_of(spark, texts), n, num)) == brute(list(enumerate(texts)), n, num, 100)


def test_table(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = near_duplicate_classes(docs, 4, 80)
    assert got(found) == brute(rows, 4, 80, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_recall_at_the_threshold(spark):
    # Pairs whose sets are barely alike enough: nearly all of them must be found.
    rng, texts, pairs = random.Random(7), [], 0
    while pairs < 400:
        words = [f"a{rng.randrange(10**6)}" for _ in range(160)]
        other = words[:]
        for at in (20, 60, 100, 140):
            other[at] = f"b{rng.randrange(10**6)}"
        a, b = shingles(" ".join(words), 4), shingles(" ".join(other), 4)
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        texts += [" ".join(words), " ".join(other)]
        pairs += 1
    found = {r.doc_id: r.component_id for r in near_duplicate_classes(docs_of(spark, texts), 4, 80).collect()}
    assert sum(found[i] == found[i + 1] for i in range(0, 800, 2)) >= 0.98 * pairs


def test_group_without_a_middle(spark):
    # Neighbours of a ring link and others do not, though all share table keys; half the rows are copies.
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join([*(f"c{j}" for j in range(i)), *base[i:]]) for i in range(0, 240, 12)] + [" ".join(base)] * 20
    assert got(near_duplicate_classes(docs_of(spark, texts), 4, 80)) == brute(list(enumerate(texts)), 4, 80, 100)


def test_star(spark):
    # Every text links with the middle one and hardly any with another.
    rng = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(80):
        w = base[:]
        for at in rng.sample(range(0, 296, 8), 7):
            w[at] = f"x{i}-{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    assert got(near_duplicate_classes(docs_of(spark, texts), 4, 80)) == brute(list(enumerate(texts)), 4, 80, 100)


def test_edges(spark):
    assert got(near_duplicate_classes(edge_docs(spark), 4, 80)) == brute([r[:2] for r in EDGE_ROWS], 4, 80, 100)
    assert near_duplicate_classes(empty_docs(spark)).count() == 0
    alone = docs_of(spark, ["a b c d e", "f g h i j", None])
    assert [r[2] for r in got(near_duplicate_classes(alone))] == [0, 1, 2]
