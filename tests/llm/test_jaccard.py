import random

import numpy as np
import pytest
from helpers import EDGE_ROWS, docs_of, documents, edge_docs, empty_docs

from swathgrid.llm.common import Drafts
from swathgrid.llm.jaccard import Bands, drop_near_duplicates, jaccard_components, keys_of
from swathgrid.llm.shingles import parities


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(i, j) for own in where.values() for i in own for j in own if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("num", [50, 65, 80, 90, 95])
def test_linked_sets_share_a_key(num):
    rng, bands = np.random.default_rng(num), Bands(num, 100)
    for trial in range(3000):
        size = int(rng.integers(1, 12 if trial % 2 else 150))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(num / 100, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 4)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < num * (len(a) + len(b) - both):
            continue
        keys = [np.concatenate([keys_of(s, i, int(bands.k[i]) + 1) for i in bands.of(len(s))]) for s in (a, b)]
        assert len(np.intersect1d(*keys)), (len(a), len(b), both)


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(5)
    for size in (0, 1, 3, 40, 400, 4000):
        for _ in range(50):
            a, b = (np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], b[: size // 20]]))
            bits = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))


def mutated(seed, count=160):
    rng, out = random.Random(seed), []
    for _ in range(count):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                w = w[rng.randrange(3) :]
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 4, 9, 30, 120, 400]))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 60)])
def test_matches_brute_force(spark, n, num):
    texts = mutated(n)
    assert got(jaccard_components(docs_of(spark, texts), n, num)) == brute(list(enumerate(texts)), n, num, 100)


def test_table(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard_components(docs, 3, 90)) == brute(rows, 3, 90, 100)


def test_chain_under_hot_keys(spark):
    # A chain of near copies: neighbours link, ends do not, and all share most keys.
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join([*(f"c{j}" for j in range(i)), *base[i:]]) for i in range(0, 160, 4)] + [" ".join(base)] * 50
    assert got(jaccard_components(docs_of(spark, texts), 3, 90)) == brute(list(enumerate(texts)), 3, 90, 100)


def test_edges(spark):
    assert got(jaccard_components(edge_docs(spark), 3, 90)) == brute([r[:2] for r in EDGE_ROWS], 3, 90, 100)
    assert jaccard_components(empty_docs(spark)).count() == 0
    assert drop_near_duplicates(empty_docs(spark)).count() == 0
    kept = drop_near_duplicates(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_last_round_finds_the_links_that_leads_miss(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for family in range(12):
        own = base[:40] + [f"f{family}x{i}" for i in range(12)]
        for _ in range(5):
            texts.append(" ".join(w for w in own if rng.random() > 0.02))
    rows = list(enumerate(texts))
    assert got(jaccard_components(docs_of(spark, texts), 3, 80, 100)) == brute(rows, 3, 80, 100)


def test_shuffle_files_and_sets_go_on_the_way(spark, monkeypatch):
    """Neither piles up on disk: a table's shuffle files go when it is written, sets are made for nodes of candidate pairs only."""
    kept = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n"))
    files = lambda: {x for x in kept().split("\n") if "/shuffle_" in x}
    made, before, write = {}, files(), Drafts.written

    def written(self, df, name):
        out = write(self, df, name)
        made.setdefault(name, []).append({r.node for r in out.select("node").collect()} if name in ("link-sets", "link-used", "link-facts") else None)
        assert not files() - before, name
        return out

    monkeypatch.setattr(Drafts, "written", written)
    drop_near_duplicates(documents(spark, "/root/testdata/sf0.01"))
    assert made["link-sets"] == made["link-used"] and made["link-sets"][0] < made["link-facts"][0]
    assert not files() - before
