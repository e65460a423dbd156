import numpy as np
import pytest

from swathgrid.llm.topk import CoverTree, dots, top_k


def brute(rows, every, k, scale):
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit.setdefault(i, set()).add(tuple(int(np.floor(scale * x)) for x in v))
    out = []
    for q, vs in fit.items():
        if q % every:
            continue
        v = min(vs)
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, ws in fit.items() if i != q for w in ws if len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell long"


@pytest.mark.parametrize("block_rows,task_queries", [(4096, 50_000), (60, 7)])
def test_matches_brute_force(spark, block_rows, task_queries):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + 4 * (i % 5 == 0)).astype("f4").tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(200)]  # a third are one vector: ties
    rows += [(900, None), (None, [1.0] * 8), (920, [float("nan")] * 8), (940, [None] * 8), (960, [])]
    rows += [(980, [1.0, 2.0]), (981, [0.5, 2.0]), (1000, rows[0][1]), (1000, rows[0][1]), (1000, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA)
    got = top_k(docs, 20, 7, cells=8, sample=100, block_rows=block_rows, task_queries=task_queries)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 7, 64.0)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cover_tree_covers_its_points():
    x = np.random.default_rng(0).normal(size=(700, 3))
    x[100:200] = x[0]
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(700))
    for n in range(len(tree.centre)):
        own = tree.points[tree.begin[n] : tree.end[n]]
        assert np.sqrt(((own - tree.centres[n]) ** 2).sum(1)).max() <= tree.radii[n] + 1e-12
        assert sum(tree.end[c] - tree.begin[c] for c in tree.children[n]) in (0, len(own))


def test_products_beyond_float_precision_are_exact():
    a = np.array([[2.0**40, 1.0]])
    assert dots(a, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1
