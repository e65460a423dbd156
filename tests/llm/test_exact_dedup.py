from collections import defaultdict

import pytest
from helpers import EDGE_ROWS, docs_of, documents, edge_docs, empty_docs

from swathgrid.llm.exact_dedup import directory, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,capacity", [(64, 8192), (16, 20), (15, 1)])
def test_matches_brute_force_with_splits_and_collisions(spark, bits, capacity):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r)[:4] for r in exact_dedup(docs, key_bits=bits, capacity=capacity).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_edges(spark):
    got = [tuple(r)[:4] for r in exact_dedup(edge_docs(spark)).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in EDGE_ROWS])
    assert exact_dedup(empty_docs(spark)).count() == 0


def test_colliding_keys_stay_apart(spark):
    # With 14-bit keys, 40,000 texts collide; bytes still tell them apart.
    docs = docs_of(spark, [f"text {i % 20000}" for i in range(40_000)])
    out = exact_dedup(docs, key_bits=14, capacity=16)
    assert out.filter("group_size = 2").count() == 40_000


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i,) for i in [*range(64), 1 << 13]], "h long")
    cells = directory(keys, key_bits=14, capacity=8, max_depth=14).collect()
    assert {c.held <= 8 for c in cells} == {True}
    depths = {c.cell: c.depth for c in cells}
    assert depths[1 << 13] == 1 and depths[0] == 11
