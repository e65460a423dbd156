import zlib

import corpus_pipeline
from helpers import SF
from test_jaccard import brute as near_brute
from test_line_dedup import brute as line_brute
from test_packing import check

from swathgrid.llm.pii import masked


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = docs = stage(spark, docs, sf).cache()
        if name != "packing":
            assert docs.columns == columns
    text = {k: {r.doc_id: r.text for r in v.collect()} for k, v in steps.items() if k != "packing"}
    assert text["lines"] == line_brute(list(text["quality"].items()), long_docs=2)
    groups = near_brute(list(text["lines"].items()), 5, 80, 100)
    assert set(text["near_duplicates"]) == {i for i, _, c in groups if i == c}
    assert text["personal_data"] == {i: masked(t) for i, t in text["near_duplicates"].items()}
    rows = steps["packing"].collect()
    check(rows, list(text["personal_data"].items()), 4096)
    assert all(zlib.crc32(r["ids"]) == r.ids_crc32 for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in text["quality"] for i in good) > 0.98 * len(good)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "sequence_id" in out.columns and out.count() > 0
