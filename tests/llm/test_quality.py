import numpy as np
from helpers import documents, edge_docs, empty_docs

from swathgrid.llm.quality import Features, drop_rejected, fit, score_quality, training_labels

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from swathgrid.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op1_quality"][0](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_votes_equal_brute_force(spark):
    docs = documents(spark, SF)
    labels = training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    model = fit(docs, labels)
    x = Features().matrix([r.text for r in docs.select("text").limit(40).collect()])
    z = x @ model.basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for got, row in zip(model.scores(x, block=50), z, strict=True):
        sims = model.vectors @ row
        top = np.argsort(-sims)[: model.k]
        w = np.maximum(sims[top], 0).astype(float) ** 8
        assert abs(got - (w * model.labels[top]).sum() / w.sum()) < 1e-3


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(edge_docs(spark), labels).count() == 10
    assert score_quality(empty_docs(spark), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in score_quality(edge_docs(spark), none).collect()} == {0.5}
    assert drop_rejected(edge_docs(spark), none).count() == 10
    kept = drop_rejected(edge_docs(spark), labels)
    assert kept.columns == edge_docs(spark).columns and kept.count() <= 10
    assert drop_rejected(empty_docs(spark), labels).count() == 0
