"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import Drafts
from swathgrid.sources.workspace import written


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node with a link. Columns of `links`: a, b.

    Every round takes the smallest label among neighbours, then the label of the label, so chains
    shrink by more than half; each round is a written table, and one table is left at the end. Minima combine before the shuffle, so a node with very many
    links costs a task no more rows than it has itself.
    """
    drafts = Drafts()
    edges = drafts.written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    labels = drafts.written(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = (
            labels.join(near.withColumnRenamed("a", "node"), "node")
            .select("node", F.least("comp", "near").alias("next"), (F.col("near") < F.col("comp")).alias("moved"))
        )
        step = drafts.written(step, "labels")
        if step.filter("moved").isEmpty():
            found = written(step.select("node", F.col("next").alias("comp")), "components")
            drafts.drop()
            return found
        up = step.select(F.col("node").alias("next"), F.col("next").alias("comp"))
        labels = drafts.written(step.join(up, "next").select("node", "comp"), "labels")
