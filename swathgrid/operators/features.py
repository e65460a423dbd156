"""Pooled features, alignment score, reconstruction error and probes on feature tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEMPERATURE = 0.07


def group_pairs(available: DataFrame, groups: list[str]) -> DataFrame:
    """All pairs of groups both present in a sample (map ``has_group``). Seven groups, 21 pairs."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in combinations(groups, 2)]
    )
    return (
        available.withColumn("p", F.explode(pairs))
        .select("sample_id", "has_group", "p.*")
        .where(F.col("has_group")[F.col("g1")] & F.col("has_group")[F.col("g2")])
        .select("sample_id", "g1", "g2")
    )


def _token_means(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean of token vectors per key; whole vectors are summed, none is exploded."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))))
    return tokens.groupBy(*keys).agg(mean.alias("vec"), F.bool_or("available").alias("available"))


def pool_groups(tokens: DataFrame) -> DataFrame:
    """Mean over the tokens of a group, then over the available groups of a sample (seven at most).

    ``tokens``: sample_id, group_name, available, vec. A sample without any group has zeros.
    """
    groups = _token_means(tokens, ["sample_id", "group_name"])
    per_sample = groups.groupBy("sample_id").agg(
        F.collect_list(F.when(F.col("available"), F.col("vec"))).alias("vecs"),
        F.max(F.size("vec")).alias("dims"),
    )
    zeros = F.array_repeat(F.lit(0.0), F.col("dims"))
    total = F.aggregate("vecs", zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    n = F.greatest(F.size("vecs"), F.lit(1))
    return per_sample.withColumn("n", n).withColumn("total", total).select(
        "sample_id", F.transform("total", lambda x: x / F.col("n")).alias("vec")
    )


def pool_valid_tokens(tokens: DataFrame) -> DataFrame:
    """L2-normalised mean of the valid tokens per (batch, sample, group).

    Groups without any valid token are left out.
    """
    pooled = _token_means(tokens.where("available"), ["batch_id", "sample_id", "group_name"])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return pooled.withColumn("_n", F.greatest(norm, F.lit(1e-12))).select(
        "batch_id",
        "sample_id",
        "group_name",
        F.transform("vec", lambda x: x / F.col("_n")).alias("vec"),
    )


def alignment_scores(pooled: DataFrame, groups: list[str], batch_size: int) -> DataFrame:
    """Symmetric contrastive loss per (batch, group pair).

    A batch is a fixed number of samples by construction, so its similarity matrices are small
    and are formed as matrix products inside one grouped call.
    """
    order = {g: i for i, g in enumerate(groups)}

    def score(key, table):
        batch = key[0].as_py()
        vectors: dict[str, dict] = {}
        for s, g, v in zip(
            table["sample_id"].to_pylist(), table["group_name"].to_pylist(), table["vec"], strict=True
        ):
            vectors.setdefault(g, {})[s] = v.values.to_numpy(zero_copy_only=False)
        if len({s for members in vectors.values() for s in members}) > batch_size:
            raise ValueError(f"batch {batch} holds more than {batch_size} samples")
        rows = []
        for a, b in combinations(sorted(vectors, key=order.get), 2):
            both = sorted(vectors[a].keys() & vectors[b].keys())
            if len(both) < 2:
                continue
            sim = np.array([vectors[a][s] for s in both]) @ np.array([vectors[b][s] for s in both]).T
            sim = sim / TEMPERATURE
            top1, top2 = sim.max(1, keepdims=True), sim.max(0, keepdims=True)
            lse1 = np.log(np.exp(sim - top1).sum(1)) + top1[:, 0]
            lse2 = np.log(np.exp(sim - top2).sum(0)) + top2[0]
            diagonal = np.diag(sim)
            loss = ((lse1 - diagonal).mean() + (lse2 - diagonal).mean()) / 2
            rows.append((batch, a, b, len(both), float(loss)))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
        return pa.table(
            {
                "batch_id": pa.array(cols[0], pa.int64()),
                "g1": pa.array(cols[1], pa.string()),
                "g2": pa.array(cols[2], pa.string()),
                "n_samples": pa.array(cols[3], pa.int32()),
                "loss": pa.array(cols[4], pa.float64()),
            }
        )

    return pooled.groupBy("batch_id").applyInArrow(
        score, "batch_id bigint, g1 string, g2 string, n_samples int, loss double"
    )


def alignment_by_batch(scores: DataFrame) -> DataFrame:
    return scores.groupBy("batch_id").agg(
        F.avg("loss").alias("alignment"), F.count(F.lit(1)).alias("n_pairs")
    )


def masked_error(elements: DataFrame, mask: DataFrame) -> DataFrame:
    """Reconstruction error per (batch, group) on masked patches of available groups.

    ``elements``: batch_id, sample_id, group_name, patch, target, pred; ``mask``: sample_id,
    group_name, patch, visible, available. A patch counts by its share of non-zero targets.
    """
    per_patch = elements.groupBy("batch_id", "sample_id", "group_name", "patch").agg(
        F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))).alias("mse"),
        F.avg((F.abs("target") > 1e-8).cast("int")).alias("share"),
    )
    hidden = mask.where(~F.col("visible") & F.col("available")).select("sample_id", "group_name", "patch")
    used = per_patch.join(hidden, ["sample_id", "group_name", "patch"])
    return used.groupBy("batch_id", "group_name").agg(
        (F.sum(F.col("mse") * F.col("share")) / F.greatest(F.sum("share"), F.lit(1.0))).alias("loss"),
        F.count(F.lit(1)).alias("n_patches"),
    )


def weighted_loss(group_losses: DataFrame) -> DataFrame:
    """Loss-proportional mean over the groups of a batch (seven at most)."""
    batch = W.partitionBy("batch_id")
    raw = F.greatest(F.col("loss"), F.lit(1e-6))
    weight = raw / F.sum(raw).over(batch) * F.count(F.lit(1)).over(batch)
    return (
        group_losses.withColumn("weight", weight)
        .groupBy("batch_id")
        .agg(F.sum(F.col("weight") * F.col("loss")).alias("loss"), F.count(F.lit(1)).alias("n_groups"))
    )


# ---- probes --------------------------------------------------------------------------------


def _vectors(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    return df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))


def classify(
    train: DataFrame, test: DataFrame, label: str, key: str, vec: str = "vec", hidden: bool = False,
    dims: int | None = None, classes: int | None = None, seed: int = 42,
) -> DataFrame:
    """Linear or one-hidden-layer classifier on features; returns key, target, pred."""
    fit = _vectors(train.withColumn("label", F.col(label).cast("double")), vec, "label")
    if hidden:
        model = MultilayerPerceptronClassifier(layers=[dims, dims // 2, classes], maxIter=60, seed=seed)
    else:
        model = LogisticRegression(maxIter=60, regParam=1e-3)
    scored = model.fit(fit).transform(_vectors(test, vec, key, label))
    return scored.select(
        key, F.col(label).cast("int").alias("target"), F.col("prediction").cast("int").alias("pred")
    )


def regress(train: DataFrame, test: DataFrame, targets: list[str], key: str, vec: str = "vec") -> DataFrame:
    """One linear model per target on the same features; rows (key, target_name, target, pred)."""
    out = None
    for name in targets:
        fit = _vectors(train.withColumn("label", F.col(name).cast("double")), vec, "label")
        scored = LinearRegression(regParam=1e-3).fit(fit).transform(_vectors(test, vec, key, name))
        part = scored.select(
            key,
            F.lit(name).alias("target_name"),
            F.col(name).cast("double").alias("target"),
            F.col("prediction").alias("pred"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def patch_features(stats: DataFrame) -> DataFrame:
    """Per-patch channel statistics (mean, std, p10, p90, valid share) as a feature table."""
    return stats.select(
        "channel",
        "tile_row",
        "tile_col",
        F.array("mean", "std", "p10", "p90", "valid_fraction").alias("vec"),
    )
