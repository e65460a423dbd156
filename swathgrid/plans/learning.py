"""Queries on feature tables and predictions: pooling, masks, losses, metrics, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathgrid.constants import GROUP_NAMES
from swathgrid.functions.hashing import hash_int
from swathgrid.functions.labels import is_mare
from swathgrid.functions.values import argmax
from swathgrid.operators import features as E
from swathgrid.operators import metrics as M
from swathgrid.operators import sampling as P
from swathgrid.operators import stats as S
from swathgrid.operators import tiles as T
from swathgrid.operators.ranking import counted_join
from swathgrid.plans.fixtures import TOKENS, dem_grid, fixture, table, tokens
from swathgrid.plans.rasters import layers, off_tie, rounded
from swathgrid.plans.registry import query
from swathgrid.sources.workspace import written

BATCH = 64

TOKENS_SQL = """SELECT vec_id AS sample_id, CAST(FLOOR(vec_id / 64e0) AS BIGINT) AS batch_id, g, group_name, CAST(t AS INT) AS token, CAST(d AS INT) AS dim,
    (vec_id + g) % 5 <> 0 AS available, CAST(embedding[g * 9 + t * 3 + d + 1] AS DOUBLE) AS x
    FROM embeddings CROSS JOIN groups CROSS JOIN range(0, 3) a(t) CROSS JOIN range(0, 3) b(d)"""


@query(
    "group_pool",
    "A21",
    f"""SELECT sample_id, dim, round(sum(CASE WHEN available THEN x ELSE 0 END) / greatest(count(*) FILTER (WHERE available), 1), 6) AS x
    FROM (SELECT sample_id, g, dim, available, avg(x) AS x FROM ({TOKENS_SQL}) t GROUP BY 1, 2, 3, 4) p GROUP BY sample_id, dim""",
)
def group_pool(spark, sf):
    pooled = E.pool_groups(tokens(spark, sf)).select("sample_id", F.posexplode("vec").alias("dim", "x"))
    return rounded(pooled, "x")


@query(
    "group_pairs",
    "J15",
    """SELECT vec_id AS sample_id, a.group_name AS g1, b.group_name AS g2 FROM embeddings JOIN groups a ON (vec_id + a.g) % 5 <> 0
    JOIN groups b ON (vec_id + b.g) % 5 <> 0 AND a.g < b.g""",
)
def group_pairs(spark, sf):
    flags = F.create_map(
        *[x for g, n in enumerate(GROUP_NAMES) for x in (F.lit(n), (F.col("vec_id") + g) % 5 != 0)]
    )
    samples = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), flags.alias("has_group"))
    return E.group_pairs(samples, GROUP_NAMES)


POOLED_SQL = f"""SELECT batch_id, sample_id, g, group_name, list(x ORDER BY dim) AS v, sqrt(sum(x * x)) AS norm
    FROM (SELECT batch_id, sample_id, g, group_name, dim, avg(x) AS x FROM ({TOKENS_SQL}) t WHERE available GROUP BY 1, 2, 3, 4, 5) m GROUP BY 1, 2, 3, 4"""
ALIGN_SQL = f"""
WITH p AS ({POOLED_SQL}),
s AS (SELECT a.batch_id, a.g AS g1, b.g AS g2, a.sample_id AS s1, b.sample_id AS s2,
        (a.v[1] * b.v[1] + a.v[2] * b.v[2] + a.v[3] * b.v[3]) / (a.norm * b.norm) / 7e-2 AS sim
      FROM p a JOIN p b ON a.batch_id = b.batch_id AND a.g < b.g
      WHERE EXISTS (SELECT 1 FROM p c WHERE c.sample_id = a.sample_id AND c.g = b.g) AND EXISTS (SELECT 1 FROM p c WHERE c.sample_id = b.sample_id AND c.g = a.g)),
r AS (SELECT batch_id, g1, g2, s1, ln(sum(exp(sim))) - max(sim) FILTER (WHERE s1 = s2) AS l FROM s GROUP BY 1, 2, 3, 4),
c AS (SELECT batch_id, g1, g2, s2, ln(sum(exp(sim))) - max(sim) FILTER (WHERE s1 = s2) AS l FROM s GROUP BY 1, 2, 3, 4)
SELECT batch_id, x.group_name AS g1, y.group_name AS g2, n_samples, round((l1 + l2) / 2, 6) AS loss
FROM (SELECT batch_id, g1, g2, avg(l) AS l1, CAST(count(*) AS INT) AS n_samples FROM r GROUP BY 1, 2, 3) q
JOIN (SELECT batch_id, g1, g2, avg(l) AS l2 FROM c GROUP BY 1, 2, 3) w USING (batch_id, g1, g2)
JOIN groups x ON x.g = q.g1 JOIN groups y ON y.g = q.g2 WHERE n_samples >= 2"""


def pair_scores(spark, sf):
    return E.alignment_scores(E.pool_valid_tokens(tokens(spark, sf)), GROUP_NAMES, BATCH)


@query("alignment_pairs", "A24", ALIGN_SQL)
def alignment_pairs(spark, sf):
    return rounded(pair_scores(spark, sf), "loss")


@query(
    "alignment_score",
    "A24",
    f"SELECT batch_id, round(avg(loss), 5) AS alignment, CAST(count(*) AS BIGINT) AS n_pairs FROM ({ALIGN_SQL}) a GROUP BY batch_id",
)
def alignment_score(spark, sf):
    return rounded(E.alignment_by_batch(pair_scores(spark, sf)), "alignment", digits=5)


# ---- masks ---------------------------------------------------------------------------------


def availability(spark, sf):
    g = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(n).alias("group_name")) for i, n in enumerate(GROUP_NAMES)])
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(g).alias("s"))
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.floor(F.col("vec_id") / BATCH).cast("bigint").alias("batch_id"),
        "s.group_name",
        ((F.col("vec_id") + F.col("s.g")) % 5 != 0).alias("available"),
    )


AVAILABLE_SQL = """SELECT vec_id AS sample_id, CAST(FLOOR(vec_id / 64e0) AS BIGINT) AS batch_id, group_name, (vec_id + g) % 5 <> 0 AS available FROM embeddings CROSS JOIN groups"""


def mask_sql(source, n, keep):
    return f"""SELECT sample_id, group_name, patch, k <= {keep} AND available AS visible, available FROM (
      SELECT a.*, CAST(p AS INT) AS patch, row_number() OVER (PARTITION BY sample_id, group_name
        ORDER BY md5(concat('42:', CAST(sample_id AS VARCHAR), ':', group_name, ':', CAST(p AS VARCHAR))), p) AS k
      FROM ({source}) a CROSS JOIN range(0, {n}) r(p)) m"""


@query("random_mask", "N5", f"SELECT sample_id, group_name, patch, visible FROM ({mask_sql(AVAILABLE_SQL, 16, 4)}) m")
def random_mask(spark, sf):
    a = availability(spark, sf).drop("batch_id")
    return P.random_mask(a, 16, 0.75)


ANCHOR_SQL = f"""
SELECT batch_id, group_name, cross_on AS "cross", cross_on AND any_available AND turn <= n_anchor AS anchor,
  CASE WHEN cross_on AND any_available AND turn <= n_anchor THEN 0e0 WHEN cross_on THEN 9e-1 ELSE 75e-2 END AS ratio
FROM (SELECT *, CAST('0x' || substr(md5(concat('42:use:', CAST(batch_id AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296e0 < 5e-1
          AND count(*) FILTER (WHERE any_available) OVER (PARTITION BY batch_id) >= 2 AS cross_on,
        1 + CAST('0x' || substr(md5(concat('42:n:', CAST(batch_id AS VARCHAR))), 1, 8) AS BIGINT) % 2 AS n_anchor,
        row_number() OVER (PARTITION BY batch_id, any_available ORDER BY md5(concat('42:', CAST(batch_id AS VARCHAR), ':', group_name)), group_name) AS turn
      FROM (SELECT batch_id, group_name, bool_or(available) AS any_available FROM ({AVAILABLE_SQL}) a GROUP BY 1, 2) g) t"""


@query("complementary_mask", "N6", ANCHOR_SQL)
def complementary_mask(spark, sf):
    return P.anchor_groups(availability(spark, sf), 0.5)


@query(
    "complementary_visible",
    "N6 N5",
    f"""SELECT batch_id, group_name, CAST(sum(CASE WHEN available THEN CASE ratio WHEN 0 THEN 16 WHEN 9e-1 THEN 1 ELSE 4 END ELSE 0 END) AS BIGINT) AS n_visible
    FROM ({AVAILABLE_SQL}) a JOIN ({ANCHOR_SQL}) r USING (batch_id, group_name) GROUP BY 1, 2""",
)
def complementary_visible(spark, sf):
    a = availability(spark, sf)
    ratios = P.anchor_groups(a, 0.5).select("batch_id", "group_name", "ratio")
    masked = P.random_mask(a.join(ratios, ["batch_id", "group_name"]), 16, 0.75, ("batch_id", "sample_id", "group_name"))
    return masked.groupBy("batch_id", "group_name").agg(F.count_if("visible").alias("n_visible"))


def elements(spark, sf):
    """Targets and predictions per element; a token is a patch of three elements."""
    t = tokens(spark, sf).select(
        "batch_id", "sample_id", "group_name", F.col("token").alias("patch"), F.posexplode("vec").alias("pos", "target")
    )
    return t.withColumn("target", F.col("target").cast("double")).withColumn("pred", F.col("target") * 0.9)


TOKEN_MASK = mask_sql(AVAILABLE_SQL, TOKENS, 1)
ERROR_SQL = f"""SELECT batch_id, e.group_name, sum(mse * share) / greatest(sum(share), 1) AS loss, CAST(count(*) AS BIGINT) AS n_patches FROM (
      SELECT batch_id, sample_id, group_name, token, avg((x * 9e-1 - x) * (x * 9e-1 - x)) AS mse, avg(CASE WHEN abs(x) > 1e-8 THEN 1e0 ELSE 0e0 END) AS share
      FROM ({TOKENS_SQL}) t GROUP BY 1, 2, 3, 4) e
    JOIN ({TOKEN_MASK}) k ON e.sample_id = k.sample_id AND e.group_name = k.group_name AND e.token = k.patch
    WHERE NOT visible AND available GROUP BY 1, 2"""


def token_mask(spark, sf):
    a = availability(spark, sf).drop("batch_id")
    return P.random_mask(a, TOKENS, 0.5).join(a, ["sample_id", "group_name"])


@query("masked_error", "A23", f"SELECT batch_id, group_name, round(loss * 1000, 6) AS loss, n_patches FROM ({ERROR_SQL}) q")
def masked_error(spark, sf):
    out = E.masked_error(elements(spark, sf), token_mask(spark, sf))
    return out.withColumn("loss", F.round(F.col("loss") * 1000, 6))


@query(
    "weighted_loss",
    "A23",
    f"""SELECT batch_id, round(1000 * sum(loss * greatest(loss, 1e-6)) / sum(greatest(loss, 1e-6)) * count(*), 6) AS loss, CAST(count(*) AS BIGINT) AS n_groups
    FROM ({ERROR_SQL}) q GROUP BY batch_id""",
)
def weighted_loss(spark, sf):
    out = E.weighted_loss(E.masked_error(elements(spark, sf), token_mask(spark, sf)))
    return out.withColumn("loss", F.round(F.col("loss") * 1000, 6))


@query(
    "blend_display",
    "P27 A33",
    f"""SELECT e.sample_id, e.group_name, token AS patch, CAST(dim AS INT) AS pos, round(CASE WHEN visible THEN x ELSE x * 9e-1 END, 6) AS blended,
    round(CASE WHEN visible THEN x ELSE median END, 6) AS masked_input, round(abs(x - x * 9e-1), 6) AS abs_error
    FROM ({TOKENS_SQL}) e JOIN ({TOKEN_MASK}) k ON e.sample_id = k.sample_id AND e.group_name = k.group_name AND e.token = k.patch
    JOIN (SELECT group_name, quantile_cont(x, 0.5) AS median FROM ({TOKENS_SQL}) t WHERE x <> 0 GROUP BY group_name) m ON m.group_name = e.group_name""",
)
def blend_display(spark, sf):
    e = elements(spark, sf)
    medians = S.display_range(e.withColumnRenamed("target", "value"), ["group_name"])
    masked = e.join(token_mask(spark, sf), ["sample_id", "group_name", "patch"])
    joined = counted_join(masked, medians.select("group_name", "median"), "group_name")
    seen = F.col("visible")
    return joined.select(
        "sample_id",
        "group_name",
        "patch",
        "pos",
        F.round(F.when(seen, F.col("target")).otherwise(F.col("pred")), 6).alias("blended"),
        F.round(F.when(seen, F.col("target")).otherwise(F.col("median")), 6).alias("masked_input"),
        F.round(F.abs(F.col("target") - F.col("pred")), 6).alias("abs_error"),
    )


@query(
    "argmax_class",
    "P26",
    "SELECT vec_id, CAST(list_position(embedding, list_aggregate(embedding, 'max')) - 1 AS INT) AS pred FROM embeddings",
)
def argmax_class(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("pred"))


# ---- few-shot samples ----------------------------------------------------------------------


def shots_sql(n):
    return f"""SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id) AS k
      FROM embeddings) r WHERE k <= {n}"""


@query("few_shot", "N3", shots_sql(5))
def few_shot(spark, sf):
    return P.few_shot(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5)


@query("few_shot_large", "N3", shots_sql(1500).replace("embeddings", "(SELECT l_orderkey * 10 + l_linenumber AS vec_id, l_returnflag AS label FROM lineitem GROUP BY 1, 2)"))
def few_shot_large(spark, sf):
    """More rows per class than Spark's group limit takes: cut by bucketed ranks."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vec_id"), F.col("l_returnflag").alias("label")
    )
    return P.few_shot(rows.distinct(), "label", "vec_id", 1500)


@query(
    "few_shot_union",
    "N8 U1 N3",
    f"""SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM (
      SELECT vec_id FROM ({shots_sql(5)}) a UNION SELECT vec_id FROM ({shots_sql(10)}) b) u""",
)
def few_shot_union(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return P.dense_positions(*[P.few_shot(e, "label", "vec_id", k) for k in (5, 10)], key="vec_id")


# ---- hold-out tables -----------------------------------------------------------------------

WHOLE = "row < FLOOR((SELECT max(row) + 1 FROM rasters) / 5e0) * 5"
TILE = "CAST(FLOOR(row / 5e0) AS INT) AS tile_row, CAST(FLOOR(col / 5e0) AS INT) AS tile_col"


@query(
    "holdout_composition",
    "C20 P20 F7 A22",
    f"""SELECT {TILE}, round(coalesce(avg(lpgrs_tio2) FILTER (WHERE lpgrs_tio2 <> 0), 0) + 17e-9, 6) AS target_lpgrs_tio2,
    round(coalesce(avg(lpgrs_feo) FILTER (WHERE lpgrs_feo <> 0), 0) + 17e-9, 6) AS target_lpgrs_feo, CAST(5 AS INT) AS n_inputs,
    count(clementine_uvvis_750nm) > 0 AS has_composition FROM rasters WHERE {WHOLE} GROUP BY 1, 2 HAVING count(lpgrs_tio2) > 0 AND count(lpgrs_feo) > 0""",
)
def holdout_composition(spark, sf):
    grid = dem_grid(spark, sf)
    known = layers(spark, sf).where(F.col("channel") != "mystery")
    targets = ["lpgrs_tio2", "lpgrs_feo"]
    samples = T.hold_out(
        T.assemble_samples(T.pack_tiles(known, grid)), targets, "composition", "clementine_uvvis_750nm"
    )
    means = off_tie(
        T.spatial_mean_targets(known, grid, targets), *[f"target_{t}" for t in targets]
    )
    return means.join(samples, ["tile_row", "tile_col"]).select(
        "tile_row",
        "tile_col",
        *[f"target_{t}" for t in targets],
        F.size("pixels").alias("n_inputs"),
        F.col("has_group")["composition"].alias("has_composition"),
    )


THERMAL = {
    "diviner_tbol_midnight": "elevation",
    "diviner_temp_night": "roughness",
    "rock_abundance": "lpgrs_feo",
    "christiansen_feature": "minirf_s1",
}


@query(
    "holdout_thermal",
    "C20 P20 A22",
    "SELECT " + TILE + ", "
    + ", ".join(
        f"round(coalesce(avg({c}) FILTER (WHERE {c} <> 0), 0) + 17e-9, 6) AS target_{t}" for t, c in THERMAL.items()
    )
    + f", CAST(1 AS INT) AS n_inputs, false AS has_thermal, count(m3_750) > 0 AS has_spectral FROM rasters WHERE {WHOLE} GROUP BY 1, 2",
)
def holdout_thermal(spark, sf):
    """Thermal means as targets for every patch; a missing target is 0."""
    grid = dem_grid(spark, sf)
    cells = T.stack_columns(fixture(spark, sf, "rasters"), {**THERMAL, "m3_750": "m3_750"})
    samples = T.hold_out(T.assemble_samples(T.pack_tiles(cells, grid)), list(THERMAL), "thermal", None)
    means = T.spatial_mean_targets(cells, grid, list(THERMAL), require=False)
    means = off_tie(means, *[f"target_{t}" for t in THERMAL])
    return means.join(samples, ["tile_row", "tile_col"]).select(
        "tile_row",
        "tile_col",
        *[f"target_{t}" for t in THERMAL],
        F.size("pixels").alias("n_inputs"),
        F.col("has_group")["thermal"].alias("has_thermal"),
        F.col("has_group")["spectral_m3"].alias("has_spectral"),
    )


# ---- metrics -------------------------------------------------------------------------------

PER_CLASS_SQL = """SELECT c AS class, tp, fp, fn, total, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall,
    2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-8) AS f1,
    tp / greatest(tp + fp + fn, 1) AS iou
    FROM (SELECT CAST(c AS INT) AS c, CAST(count(*) FILTER (WHERE target = c AND pred = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE target <> c AND pred = c) AS DOUBLE) AS fp,
            CAST(count(*) FILTER (WHERE target = c AND pred <> c) AS DOUBLE) AS fn, count(*) AS total FROM {preds} CROSS JOIN range(0, {k}) r(c) GROUP BY c) g"""


def per_class_sql(preds, k):
    return PER_CLASS_SQL.replace("{preds}", preds).replace("{k}", str(k))


@query(
    "classification_per_class",
    "A17",
    f"""SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM ({per_class_sql('preds_cls', 3)}) p""",
)
def classification_per_class(spark, sf):
    out = M.per_class(fixture(spark, sf, "preds_cls"), 3)
    return rounded(out.select("class", "tp", "fp", "fn", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(
    "classification_metrics",
    "A17",
    f"""SELECT round(sum(tp) / max(total), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (WHERE tp + fp + fn > 0), 6) AS present_macro_f1,
    CAST(max(total) AS BIGINT) AS n FROM ({per_class_sql('preds_cls', 3)}) p""",
)
def classification_metrics(spark, sf):
    out = M.classification(fixture(spark, sf, "preds_cls"), 3)
    return rounded(out, "accuracy", "macro_f1", "present_macro_f1")


SEGMENTS = "(SELECT CASE WHEN regexp_matches(unit, '^(Em|Im|lIm|Cm)') THEN 1 ELSE 0 END AS target, CASE WHEN unit IN ('Em', 'pNb') THEN 1 ELSE 0 END AS pred FROM units WHERE unit IS NOT NULL) s"


@query(
    "segmentation_metrics",
    "A18 U3",
    f"SELECT round(avg(iou), 6) AS mean_iou, round(avg(f1), 6) AS mean_f1 FROM ({per_class_sql(SEGMENTS, 2)}) p",
)
def segmentation_metrics(spark, sf):
    u = fixture(spark, sf, "units").where(F.col("unit").isNotNull())
    preds = u.select(is_mare(F.col("unit")).alias("target"), F.col("unit").isin("Em", "pNb").cast("int").alias("pred"))
    return rounded(M.segmentation(preds, 2), "mean_iou", "mean_f1")


REG = """round(avg((pred - target) * (pred - target)), 2) AS mse, round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse,
    round(1 - sum((pred - target) * (pred - target)) / greatest(var_pop(target) * count(*), 1e-8), 6) AS r2, round(corr(pred, target), 6) AS pearson, CAST(count(*) AS BIGINT) AS n"""


@query(
    "regression_metrics",
    "A19",
    f"SELECT output, {REG} FROM preds_reg GROUP BY output UNION ALL SELECT 'all' AS output, {REG} FROM preds_reg",
)
def regression_metrics(spark, sf):
    preds = fixture(spark, sf, "preds_reg")
    out = M.regression(preds, ["output"]).unionByName(M.regression(preds).withColumn("output", F.lit("all")))
    return rounded(rounded(rounded(out, "r2", "pearson"), "rmse", digits=4), "mse", digits=2)


@query("ordinal_mae", "A20", "SELECT round(avg(abs(pred - target)), 6) AS mae FROM preds_ord")
def ordinal_mae(spark, sf):
    return rounded(M.ordinal_error(fixture(spark, sf, "preds_ord")), "mae")


# ---- probes --------------------------------------------------------------------------------


def probe_data(spark, sf):
    """Pooled features with labels, materialised once, split by hash into train and test."""
    e = table(spark, sf, "embeddings")
    pooled = E.pool_groups(tokens(spark, sf)).withColumnRenamed("sample_id", "vec_id")
    data = pooled.join(
        e.select(
            "vec_id",
            "label",
            (F.col("label") % 5).alias("age"),
            F.col("embedding")[62].cast("double").alias("feo"),
            (F.col("embedding")[0] * 2 + F.col("embedding")[1]).cast("double").alias("tio2"),
            "embedding",
        ),
        "vec_id",
    ).withColumn("vec", F.concat("vec", F.col("embedding").cast("array<double>"))).drop("embedding")
    data = written(data.withColumn("is_test", hash_int("split", F.col("vec_id")) % 10 < 3), "features")
    return data.where(~F.col("is_test")), data.where("is_test")


@query("probe_classification", "M2 A17")
def probe_classification(spark, sf):
    train, test = probe_data(spark, sf)
    linear = E.classify(train, test, "label", "vec_id").withColumn("head", F.lit("linear"))
    hidden = E.classify(train, test, "label", "vec_id", hidden=True, dims=67, classes=10)
    preds = linear.unionByName(hidden.withColumn("head", F.lit("hidden")))
    return M.classification(preds, 10, ["head"])


@query("probe_regression", "M3 A19")
def probe_regression(spark, sf):
    train, test = probe_data(spark, sf)
    return M.regression(E.regress(train, test, ["feo", "tio2"], "vec_id"), ["target_name"])


@query("fewshot_grid", "M4 N3 A17 A20")
def fewshot_grid(spark, sf):
    """Tasks by shots, one row each: few-shot training sample, linear probe, test metrics."""
    train, test = probe_data(spark, sf)
    out = None
    for task, k_classes in (("label", 10), ("age", 5)):
        for shots in (5, 10):
            few = P.few_shot(train, task, "vec_id", shots)
            preds = E.classify(few, test, task, "vec_id")
            row = M.classification(preds, k_classes).withColumn("mae", M.ordinal_error(preds).scalar())
            row = row.withColumn("task", F.lit(task)).withColumn("shots", F.lit(shots))
            out = row if out is None else out.unionByName(row)
    return out
