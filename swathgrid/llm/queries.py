"""Registered queries of the training-data operators: name -> (plan, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.llm import chat, codes, exact_dedup, jaccard, line_dedup, lm, minhash, packing, pieces, pii, quality, resampling, topk
from swathgrid.llm.common import crc_mod, table

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = (plan, oracle)
        return plan

    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    scored = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_texts(table(spark, sf_dir, "documents"), path, keep=False).drop("ids", "decoded")


@query("op3_lm")
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_hidden"
    )


@query("op5_jaccard")
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, keep_ids=False).drop("ids")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    return line_dedup.drop_recurring_lines(before, long_docs=2).select(
        "doc_id",
        "n_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars_left"),
    )


@query(
    "op8_exact_dedup",
    """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op9_topk",
    """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.w, p.w) AS BIGINT) AS score
    FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20
""",
)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query(
    "op10_chat",
    r"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
raw AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss
    FROM said GROUP BY conv_id
),
sized AS (
    SELECT conv_id, turn, role, text,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
           length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'))
             + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g'))
             + length('<turn >') + length('</turn>') + 1 AS chars
    FROM said
),
summed AS MATERIALIZED (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM sized
),
systems AS (
    SELECT conv_id, min(first) AS s_first, arg_min(tokens, first) AS s_tokens, arg_min(chars, first) AS s_chars
    FROM summed WHERE role = 'system' GROUP BY conv_id
),
opened AS (
    SELECT t.*, first // 8192 AS stretch, s_first, CASE WHEN s_first < first THEN s_chars + 6 ELSE 0 END AS head_chars,
           512 - CASE WHEN s_first < first THEN s_tokens ELSE 0 END AS space
    FROM summed t LEFT JOIN systems USING (conv_id)
),
reached AS (
    SELECT o.conv_id, o.first, coalesce(max(o.first - h.first), 0) AS past_tokens,
           coalesce(sum(h.chars + 6) FILTER (h.first IS DISTINCT FROM o.s_first), 0) AS past_chars
    FROM opened o LEFT JOIN summed h
      ON h.conv_id = o.conv_id AND h.first < o.first AND o.first - h.first <= least(128, o.space - o.tokens)
    GROUP BY o.conv_id, o.first
),
followed AS MATERIALIZED (
    SELECT o.conv_id, o.first, any_value(o.head_chars + r.past_chars) AS extra, min(n.first) AS following
    FROM opened o JOIN reached r USING (conv_id, first)
    LEFT JOIN opened n ON n.conv_id = o.conv_id AND n.stretch = o.stretch AND n.first > o.first
                      AND n.first + n.tokens - o.first > o.space - r.past_tokens
    GROUP BY o.conv_id, o.first
),
windows AS (
    SELECT conv_id, min(first) AS first FROM opened GROUP BY conv_id, stretch
    UNION ALL
    SELECT w.conv_id, f.following FROM windows w JOIN followed f USING (conv_id, first) WHERE f.following IS NOT NULL
),
formatted AS (
    SELECT s.conv_id, s.chars + w.extra AS chars
    FROM (SELECT conv_id, sum(chars) AS chars FROM sized GROUP BY conv_id) s
    JOIN (SELECT conv_id, sum(extra) AS extra FROM windows JOIN followed USING (conv_id, first) GROUP BY conv_id) w
    USING (conv_id)
)
SELECT r.conv_id, r.n_turns, sha256(r.turns) AS turns_sha256, length(r.loss) AS loss_chars,
       sha256(r.loss) AS loss_sha256, CAST(f.chars AS BIGINT) AS formatted_chars
FROM raw r JOIN formatted f USING (conv_id)
""",
)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.chat_windows(conversations.unionByName(extra)))


@query("op11_resampling")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = resampling.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def _codes_sql(rounds: int = 4) -> str:
    steps = [
        """
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS MATERIALIZED (
    SELECT vec_id, label, p, v[len(v) // 4 * p + 1 : len(v) // 4 * (p + 1)] AS x FROM kept, range(4) AS r(p)
),
book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
    FROM part QUALIFY e < 256
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x,
           min(256 * CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) + e) AS best
    FROM part JOIN book{r} USING (p) GROUP BY vec_id, p
)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
    SELECT p, e, list(m ORDER BY i) AS c
    FROM (SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS m
          FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY ALL)
    GROUP BY p, e
),
book{r + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e
)""")
    return ",".join(steps) + f""",
coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code,
           CAST(sum(best // 256) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
        FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS i FROM book{rounds})) AS codebooks_sha256
FROM coded
"""


@query("op12_codes", _codes_sql())
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_minhash")
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"), n=4, num=80, den=100)
