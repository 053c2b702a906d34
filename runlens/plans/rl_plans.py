"""Queries for RL rollout samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.functions.numeric import round_half_up
from runlens.functions.numeric import sql_round as R
from runlens.operators import rl as RL
from runlens.plans.registry import register

# Stand-in RL steps from the embeddings table: one step per vector, ten
# consecutive vectors per sample (so samples grow in number, not in size, with
# the table), one token per vector element (ids from the vector id, log-probs
# from the vector values), model or observation by label parity.


def _rl_steps(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    model = F.col("label") % 2 == 0
    return emb.select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("sample_id"),
        (F.col("vec_id") % 10).cast("int").alias("step"),
        F.when(model, F.lit("model")).otherwise(F.lit("observation")).alias("kind"),
        F.transform("embedding", lambda x, i: (F.col("vec_id") * 100 + i).cast("int")).alias("token_ids"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logprobs"),
        F.when(model, F.concat(F.lit("w"), (F.col("vec_id") % 3).cast("string"))).otherwise(F.lit(""))
        .alias("weight_version"),
    )


_STEPS_SQL = """rl_steps AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS sample_id, CAST(vec_id % 10 AS INTEGER) AS step,
    CASE WHEN label % 2 = 0 THEN 'model' ELSE 'observation' END AS kind,
    list_transform(range(0, len(embedding)), lambda i: CAST(vec_id * 100 + i AS INTEGER)) AS token_ids,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logprobs,
    CASE WHEN label % 2 = 0 THEN concat('w', CAST(vec_id % 3 AS VARCHAR)) ELSE '' END AS weight_version
  FROM embeddings)"""

# per-sample flattened sequence, written directly in SQL for the oracle
_SEQ_SQL = _STEPS_SQL + """,
tok AS (SELECT sample_id, step, kind, weight_version, unnest(token_ids) AS t, unnest(
          CASE WHEN kind = 'model' THEN logprobs ELSE list_transform(token_ids, lambda x: 0.0) END) AS l,
          generate_subscripts(token_ids, 1) AS i FROM rl_steps),
seq AS (SELECT sample_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY step, i) AS tokens,
          string_agg(CASE WHEN kind = 'model' THEN '1' ELSE '0' END, '' ORDER BY step, i) AS mask,
          count(*) AS n_resp, sum(l) AS lp FROM tok GROUP BY 1),
wv AS (SELECT sample_id, string_agg(weight_version, ',' ORDER BY step) AS wv FROM rl_steps
       WHERE kind = 'model' AND weight_version <> '' GROUP BY 1)"""


def _seq(spark, sf):
    return RL.rl_sequence(_rl_steps(spark, sf))


@register(
    "rl_sequence",
    "WITH " + _SEQ_SQL + f"""
SELECT s.sample_id, s.tokens AS response_tokens, s.mask AS loss_mask, {R('s.lp', 6)} AS logprob_sum,
  coalesce(wv.wv, '') AS weight_versions FROM seq s LEFT JOIN wv ON s.sample_id = wv.sample_id""",
)
def q_rl_sequence(spark, sf):
    s = _seq(spark, sf)
    return s.select(
        "sample_id", F.array_join("response_token_ids", ",").alias("response_tokens"),
        F.array_join(F.transform("loss_mask", lambda x: x.cast("string")), "").alias("loss_mask"),
        round_half_up(F.aggregate("rollout_log_probs", F.lit(0.0), lambda a, x: a + x), 6).alias("logprob_sum"),
        F.array_join("weight_versions", ",").alias("weight_versions"))


# stand-in sample outcomes per sample id
_ACC = "sample_id % 3 = 0"
_FSTAT = "CASE sample_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'abort' ELSE 'other' END"
_BUDGET = "CAST(120 + (sample_id % 5) * 60 AS INT)"
_PROMPT_N = "CAST(10 + sample_id % 20 AS INT)"
_PATCH = "sample_id % 7 <> 0"


@register(
    "rl_reward",
    f"""SELECT sample_id, CAST(CASE WHEN ({_ACC}) AND ({_PATCH}) THEN 1.0 ELSE -1.0 END AS DOUBLE) AS reward,
  CAST(CASE WHEN ({_ACC}) AND ({_PATCH}) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS eval_reward
FROM (SELECT DISTINCT CAST(floor(vec_id / 10) AS BIGINT) AS sample_id FROM embeddings)""",
)
def q_rl_reward(spark, sf):
    ids = read_table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("sample_id")) \
        .distinct()
    return ids.select("sample_id", RL.rl_reward(F.expr(_ACC), F.expr(_PATCH)).alias("reward"),
                      RL.rl_reward(F.expr(_ACC), F.expr(_PATCH), evaluation=True).alias("eval_reward"))


@register(
    "rl_status",
    f"""SELECT sample_id, CASE {_FSTAT} WHEN 'stop' THEN 'completed' WHEN 'length' THEN 'truncated'
  WHEN 'abort' THEN 'aborted' ELSE 'completed' END AS status
FROM (SELECT DISTINCT CAST(floor(vec_id / 10) AS BIGINT) AS sample_id FROM embeddings)""",
)
def q_rl_status(spark, sf):
    ids = read_table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("sample_id")) \
        .distinct()
    return ids.select("sample_id", RL.rl_status(F.expr(_FSTAT)).alias("status"))


@register(
    "rl_truncate",
    "WITH " + _SEQ_SQL + f""",
smp AS (SELECT s.sample_id, {_PROMPT_N} AS np, s.n_resp, {_BUDGET} AS budget, string_split(s.tokens, ',') AS toks,
          s.mask, CASE WHEN {_ACC} THEN 1.0 ELSE -1.0 END AS reward0, {_FSTAT} AS fstat FROM seq s),
c AS (SELECT *, np + n_resp > budget AS over, budget - np - 64 AS room FROM smp)
SELECT sample_id,
  CAST(CASE WHEN over AND reward0 = 1.0 THEN -1.0 ELSE reward0 END AS DOUBLE) AS reward,
  CASE WHEN over AND room < 0 THEN 'aborted' WHEN over THEN 'truncated'
       ELSE CASE fstat WHEN 'stop' THEN 'completed' WHEN 'length' THEN 'truncated' WHEN 'abort' THEN 'aborted'
            ELSE 'completed' END END AS status,
  CAST(CASE WHEN over AND room >= 0 THEN least(room, n_resp) ELSE n_resp END AS INTEGER) AS response_length,
  CASE WHEN over AND room >= 0 THEN array_to_string(toks[1:room], ',') ELSE array_to_string(toks, ',') END
    AS response_tokens,
  CASE WHEN over AND room >= 0 THEN left(mask, room) ELSE mask END AS loss_mask
FROM c""",
)
def q_rl_truncate(spark, sf):
    s = _seq(spark, sf).withColumn("prompt_token_ids", F.sequence(F.lit(1), F.expr(_PROMPT_N))).withColumn(
        "budget", F.expr(_BUDGET)).withColumn("reward", RL.rl_reward(F.expr(_ACC))).withColumn(
        "finish_status", F.expr(_FSTAT))
    t = RL.rl_truncate(s)
    return t.select("sample_id", "reward", "status", "response_length",
                    F.array_join("response_token_ids", ",").alias("response_tokens"),
                    F.array_join(F.transform("loss_mask", lambda x: x.cast("string")), "").alias("loss_mask"))


@register(
    "trajectory_export",
    "WITH " + _STEPS_SQL + f""",
m AS (SELECT * FROM rl_steps WHERE kind = 'model'),
tok AS (SELECT sample_id, step, unnest(token_ids) AS t, unnest(logprobs) AS l, generate_subscripts(token_ids, 1) AS i
        FROM m),
a AS (SELECT sample_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY step, i) AS tokens, sum(l) AS lp FROM tok
      GROUP BY 1),
n AS (SELECT sample_id, count(*) AS num_steps FROM m GROUP BY 1)
SELECT n.sample_id AS run_id, coalesce(a.tokens, '') AS response_tokens, {R('coalesce(a.lp, 0.0)', 6)} AS logprob_sum,
  CAST(n.num_steps AS BIGINT) AS num_steps, CAST(CASE WHEN n.sample_id % 3 = 0 THEN 1.0 ELSE -1.0 END AS DOUBLE) AS reward
FROM n LEFT JOIN a ON n.sample_id = a.sample_id""",
)
def q_trajectory_export(spark, sf):
    steps = _rl_steps(spark, sf).where(F.col("kind") == "model").withColumnRenamed("sample_id", "run_id")
    rewards = steps.select("run_id").distinct().select(
        "run_id", F.when(F.col("run_id") % 3 == 0, 1.0).otherwise(-1.0).alias("reward"))
    t = RL.trajectory_export(steps, rewards)
    return t.select("run_id", F.array_join("response_token_ids", ",").alias("response_tokens"),
                    round_half_up(F.aggregate("logprobs", F.lit(0.0), lambda a, x: a + x), 6).alias("logprob_sum"),
                    "num_steps", "reward")


@register(
    "group_abort_flag",
    oracle_with("fx_samples") + """
SELECT group_id, bool_or(status = 'aborted') AS retry, count(*) AS n_samples, min(sample_index) AS first_index
FROM fx_samples GROUP BY group_id""",
)
def q_group_abort_flag(spark, sf):
    return RL.group_abort_flag(fixture(spark, sf, "fx_samples"))


_TARGET = 5


@register(
    "collect_batch",
    oracle_with("fx_samples") + f""",
g AS (SELECT group_id, bool_or(status = 'aborted') AS ab, max(n_tokens) AS done_at, min(sample_index) AS first_index
      FROM fx_samples GROUP BY 1),
c AS (SELECT * FROM g WHERE NOT ab ORDER BY done_at, group_id LIMIT {_TARGET})
SELECT group_id, done_at, first_index, CAST(row_number() OVER (ORDER BY first_index, group_id) AS BIGINT) AS batch_pos
FROM c""",
)
def q_collect_batch(spark, sf):
    # stand-in completion time: the group's longest sample
    s = fixture(spark, sf, "fx_samples").withColumn("done_at", F.col("n_tokens"))
    return RL.collect_batch(s, _TARGET)


_REWARD = "CASE status WHEN 'completed' THEN 1.0 WHEN 'truncated' THEN -1.0 ELSE 0.0 END"


@register(
    "rollout_info",
    oracle_with("fx_samples") + f""",
g AS (SELECT group_id, min(sample_index) AS first_index FROM fx_samples GROUP BY 1),
s AS (SELECT f.*, g.first_index, CAST(floor(f.sample_index / 8) AS BIGINT) AS rollout_id, {_REWARD} AS reward
      FROM fx_samples f JOIN g ON f.group_id = g.group_id)
SELECT rollout_id, count(*) AS n_samples, count(*) FILTER (WHERE status = 'truncated') AS n_truncated,
  {R('avg(reward)', 6)} AS mean_reward,
  string_agg(CAST(reward AS VARCHAR), ',' ORDER BY first_index, sample_index) AS reward,
  string_agg(CASE WHEN status = 'truncated' THEN '1' ELSE '0' END, ',' ORDER BY first_index, sample_index) AS truncated
FROM s GROUP BY rollout_id""",
)
def q_rollout_info(spark, sf):
    s = fixture(spark, sf, "fx_samples")
    first = s.groupBy("group_id").agg(F.min("sample_index").alias("first_index"))
    # stand-in: a rollout is a batch of 8 consecutive samples
    s = s.join(first, "group_id").withColumn("rollout_id", F.floor(F.col("sample_index") / 8).cast("bigint")) \
        .withColumn("reward", F.expr(_REWARD))
    info = RL.rollout_info(s)
    return info.select("rollout_id", "n_samples", "n_truncated", round_half_up(F.col("mean_reward"), 6)
                       .alias("mean_reward"),
                       F.array_join(F.transform("reward", lambda x: F.format_number(x, 1)), ",").alias("reward"),
                       F.array_join(F.transform("truncated", lambda x: x.cast("string")), ",").alias("truncated"))


@register(
    "join_sample_instance",
    oracle_with("fx_samples", "fx_instances") + """,
s AS (SELECT sample_index, concat('I-', CAST(sample_index * 13 AS VARCHAR)) AS instance_id, status FROM fx_samples)
SELECT s.sample_index, s.instance_id, i.instance_id IS NOT NULL AS found,
  CASE WHEN i.instance_id IS NULL THEN 'aborted' ELSE s.status END AS status
FROM s LEFT JOIN fx_instances i ON s.instance_id = i.instance_id""",
)
def q_join_sample_instance(spark, sf):
    s = fixture(spark, sf, "fx_samples").select(
        "sample_index", F.concat(F.lit("I-"), (F.col("sample_index") * 13).cast("string")).alias("instance_id"),
        "status")
    return RL.join_sample_instance(s, fixture(spark, sf, "fx_instances")).select(
        "sample_index", "instance_id", "found", "status")
