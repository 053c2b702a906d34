"""RL rollout samples: token sequences, rewards, truncation, status, group
handling and batch collection.

A sample's token sequence is bounded by its token budget (32,768 by
default), so building it with an ordered ``collect_list`` per sample is a
bounded group; group-level decisions (abort, batch choice) are aggregates
and a distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: rewards and the status map.
POS_REWARD = 1.0
NEG_REWARD = -1.0
STATUS_MAP = {"stop": "completed", "length": "truncated", "abort": "aborted"}
TRUNCATION_MARGIN = 64
DEFAULT_BUDGET = 32768


def rl_sequence(steps: DataFrame, sample: str = "sample_id", step: str = "step") -> DataFrame:
    """Per sample: response tokens in step order, ``loss_mask`` (1 model /
    0 observation), ``rollout_log_probs`` (0.0 on observations) and the
    non-empty weight versions of model steps."""
    is_model = F.col("kind") == "model"
    toks = F.coalesce(F.col("token_ids"), F.array().cast("array<int>"))
    lps = F.when(is_model, F.coalesce(F.col("logprobs"), F.array().cast("array<double>"))).otherwise(
        F.array_repeat(F.lit(0.0), F.size(toks)))
    rec = F.struct(F.col(step).alias("step"), toks.alias("t"),
                   F.array_repeat(F.when(is_model, F.lit(1)).otherwise(F.lit(0)).cast("tinyint"), F.size(toks))
                   .alias("m"), lps.alias("l"),
                   F.when(is_model & (F.coalesce(F.col("weight_version"), F.lit("")) != ""),
                          F.col("weight_version")).alias("w"))
    agg = steps.groupBy(sample).agg(F.array_sort(F.collect_list(rec)).alias("_s"))
    s = F.col("_s")
    return agg.select(
        sample,
        F.flatten(F.transform(s, lambda r: r["t"])).alias("response_token_ids"),
        F.flatten(F.transform(s, lambda r: r["m"])).alias("loss_mask"),
        F.flatten(F.transform(s, lambda r: r["l"])).alias("rollout_log_probs"),
        F.filter(F.transform(s, lambda r: r["w"]), lambda w: w.isNotNull()).alias("weight_versions"),
    )


def rl_reward(accepted: Column, has_patch: Column | None = None, evaluation: bool = False) -> Column:
    """+1 when the evaluation accepted the patch, else the initial reward
    (-1, or 0 in evaluation mode); a partial score keeps the initial value."""
    initial = F.lit(0.0 if evaluation else NEG_REWARD)
    ok = F.coalesce(accepted, F.lit(False))
    if has_patch is not None:
        ok = ok & F.coalesce(has_patch, F.lit(False))
    return F.when(ok, F.lit(POS_REWARD)).otherwise(initial)


def rl_status(finish_status: Column) -> Column:
    """stop / length / abort -> completed / truncated / aborted; else completed."""
    m = F.create_map(*[F.lit(x) for kv in STATUS_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(m, finish_status), F.lit("completed"))


def rl_truncate(samples: DataFrame, budget: str = "budget") -> DataFrame:
    """Budget check of a finished sample.

    Over budget (prompt + response tokens > budget): a +1 reward is demoted
    to -1; with ``room = budget - prompt - 64`` < 0 the sample is ``aborted``
    with its arrays untouched, else response, mask and log-probs are cut to
    ``room`` tokens and the sample is ``truncated``.  Within budget the
    status comes from ``rl_status``.  Needs ``prompt_token_ids``,
    ``response_token_ids``, ``loss_mask``, ``rollout_log_probs``, ``reward``,
    ``finish_status``."""
    b = F.coalesce(F.col(budget), F.lit(DEFAULT_BUDGET))
    n_prompt = F.size("prompt_token_ids")
    total = n_prompt + F.size("response_token_ids")
    over = total > b
    room = b - n_prompt - TRUNCATION_MARGIN
    cut = over & (room >= 0)

    keep = F.greatest(room, F.lit(0)).cast("int")

    def sliced(c: str) -> Column:
        return F.when(cut, F.slice(F.col(c), 1, keep)).otherwise(F.col(c))

    status = F.when(over & (room < 0), F.lit("aborted")).when(over, F.lit("truncated")).otherwise(
        rl_status(F.col("finish_status")))
    reward = F.when(over & (F.col("reward") == POS_REWARD), F.lit(NEG_REWARD)).otherwise(F.col("reward"))
    replaced = {"reward", "response_token_ids", "loss_mask", "rollout_log_probs"}
    out = samples.select(
        *[c for c in samples.columns if c not in replaced],
        reward.alias("reward"),
        sliced("response_token_ids").alias("response_token_ids"),
        sliced("loss_mask").alias("loss_mask"),
        sliced("rollout_log_probs").alias("rollout_log_probs"),
        status.alias("status"),
    )
    return out.withColumn("tokens", F.concat("prompt_token_ids", "response_token_ids")).withColumn(
        "response_length", F.size("response_token_ids"))


def trajectory_export(steps: DataFrame, rewards: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """Training export per run: concatenated response token ids and
    log-probs over its steps, the final reward and the number of steps."""
    rec = F.struct(F.col(step).alias("step"), F.coalesce(F.col("token_ids"), F.array().cast("array<int>")).alias("t"),
                   F.coalesce(F.col("logprobs"), F.array().cast("array<double>")).alias("l"))
    agg = steps.groupBy(run).agg(F.array_sort(F.collect_list(rec)).alias("_s"), F.count(F.lit(1)).alias("num_steps"))
    out = agg.select(run, F.flatten(F.transform("_s", lambda r: r["t"])).alias("response_token_ids"),
                     F.flatten(F.transform("_s", lambda r: r["l"])).alias("logprobs"),
                     F.col("num_steps").cast("bigint").alias("num_steps"))
    return out.join(rewards.select(run, "reward"), run, "left")


def group_abort_flag(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """A group goes back for retry when any of its samples is aborted."""
    return samples.groupBy(group).agg(
        F.bool_or(F.col("status") == "aborted").alias("retry"),
        F.count(F.lit(1)).cast("bigint").alias("n_samples"),
        F.min("sample_index").alias("first_index"),
    )


def collect_batch(samples: DataFrame, target: int, done_at: str = "done_at", group: str = "group_id") -> DataFrame:
    """The first ``target`` groups to complete without an aborted sample, in
    the order of their first sample index (``batch_pos``).  Completion ties
    break on the group id.  ``orderBy().limit()`` is a distributed top-k."""
    groups = samples.groupBy(group).agg(
        F.bool_or(F.col("status") == "aborted").alias("_aborted"),
        F.max(done_at).alias("done_at"),
        F.min("sample_index").alias("first_index"),
    )
    chosen = groups.where(~F.col("_aborted")).orderBy("done_at", group).limit(target)
    w = Window.partitionBy(F.lit(0)).orderBy("first_index", group)
    return chosen.select(group, "done_at", "first_index",
                         F.row_number().over(w).cast("bigint").alias("batch_pos"))


def rollout_info(samples: DataFrame, rollout: str = "rollout_id", order: tuple[str, ...] = ("first_index",
                                                                                              "sample_index")) -> DataFrame:
    """Per rollout: counts and mean reward (scalable form) plus the reward and
    truncated lists in sample order.  A rollout holds one batch of samples,
    so its lists are bounded by the batch size."""
    rec = F.struct(*[F.col(o) for o in order], F.col("reward").alias("r"),
                   F.when(F.col("status") == "truncated", 1).otherwise(0).alias("t"))
    agg = samples.groupBy(rollout).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_samples"),
        F.count_if(F.col("status") == "truncated").cast("bigint").alias("n_truncated"),
        F.avg("reward").alias("mean_reward"),
        F.array_sort(F.collect_list(rec)).alias("_s"),
    )
    return agg.select(rollout, "n_samples", "n_truncated", "mean_reward",
                      F.transform("_s", lambda x: x["r"]).alias("reward"),
                      F.transform("_s", lambda x: x["t"]).alias("truncated"))


def join_sample_instance(samples: DataFrame, instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """Attach each sample's instance; a sample whose instance is unknown is
    ``aborted``."""
    inst = instances.select(key, F.lit(True).alias("_found"))
    out = samples.join(inst, key, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return out.withColumn("found", found).withColumn(
        "status", F.when(~found, F.lit("aborted")).otherwise(F.col("status"))).drop("_found")
