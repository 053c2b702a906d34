"""Per-run step logic: condensing, context cut-off, step cap, run outcome,
completion confirmation, terminal deltas and token offsets.

A run is bounded by ``max_steps`` and a conversation by its message limit, so
rules that look at other steps of the run are windows over it: one shuffle on
the run, the source read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import py_strip


def condense_messages(messages: DataFrame, max_messages: int, keep_first: int, conv: str = "conv_id",
                      pos: str = "turn") -> DataFrame:
    """Keep the first ``keep_first`` and the last ``max - keep_first``
    messages of a conversation longer than ``max``.  ``pos`` is the 0-based
    message position.  ``keep_first >= max`` is rejected (ill-defined)."""
    if keep_first >= max_messages:
        raise ValueError("keep_first must be smaller than max_messages")
    out = messages.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(conv)))
    rn = F.col(pos) + 1
    keep = (F.col("_n") <= max_messages) | (rn <= keep_first) | (rn > F.col("_n") - (max_messages - keep_first))
    return out.where(keep).drop("_n")


def context_cutoff(steps: DataFrame, limit: int, run: str = "run_id", step: str = "step") -> DataFrame:
    """Steps a run executes under ``max_context_length = limit``.

    Before each step the previous call's prompt+completion tokens are
    checked; the first step ``v`` whose own tokens exceed the limit is the
    last one executed.  ``cutoff`` marks runs that were stopped with
    ``context_length`` (a later step existed)."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    whole = Window.partitionBy(run)
    out = steps.withColumns({
        "_v": F.min(F.when(tokens > limit, F.col(step))).over(whole), "_last": F.max(step).over(whole)})
    return out.where(F.col("_v").isNull() | (F.col(step) <= F.col("_v"))).withColumn(
        "cutoff", F.coalesce(F.col("_v") < F.col("_last"), F.lit(False))).drop("_v", "_last")


def step_cap(steps: DataFrame, max_steps: int, is_finish: Column, run: str = "run_id",
             step: str = "step") -> DataFrame:
    """Per run: steps executed within ``max_steps`` (up to the first finish)
    and ``finish_reason`` (``finish`` or ``max_steps``)."""
    capped = steps.where(F.col(step) < max_steps)
    agg = capped.groupBy(run).agg(
        F.min(F.when(is_finish, F.col(step))).alias("_f"), F.count(F.lit(1)).alias("_n"))
    return agg.select(
        run,
        F.when(F.col("_f").isNotNull(), F.col("_f") + 1).otherwise(F.col("_n")).cast("bigint").alias("steps"),
        F.when(F.col("_f").isNotNull(), F.lit("finish")).otherwise(F.lit("max_steps")).alias("finish_reason"),
    )


def run_outcome(steps: DataFrame, max_steps: int, max_context_length: int | None = None,
                has_reminder: bool = True, run: str = "run_id", step: str = "step") -> DataFrame:
    """Finish reason of each run replayed from its step log.

    Per step, in priority order: context guard (the previous step's
    prompt+completion > limit; the step does not run) -> error -> token
    budget (``finish_status = 'length'``) -> ``finish`` action -> message
    without tool calls when the agent has no reminder.  The first terminal
    step decides (``context_length`` for guard and budget, ``error``,
    ``finish``); a run without one is ``max_steps`` when it reached the cap,
    else ``incomplete`` (its log ended early).  ``steps`` counts executed
    steps.  Needs columns ``prompt_tokens, completion_tokens, action_type,
    n_tool_calls, finish_status, error``.
    """
    s = steps.where(F.col(step) < max_steps)
    by_step = Window.partitionBy(run).orderBy(step)
    # the previous step's tokens, if that step is in the log
    s = s.withColumn("_prev_tokens", F.when(
        F.lag(step).over(by_step) == F.col(step) - 1,
        F.lag(F.col("prompt_tokens") + F.col("completion_tokens")).over(by_step)))
    guard = F.lit(False) if max_context_length is None else F.coalesce(
        F.col("_prev_tokens") > max_context_length, F.lit(False))
    msg_end = (F.col("action_type") == "message") & (F.coalesce(F.col("n_tool_calls"), F.lit(0)) == 0) & F.lit(
        not has_reminder)
    cond = (
        F.when(guard, F.struct(F.lit(0).alias("p"), F.lit("context_length").alias("reason"), F.lit(0).alias("ran")))
        .when(F.col("error").isNotNull(), F.struct(F.lit(1).alias("p"), F.lit("error").alias("reason"), F.lit(1).alias("ran")))
        .when(F.col("finish_status") == "length", F.struct(F.lit(2).alias("p"), F.lit("context_length").alias("reason"), F.lit(1).alias("ran")))
        .when(F.col("action_type") == "finish", F.struct(F.lit(3).alias("p"), F.lit("finish").alias("reason"), F.lit(1).alias("ran")))
        .when(msg_end, F.struct(F.lit(4).alias("p"), F.lit("finish").alias("reason"), F.lit(1).alias("ran")))
    )
    flagged = s.select(run, step, cond.alias("_t"))
    agg = flagged.groupBy(run).agg(
        F.min(F.when(F.col("_t").isNotNull(), F.struct(F.col(step).alias("step"), F.col("_t").alias("t"))))
        .alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    first = F.col("_first")
    return agg.select(
        run,
        F.when(first.isNotNull(), first["t"]["reason"])
        .when(F.col("_n") >= max_steps, F.lit("max_steps")).otherwise(F.lit("incomplete")).alias("finish_reason"),
        F.when(first.isNotNull(), first["step"] + first["t"]["ran"]).otherwise(F.col("_n")).cast("bigint")
        .alias("steps"),
        first["step"].cast("bigint").alias("terminal_step"),
    )


def confirm_complete(steps: DataFrame, run: str = "run_id", step: str = "step", parse_ok: str = "parse_ok",
                     complete: str = "is_complete") -> DataFrame:
    """Per run, the step at which a terminal agent finishes: the first parsed
    step marked complete whose previous *parsed* step was also complete
    (unparsable steps in between keep the pending flag).  NULL: never."""
    parsed = steps.where(F.col(parse_ok))
    w = Window.partitionBy(run).orderBy(step)
    prev_done = F.coalesce(F.lag(F.col(complete)).over(w), F.lit(False))
    confirmed = parsed.select(run, step, (F.col(complete) & prev_done).alias("_c"))
    runs = steps.select(run).distinct()
    fin = confirmed.where("_c").groupBy(run).agg(F.min(step).alias("finish_step"))
    return runs.join(fin, run, "left")


def terminal_delta(screens: DataFrame, run: str = "run_id", step: str = "step", buffer: str = "buffer",
                   visible: str = "visible") -> DataFrame:
    """Observation text per capture: the text after the last occurrence of the
    previous (stripped) buffer, or the visible screen when there is no
    previous buffer, it does not occur, or nothing new follows it."""
    w = Window.partitionBy(run).orderBy(step)
    pb = py_strip(F.lag(F.col(buffer)).over(w))
    cur = F.coalesce(F.col(buffer), F.lit(""))
    p = F.instr(F.reverse(cur), F.reverse(pb))
    found = pb.isNotNull() & (pb != "") & (p > 0)
    new_part = py_strip(F.substr(cur, F.length(cur) - p + 2))
    out = F.when(found & (new_part != ""), F.concat(F.lit("New Terminal Output:\n"), new_part)).otherwise(
        F.concat(F.lit("Current Terminal Screen:\n"), F.coalesce(F.col(visible), F.lit(""))))
    return screens.withColumn("observation", out)


def token_offsets(steps: DataFrame, budget: int, run: str = "run_id", step: str = "step",
                  prompt_len: str = "prompt_len", added: str = "added_tokens") -> DataFrame:
    """Sequence layout before each model call: ``seq_len`` = prompt length +
    response tokens of earlier steps, ``remaining = budget - seq_len - 128``;
    ``length`` marks steps whose call cannot generate (remaining <= 0).
    ``added`` is what a step appends (its model plus observation tokens)."""
    earlier = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    seq_len = F.col(prompt_len) + F.coalesce(F.sum(F.col(added).cast("bigint")).over(earlier), F.lit(0))
    out = steps.withColumn("seq_len", seq_len.cast("bigint"))
    return out.withColumn("remaining", (F.lit(budget) - F.col("seq_len") - 128).cast("bigint")).withColumn(
        "length", F.col("remaining") <= 0)
