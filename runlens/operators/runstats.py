"""Statistics over finished runs, agent steps and progress logs.

All aggregates have a map-side partial step before the shuffle; ordered
per-group work uses windows whose groups are bounded (blocks of a sequence,
or the first ``k`` rows of a group, which Spark limits before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.numeric import round_half_up, safe_rate

# Fixed values of the reference: the task type scored by partial pass rate,
# and its two thresholds.
DOMAIN_TASK = "doc2repo"
ALMOST_CORRECT = 0.9
CORRECT = 1.0


def _counts(score: Column, finish_reason: Column) -> list[Column]:
    total = F.count(F.lit(1))
    return [
        total.cast("bigint").alias("total"),
        F.count_if(score >= CORRECT).cast("bigint").alias("solved"),
        F.count_if(finish_reason == "error").cast("bigint").alias("error_count"),
        F.avg(score).alias("_avg"),
        F.count_if(score >= ALMOST_CORRECT).cast("bigint").alias("_almost"),
    ]


def task_stats(results: DataFrame, task: str = "task", score: str = "score",
               finish_reason: str = "finish_reason") -> DataFrame:
    """Per lower-cased task type; rows with an empty task are left out.

    ``doc2repo`` reports average score and >=0.9 / >=1.0 counts and rates;
    every other type reports solved count and rate.  Fields that the
    reference does not report for a type are NULL.
    """
    t = F.lower(F.coalesce(F.col(task), F.lit("")))
    grouped = (
        results.where(t != "")
        .groupBy(t.alias("task"))
        .agg(*_counts(F.col(score), F.col(finish_reason)))
    )
    is_dom = F.col("task") == DOMAIN_TASK
    dom = lambda c: F.when(is_dom, c)
    other = lambda c: F.when(~is_dom, c)
    return grouped.select(
        "task",
        "total",
        dom(round_half_up(F.col("_avg"), 4)).alias("avg_pass_rate"),
        dom(F.col("_almost")).alias("almost_correct_num"),
        dom(safe_rate(F.col("_almost"), F.col("total"))).alias("almost_correct_rate"),
        dom(F.col("solved")).alias("correct_num"),
        dom(safe_rate(F.col("solved"), F.col("total"))).alias("correct_rate"),
        other(F.col("solved")).alias("solved"),
        other(safe_rate(F.col("solved"), F.col("total"))).alias("solved_rate"),
        "error_count",
    )


def overall_stats(results: DataFrame, score: str = "score", finish_reason: str = "finish_reason") -> DataFrame:
    """Same counters over all rows, including rows without a task."""
    agg = results.agg(*_counts(F.col(score), F.col(finish_reason)))
    return agg.select(
        "total", "solved", safe_rate(F.col("solved"), F.col("total")).alias("solved_rate"), "error_count"
    )


def analysis_report(results: DataFrame, task: str = "task", score: str = "score",
                    finish_reason: str = "finish_reason") -> DataFrame:
    """Per-task statistics and the overall row from **one** aggregation,
    ``GROUPING SETS ((task), ())``: the overall row (``task = 'overall'``)
    counts every result, the per-task rows leave out empty tasks."""
    t = F.lower(F.coalesce(F.col(task), F.lit("")))
    base = results.select(t.alias("_task"), F.col(score).alias("_score"), F.col(finish_reason).alias("_fr"))
    agg = base.rollup("_task").agg(*_counts(F.col("_score"), F.col("_fr")), F.grouping("_task").alias("_g"))
    agg = agg.where((F.col("_g") == 1) | (F.col("_task") != ""))
    name = F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.col("_task"))
    is_dom = (F.col("_g") == 0) & (F.col("_task") == DOMAIN_TASK)
    dom = lambda c: F.when(is_dom, c)
    other = lambda c: F.when(~is_dom, c)
    return agg.select(
        name.alias("task"), "total",
        dom(round_half_up(F.col("_avg"), 4)).alias("avg_pass_rate"),
        dom(F.col("_almost")).alias("almost_correct_num"),
        dom(safe_rate(F.col("_almost"), F.col("total"))).alias("almost_correct_rate"),
        dom(F.col("solved")).alias("correct_num"),
        dom(safe_rate(F.col("solved"), F.col("total"))).alias("correct_rate"),
        other(F.col("solved")).alias("solved"),
        other(safe_rate(F.col("solved"), F.col("total"))).alias("solved_rate"),
        "error_count",
    )


def untagged_instances(results: DataFrame, task: str = "task") -> DataFrame:
    """Ids whose task is empty or missing (listed apart by the analysis)."""
    return results.where(F.coalesce(F.col(task), F.lit("")) == "").select("instance_id")


def run_summary(results: DataFrame, success: str = "success", error: str = "error") -> DataFrame:
    """succeeded / total returned / runs with a (non-empty) error."""
    return results.agg(
        F.count_if(F.coalesce(F.col(success), F.lit(False))).cast("bigint").alias("succeeded"),
        F.count(F.lit(1)).cast("bigint").alias("completed"),
        F.count_if(F.coalesce(F.col(error), F.lit("")) != "").cast("bigint").alias("errors"),
    )


def run_stats(calls: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: llm calls, token sums, model / tool time (rounded 3), steps.

    One input row is one step with one model call and its tool time.
    """
    return calls.groupBy(run).agg(
        F.count(F.lit(1)).cast("bigint").alias("llm_calls"),
        F.sum("prompt_tokens").cast("bigint").alias("total_prompt_tokens"),
        F.sum("completion_tokens").cast("bigint").alias("total_completion_tokens"),
        round_half_up(F.sum("llm_elapsed"), 3).alias("llm_time"),
        round_half_up(F.sum("tool_elapsed"), 3).alias("tool_time"),
        F.count(F.lit(1)).cast("bigint").alias("steps"),
    )


def tool_usage(calls: DataFrame, run: str = "run_id", tools: str = "tool_name",
               elapsed: str = "tool_elapsed") -> DataFrame:
    """Long ``(run, tool, n, tool_time)``; a step's tool time is split evenly
    over the calls of that step.  ``tools`` may be a name or an array of names.
    """
    dtype = dict(calls.dtypes)[tools]
    names = F.col(tools) if dtype.startswith("array") else F.array(F.col(tools))
    per_call = F.col(elapsed) / F.greatest(F.size(names), F.lit(1))
    exploded = calls.select(run, F.explode(names).alias("tool_name"), per_call.alias("_t"))
    return exploded.groupBy(run, "tool_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        round_half_up(F.sum("_t"), 3).alias("tool_time"),
    )


def tool_usage_wide(usage: DataFrame, tool_names: list[str], run: str = "run_id") -> DataFrame:
    """Counter as one column per tool; the tool list is given so that the
    pivot needs no extra pass to discover its values."""
    return usage.groupBy(run).pivot("tool_name", tool_names).agg(F.first("n")).fillna(0)


def dataset_inventory(instances: DataFrame, type_col: str = "task_type", lang_col: str = "language") -> DataFrame:
    """Instance counts by type and language with subtotals (ROLLUP)."""
    return instances.rollup(type_col, lang_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def instances_vs_results(requested: DataFrame, results: DataFrame, key: str = "instance_id") -> DataFrame:
    """Requested ids that never reached the results table (exhausted retries
    are returned in memory but not written)."""
    return requested.select(key).join(results.select(key), key, "left_anti")


def preview_n(instances: DataFrame, n: int = 20, key: str = "instance_id", image: str = "image") -> DataFrame:
    """Dry-run listing: first ``n`` ids (by id) and a "... and k more" line.

    The first ``n`` come from a distributed top-k (``orderBy().limit()``), the
    remainder from a global count; the two are unioned, never cross-joined.
    """
    img = F.coalesce(F.nullif(F.left(F.col(image), F.lit(50)), F.lit("")), F.lit("none"))
    head = instances.orderBy(key).limit(n).select(
        F.lit(0).alias("_k"), F.col(key).alias("_id"),
        F.concat(F.lit("  "), F.col(key), F.lit(" (image="), img, F.lit(")")).alias("line"),
    )
    head = head.select(
        F.row_number().over(Window.partitionBy("_k").orderBy("_id")).cast("bigint").alias("line_no"), "line"
    )
    total = instances.agg(F.count(F.lit(1)).alias("_n"))
    more = total.where(F.col("_n") > n).select(
        F.lit(n + 1).cast("bigint").alias("line_no"),
        F.concat(F.lit("  ... and "), (F.col("_n") - n).cast("string"), F.lit(" more")).alias("line"),
    )
    return head.unionByName(more)


def best_attempt(attempts: DataFrame, max_retries: int = 3, key: str = "instance_id",
                 seq: str = "seq", ok: str = "returned", error: str = "error") -> DataFrame:
    """Up to ``max_retries`` attempts per instance: the first attempt that
    returned wins, else the last attempt's error.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot instance ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(key).orderBy(seq)
    first_k = attempts.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= max_retries)
    rec = F.struct(F.col("attempt"), F.col(seq).alias("seq"), F.col(error).alias("error"))
    agg = first_k.groupBy(key).agg(
        F.min(F.when(F.col(ok), rec)).alias("_ok"),
        F.max(rec).alias("_last"),
    )
    won = F.col("_ok").isNotNull()
    return agg.select(
        key,
        won.alias("returned"),
        F.when(won, F.col("_ok.attempt")).otherwise(F.col("_last.attempt")).cast("bigint").alias("attempts_used"),
        F.when(won, F.col("_ok.seq")).otherwise(F.col("_last.seq")).alias("final_seq"),
        F.when(won, F.lit(None).cast("string")).otherwise(F.col("_last.error")).alias("last_error"),
    )


def running_totals(df: DataFrame, order_col: str, increments: dict[str, Column],
                   partition_cols: tuple[str, ...] = (), block_size: int = 1 << 20) -> DataFrame:
    """Running sums in ``order_col`` order without a single-partition window.

    Two-pass prefix sum: rows are cut into blocks of ``block_size`` sequence
    numbers; block totals (1/block_size of the data) get their offsets from a
    window over the small block table; each block then runs its own window
    in parallel and adds its offset.  ``order_col`` must be a unique integer
    sequence within the partition columns.
    """
    parts = list(partition_cols)
    names = list(increments)
    d = df.select("*", *[increments[k].cast("bigint").alias(f"_inc_{k}") for k in names]).withColumn(
        "_blk", F.floor(F.col(order_col) / F.lit(block_size))
    )
    blocks = d.groupBy(*parts, "_blk").agg(*[F.sum(f"_inc_{k}").alias(f"_bt_{k}") for k in names])
    wb = Window.partitionBy(*parts).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *parts, "_blk", *[F.coalesce(F.sum(f"_bt_{k}").over(wb), F.lit(0)).alias(f"_off_{k}") for k in names]
    )
    wr = Window.partitionBy(*parts, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(offsets, [*parts, "_blk"], "left")
    for k in names:
        out = out.withColumn(k, (F.sum(f"_inc_{k}").over(wr) + F.col(f"_off_{k}")).cast("bigint"))
    return out.drop("_blk", *[f"_inc_{k}" for k in names], *[f"_off_{k}" for k in names])


def progress_running(progress: DataFrame, status: str = "status", order_col: str = "seq",
                     partition_cols: tuple[str, ...] = (), block_size: int = 1 << 20) -> DataFrame:
    """Live counters of the evaluation progress bar.

    A status containing "failed" or "unresolved" counts as F (tested first),
    one containing "passed" or "resolved" as P, anything else as E.
    """
    s = F.coalesce(F.col(status), F.lit(""))
    is_f = s.contains("failed") | s.contains("unresolved")
    is_p = ~is_f & (s.contains("passed") | s.contains("resolved"))
    is_e = ~is_f & ~is_p
    inc = {
        "completed": F.lit(1),
        "resolved": is_p.cast("int"),
        "unresolved": is_f.cast("int"),
        "errored": is_e.cast("int"),
    }
    return running_totals(progress, order_col, inc, partition_cols, block_size)
