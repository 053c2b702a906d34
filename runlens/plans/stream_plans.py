"""Queries for the streaming jobs.

Each query appends its stand-in input (rows derived from the driver tables)
to a landing folder in several waves (one write job per wave), runs the
stream with an ``availableNow`` trigger and a checkpoint, and returns the
sink read back -- streaming output must equal the batch result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.plans.registry import register
from runlens.session import scratch_path
from runlens.streaming.step_order import stream_step_hooks
from runlens.streaming import streams as ST
from runlens.streaming import watchdog as WD

# the landing files carry no seq for instances with an odd number: their order is
# that of the waves, and of the lines in a wave's file
_NO_SEQ = "CAST(substr(instance_id, 3) AS BIGINT) % 2 = 1"
_LAST = f"""last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id
                     ORDER BY CASE WHEN {_NO_SEQ} THEN seq % 4 ELSE seq END DESC, seq DESC) rn
                   FROM fx_progress WHERE instance_id IS NOT NULL AND instance_id <> '') t WHERE rn = 1)"""


def _dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/landing", f"{base}/out", f"{base}/checkpoint"


def _land(df: DataFrame, wave: str, n_waves: int, path: str, **options) -> None:
    """Append the rows to ``path`` in ``n_waves`` separate write jobs."""
    for k in range(n_waves):
        df.where(F.col(wave) == k).drop(wave).write.mode("append").json(path, **options)


def _land_log(df: DataFrame, wave: str, n_waves: int, path: str) -> None:
    """The same, with each instance's lines of a wave in one file, by ``seq``."""
    for k in range(n_waves):
        rows = df.where(F.col(wave) == k).repartition("instance_id").sortWithinPartitions("seq")
        rows.withColumn("seq", F.when(F.expr(f"NOT ({_NO_SEQ})"), F.col("seq"))).drop(wave).write.mode("append").json(path)


def _per_batch(spark: SparkSession, path: str, batches: int, least: int) -> int:
    """Files for a micro-batch: ``least`` or as many as make ``batches`` of those in
    ``path``.  A micro-batch has a task for each state partition, so there must not
    be more of them the more files the input was dealt to."""
    files = len(spark.read.text(path).inputFiles())  # those without rows count too
    return max(least, -(-files // batches))


def _progress_rows(spark, sf):
    prog = fixture(spark, sf, "fx_progress")
    details = F.when(F.col("details_error").isNotNull(), F.struct(F.col("details_error").alias("error")))
    return prog.select("seq", "instance_id", "status", "accepted", "duration", details.alias("details"),
                       (F.col("seq") % 4).alias("_wave"))


def _mixed_rows(spark, sf):
    """The same records, some with only ``outcome``, some with only ``error``."""
    rows = _progress_rows(spark, sf)
    only_outcome, only_error = F.col("seq") % 29 == 0, F.col("seq") % 31 == 0
    other = only_outcome | only_error
    return rows.withColumns({
        "status": F.when(~other, F.col("status")),
        "outcome": F.when(only_outcome, F.lit("passed")),
        "accepted": F.when(~only_outcome, F.col("accepted")),
        "details": F.when(~other, F.col("details")),
        "error": F.when(only_error & ~only_outcome, F.lit("exit 1")),
    })


@register(
    "stream_progress_latest",
    oracle_with("fx_progress") + ",\n" + _LAST
    + f"\nSELECT instance_id, CASE WHEN {_NO_SEQ} THEN NULL ELSE seq END AS seq, status, accepted, duration, details_error FROM last",
)
def q_stream_progress_latest(spark, sf):
    landing, out, ckpt = _dirs(spark, "progress-latest")
    _land_log(_progress_rows(spark, sf), "_wave", 4, landing)
    q = ST.start_progress_latest(ST.read_progress_stream(spark, landing, files_per_trigger=_per_batch(spark, landing, 4, 8)), out, ckpt)
    q.awaitTermination()
    return ST.latest_view(spark, out).select("instance_id", "seq", "status", "accepted", "duration", "details_error")


@register(
    "stream_progress_counts",
    oracle_with("fx_progress") + ",\n" + _LAST + """
SELECT CASE WHEN seq % 29 = 0 THEN 'passed' WHEN seq % 31 = 0 THEN 'error'
            WHEN status IN ('passed','failed','error') THEN status WHEN details_error IS NOT NULL THEN 'error'
            WHEN coalesce(accepted, false) THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS n
FROM last GROUP BY 1""",
)
def q_stream_progress_counts(spark, sf):
    landing, out, ckpt = _dirs(spark, "progress-counts")
    _land_log(_mixed_rows(spark, sf), "_wave", 4, landing)
    q = ST.start_progress_counts(ST.read_progress_stream(spark, landing, files_per_trigger=_per_batch(spark, landing, 4, 8)), out, ckpt)
    q.awaitTermination()
    return ST.progress_counts(spark, out)


# stand-in sample groups for the collector: 4 consecutive samples per group
# (groups grow in number, not size, with the table)
_GROUP = "CAST(floor(sample_index / 4) AS BIGINT)"


def _sample_waves(spark: SparkSession, sf: str, landing: str, start) -> None:
    """The stand-in samples in three waves; the expected group size travels
    with each.  Every fifth group gets one sample too many, all of them in one
    file.  After a run of the stream every seventh gets its samples again, now
    that it is complete, and the stream goes on from its checkpoint."""
    s = fixture(spark, sf, "fx_samples").withColumn("group_id", F.expr(_GROUP))
    sizes = s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    over = (F.col("group_id") % 5 == 0) & (F.col("n") > 1)
    rows = s.join(sizes, "group_id").withColumn("group_size", F.col("n") - over.cast("int"))
    first = rows.withColumn("_wave", F.when(over, 0).otherwise(F.col("sample_index") % 3))
    late = rows.where("group_id % 7 = 3").withColumn("_wave", F.lit(0)).withColumn("status", F.lit("aborted"))
    for rows, n_waves in ((first, 3), (late, 1)):
        _land(rows.drop("n").repartition("group_id"), "_wave", n_waves, landing)
        start(spark.readStream.schema(ST.SAMPLE_STREAM_SCHEMA).option(
            "maxFilesPerTrigger", _per_batch(spark, landing, 3, 4)).json(landing)).awaitTermination()


@register(
    "stream_groups",
    oracle_with("fx_samples") + f"""
SELECT {_GROUP} AS group_id, CASE WHEN bool_or(status = 'aborted') THEN 'retry' ELSE 'batch' END AS route,
  count(*) AS n_samples, min(sample_index) AS first_index, count(*) FILTER (WHERE status = 'aborted') AS n_aborted
FROM fx_samples GROUP BY 1""",
)
def q_stream_groups(spark, sf):
    landing, out, ckpt = _dirs(spark, "groups")
    _sample_waves(spark, sf, landing, lambda stream: ST.start_groups(stream, out, ckpt))
    return spark.read.parquet(out)


# groups collected before the stream stops taking more: half of those not aborted
_TARGET = "(SELECT CAST(ceil(count(*) / 2.0) AS BIGINT) FROM g WHERE NOT aborted)"


@register(
    "stream_collector",
    oracle_with("fx_samples") + f""",
g AS (SELECT {_GROUP} AS group_id, bool_or(status = 'aborted') AS aborted FROM fx_samples GROUP BY 1)
SELECT 'batch' AS route, {_TARGET} AS n UNION ALL
SELECT 'queued', count(*) - {_TARGET} FROM g WHERE NOT aborted HAVING count(*) > {_TARGET} UNION ALL
SELECT 'retry', count(*) FROM g WHERE aborted HAVING count(*) > 0""",
)
def q_stream_collector(spark, sf):
    landing, out, ckpt = _dirs(spark, "collector")
    whole = fixture(spark, sf, "fx_samples").groupBy(F.expr(_GROUP).alias("g")).agg(F.bool_or(F.col("status") == "aborted").alias("a"))
    target = -(-whole.where("NOT a").count() // 2)
    _sample_waves(spark, sf, landing, lambda stream: ST.start_collector(stream, out, ckpt, target))
    return spark.read.parquet(f"{out}/groups").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_watchdog",
    """WITH c AS (SELECT user_id AS rollout_id, event_id, epoch_us(ts) / 1000000.0 AS ts_seconds FROM events),
g AS (SELECT rollout_id, event_id, ts_seconds - lag(ts_seconds) OVER (PARTITION BY rollout_id
        ORDER BY ts_seconds, event_id) AS gap FROM c)
SELECT rollout_id, event_id, CAST(gap AS DOUBLE) AS gap_seconds, CAST(ceil(gap / 30.0) - 1 AS BIGINT) AS warnings
FROM g WHERE gap > 30""",
)
def q_stream_watchdog(spark, sf):
    ev = read_table(spark, sf, "events")
    # stand-in: each user's events are one collector's completions
    rows = ev.select(F.col("user_id").alias("rollout_id"), "event_id",
                     (WD.epoch_micros(ev.schema["ts"].dataType, F.col("ts")) / 1_000_000.0).alias("ts_seconds"))
    landing, out, ckpt = _dirs(spark, "watchdog")
    # four waves that follow each other in time, a file each, so that gaps reach over micro-batches
    cuts = rows.agg(F.percentile_approx("ts_seconds", [0.25, 0.5, 0.75])).first()[0] or []
    wave = sum((F.coalesce(F.col("ts_seconds") >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    _land(rows.withColumn("_wave", wave).repartition("rollout_id"), "_wave", 4, landing)
    files = spark.read.text(landing).select(F.input_file_name().alias("f")).distinct().count()
    stream = spark.readStream.schema("rollout_id bigint, event_id bigint, ts_seconds double").option(
        "maxFilesPerTrigger", max(1, files // 4)).json(landing)
    writer = (WD.watchdog_stream(stream).writeStream.outputMode("append").format("parquet").option("path", out)
              .option("checkpointLocation", ckpt))
    ST.start_stateful(writer, spark).awaitTermination()
    return spark.read.parquet(out)


def count_calls(memo, step):
    """Example step callback: the tool calls a run has made so far."""
    memo = (memo or 0) + (step["tool_name"] != "finish")
    return memo, {"calls_so_far": memo}


@register(
    "stream_step_hook",
    oracle_with("fx_calls") + """
SELECT run_id, step, CAST(sum(CASE WHEN tool_name <> 'finish' THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS calls_so_far
FROM fx_calls""",
)
def q_stream_step_hook(spark, sf):
    # the waves hold the steps out of order: the last ones of a run come first
    calls = fixture(spark, sf, "fx_calls").select("run_id", F.col("step").cast("long").alias("step"), "tool_name")
    rows = calls.withColumn("ts", F.timestamp_seconds(F.col("step") + 1_700_000_000)).withColumn("_wave", F.lit(2) - F.col("step") % 3)
    landing, out, ckpt = _dirs(spark, "step-hook")
    staged = f"{landing}-rows"  # worked out once for all waves
    rows.write.partitionBy("_wave").parquet(staged)
    _land(spark.read.schema(rows.schema).parquet(staged), "_wave", 3, landing, compression="snappy")
    stream = spark.readStream.schema("run_id bigint, step bigint, tool_name string, ts timestamp").option(
        "maxFilesPerTrigger", _per_batch(spark, landing, 3, 1)).json(landing)
    writer = (stream_step_hooks(stream, count_calls, "calls_so_far long").writeStream.outputMode("append").format("parquet")
              .option("path", out).option("checkpointLocation", ckpt))
    ST.start_stateful(writer, spark).awaitTermination()
    return spark.read.parquet(out).select("run_id", "step", "calls_so_far")


_RUN = "concat('m1_20260101_00000', right(instance_id, 1))"


@register(
    "stream_results_append",
    oracle_with("fx_results") + f"\nSELECT {_RUN} AS run_id, instance_id, task, score, finish_reason FROM fx_results",
)
def q_stream_results_append(spark, sf):
    res = fixture(spark, sf, "fx_results").select(F.expr(_RUN).alias("run_id"), "instance_id", "task", "score",
                                                  "finish_reason", (F.length("instance_id") % 3).alias("_wave"))
    landing, out, ckpt = _dirs(spark, "results")
    _land(res, "_wave", 3, landing)
    stream = spark.readStream.schema(ST.RESULT_STREAM_SCHEMA).option(
        "maxFilesPerTrigger", _per_batch(spark, landing, 3, 4)).json(landing)
    ST.start_results_append(stream, out, ckpt).awaitTermination()
    back = spark.read.schema("instance_id string, task string, score double, finish_reason string, run_id string") \
        .parquet(out)
    return back.select("run_id", "instance_id", "task", "score", "finish_reason")
