"""Structured Streaming jobs for the two append-driven paths: the evaluation
progress log and the RL sample collector, plus the results append.

All streams are checkpointed and resume from their checkpoint.  File sinks
are exactly-once; ``foreachBatch`` sinks are written so that a replayed batch
changes nothing (epoch-partitioned logs whose epochs are overwritten).  None of
the outputs goes through the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.scoring import classify_status
from runlens.sources.readers import place_stream_lines, progress_records
from runlens.sources.tail import tail_lines
from runlens.streaming.processors import complete_groups, outcome_changes


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful(writer, spark: SparkSession, available_now: bool = True, timed: bool = False):
    """Start a ``transformWithState`` query.  Such state needs a store with
    column families, which Spark's default provider lacks; a session that has
    the default gets RocksDB for this query.

    ``timed``: its state has processing-time expiry.  Such a query may always run
    one more batch without data; an ``availableNow`` run would never end, so there
    expiry waits for the next batch with data."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    wanted = {provider: ROCKSDB} if spark.conf.get(provider).endswith(".HDFSBackedStateStoreProvider") else {}
    if available_now and timed:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    were = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)  # a started query keeps the settings it was started with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for key, value in were.items():
            spark.conf.set(key, value)


def read_progress_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Progress records of files as they appear, with the columns of
    ``scan_progress``: the same parser, so ``outcome`` and the presence of an
    error key reach the classification, and the same ``log_pos``, so records
    without ``seq`` have the order they have in a batch read."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return progress_records(place_stream_lines(reader.text(path)))


def tail_progress_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """The same columns from log files that writers append to in place."""
    return progress_records(tail_lines(spark, pattern))


# ── latest record per instance (update mode, upsert log) ───────────────────


def progress_latest_updates(stream: DataFrame) -> DataFrame:
    """Streaming aggregate: the last record per instance, by ``seq`` and then
    by ``log_pos`` (logs without sequence numbers), as ``latest_progress``.

    ``max(struct(seq, log_pos, …))`` keeps one row of state per instance id (the
    dataset size bounds it); update mode emits only the ids that changed."""
    others = sorted((c for c in stream.columns if c not in ("instance_id", "seq")), key=lambda c: c != "log_pos")
    rec = F.struct(F.col("seq"), *[F.col(c) for c in others])
    return stream.groupBy("instance_id").agg(F.max(rec).alias("last"))


def start_progress_latest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Append each micro-batch's changed ids to an upsert log partitioned by
    batch id; the current view is the newest row per id (``latest_view``).
    A replayed batch rewrites rows with the same epoch, so the view is
    unchanged (idempotent)."""
    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("append").partitionBy("epoch").parquet(out)

    w = (progress_latest_updates(stream).writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest_view(spark: SparkSession, out: str, snapshot: str | None = None) -> DataFrame:
    """The newest emitted row per id.

    With a ``snapshot`` written by ``compact_latest``, only log epochs after
    the snapshot's are read (partition pruning on ``epoch``), so the read
    stays proportional to the changes since the last compaction."""
    log = spark.read.parquet(out).select("instance_id", "last", "epoch")
    if snapshot is not None:
        snap = spark.read.parquet(snapshot)
        since = snap.agg(F.max("epoch")).collect()[0][0]
        if since is not None:
            log = log.where(F.col("epoch") > F.lit(since)).unionByName(snap.select("instance_id", "last", "epoch"))
    return log.groupBy("instance_id").agg(F.max_by("last", "epoch").alias("last")).select("instance_id", "last.*").drop("log_pos")


def compact_latest(spark: SparkSession, out: str, snapshot: str, previous: str | None = None) -> None:
    """Write the current view (with each row's epoch) as a new snapshot
    folder; later reads pass it to ``latest_view``.  The upsert log's older
    epoch partitions are no longer read and can be expired by retention."""
    log = spark.read.parquet(out).select("instance_id", "last", "epoch")
    if previous is not None:
        prev = spark.read.parquet(previous)
        since = prev.agg(F.max("epoch")).collect()[0][0]
        if since is not None:
            log = log.where(F.col("epoch") > F.lit(since)).unionByName(prev.select("instance_id", "last", "epoch"))
    newest = log.groupBy("instance_id").agg(F.max_by(F.struct("last", "epoch"), "epoch").alias("r"))
    newest.select("instance_id", "r.last", "r.epoch").write.mode("overwrite").parquet(snapshot)


# ── live counters (changes of each instance's outcome) ─────────────────────


def _before(spark: SparkSession, out: str, epoch: int) -> DataFrame | None:
    """The rows of the newest epoch below ``epoch``, None without one."""
    try:
        log = spark.read.parquet(out).where(F.col("epoch") < epoch)
    except AnalysisException:  # nothing written yet
        return None
    newest = log.agg(F.max("epoch")).first()[0]
    return None if newest is None else log.where(F.col("epoch") == newest).drop("epoch")


def start_progress_counts(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Instances by the outcome of their last record, as they change.

    Each instance whose outcome changes sends -1 for the old and +1 for the
    new one; an epoch's row per outcome is the epoch before plus its changes,
    so every epoch holds the counts after its micro-batch and a replayed one
    overwrites itself with the same rows."""
    def add(batch: DataFrame, epoch: int) -> None:
        changes = batch.groupBy("outcome").agg(F.sum("delta").alias("n"))
        before = _before(batch.sparkSession, out, epoch)
        both = changes if before is None else before.unionByName(changes)
        both.groupBy("outcome").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    records = stream.select("instance_id", "seq", "log_pos", classify_status(stream).alias("outcome"))
    w = outcome_changes(records).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
    return start_stateful(w, stream.sparkSession, available_now)


def progress_counts(spark: SparkSession, out: str, epoch: int | None = None) -> DataFrame:
    """``outcome, n`` after the newest micro-batch (or after ``epoch``)."""
    log = spark.read.parquet(out)
    at = log.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    return log.where((F.col("epoch") == at) & (F.col("n") > 0)).select("outcome", "n")


# ── sample groups ──────────────────────────────────────────────────────────


SAMPLE_STREAM_SCHEMA = "group_id bigint, sample_index bigint, status string, n_tokens bigint, group_size bigint"


def start_groups(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, **options):
    """``complete_groups`` with a file sink: one row per complete group, route
    ``retry`` if a sample was aborted, else ``batch``."""
    w = (complete_groups(stream, **options).writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint))
    return start_stateful(w, stream.sparkSession, available_now, timed=True)


def start_collector(stream: DataFrame, out: str, checkpoint: str, target: int, available_now: bool = True, **options):
    """Complete groups until ``target`` are collected: groups beyond it have
    route ``queued`` (they wait for the next batch), aborted ones ``retry``.

    Groups of one micro-batch are taken by id.  Only ids up to the target are
    ranked; each epoch also holds how many were collected, so a replayed epoch
    is the same."""
    def take(batch: DataFrame, epoch: int) -> None:
        before = _before(batch.sparkSession, f"{out}/collected", epoch)
        had = 0 if before is None else before.first()["n"]
        done = batch.persist()
        first = done.where("route = 'batch'").select("group_id").orderBy("group_id").limit(max(target - had, 0))
        routed = done.join(first.withColumn("taken", F.lit(True)), "group_id", "left").withColumn(
            "route", F.when((F.col("route") == "batch") & F.col("taken").isNull(), F.lit("queued")).otherwise(F.col("route"))).drop("taken")
        routed.write.mode("overwrite").parquet(f"{out}/groups/epoch={epoch}")
        taken = first.agg((F.count(F.lit(1)) + had).alias("n"))
        taken.write.mode("overwrite").parquet(f"{out}/collected/epoch={epoch}")
        done.unpersist()

    w = complete_groups(stream, **options).writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", checkpoint)
    return start_stateful(w, stream.sparkSession, available_now, timed=True)


# ── results append (exactly once) ──────────────────────────────────────────

RESULT_STREAM_SCHEMA = "run_id string, instance_id string, task string, score double, finish_reason string"


def start_results_append(stream: DataFrame, out: str, checkpoint: str):
    """Concurrent runs append their result rows; the file sink's commit log
    makes every row land exactly once (replaces the reference's file lock)."""
    return (stream.writeStream.outputMode("append").format("parquet").partitionBy("run_id")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
