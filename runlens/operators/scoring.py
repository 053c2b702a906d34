"""Offline scoring of predictions: progress log, outcomes and report buckets.

Pipeline (all lazy, one shuffle on ``instance_id`` per input side):

    instances ⟕ predictions ⟕ latest_progress(progress)
        -> classify_status -> instance_status -> bucket counts

Nothing is collected: the report is a long ``(instance_id, bucket)`` table
plus a ``groupBy(bucket).count()``; id lists exist only as sorted long tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import col_or_null, is_blank

TERMINAL = ("passed", "failed")
OUTCOMES = ("passed", "failed", "error")
BUCKETS = ("incomplete", "empty_patch", "resolved", "unresolved", "error")


def latest_progress(progress: DataFrame, key: str = "instance_id", seq: str = "seq") -> DataFrame:
    """Last record per id in log order: by ``seq``, then by ``log_pos`` where
    the log has that column (``scan_progress``; files without sequence numbers).

    Rows without an id (NULL or '') are dropped as in the reference loader.
    Written as a ``max(struct(seq, ...))`` aggregate rather than a
    ``row_number`` window: the aggregate has a map-side partial step (Spark
    runs a struct ``max`` as a sort-based aggregate), so a hot id that owns a
    third of the log is reduced to one row per map task before the shuffle
    instead of being shipped whole to one task.  Callers pass only the
    columns they need (``outcome_inputs``).  Ties on ``seq`` resolve on the
    remaining fields, which keeps the result deterministic.
    """
    others = [c for c in progress.columns if c not in (key, seq)]
    others.sort(key=lambda c: c != "log_pos")
    rec = F.struct(F.col(seq).alias(seq), *[F.col(c).alias(c) for c in others])
    latest = (
        progress.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.max(rec).alias("_last"))
        .select(key, "_last.*")
    )
    return latest.drop("log_pos")


def classify_status(
    df: DataFrame,
    status: str = "status",
    outcome: str = "outcome",
    has_error: str = "has_error_key",
    details_error: str = "details_error",
    has_details_error: str = "has_details_error",
    accepted: str = "accepted",
) -> Column:
    """status -> outcome -> ``error`` key present -> ``details.error`` -> accepted.

    Absent columns are treated as absent keys, so the same expression serves
    progress logs with or without ``outcome``/``error`` fields.
    """
    cols = df.columns
    st, oc = col_or_null(cols, status), col_or_null(cols, outcome)
    err_key = F.coalesce(col_or_null(cols, has_error).cast("boolean"), F.lit(False))
    det_err = col_or_null(cols, details_error).isNotNull() | F.coalesce(
        col_or_null(cols, has_details_error).cast("boolean"), F.lit(False))
    acc = F.coalesce(col_or_null(cols, accepted).cast("boolean"), F.lit(False))
    return (
        F.when(st.isin(*OUTCOMES), st)
        .when(oc.isin(*OUTCOMES), oc)
        .when(err_key, F.lit("error"))
        .when(det_err, F.lit("error"))
        .when(acc, F.lit("passed"))
        .otherwise(F.lit("failed"))
    )


OUTCOME_FIELDS = ("status", "outcome", "has_error_key", "details_error", "has_details_error", "accepted")


def outcome_inputs(progress: DataFrame, key: str = "instance_id", seq: str = "seq") -> DataFrame:
    """Only the columns the outcome needs, so the per-id reduction carries
    (and the scan reads) nothing else."""
    return progress.select(key, seq, *[c for c in ("log_pos", *OUTCOME_FIELDS) if c in progress.columns])


def with_outcome(progress: DataFrame) -> DataFrame:
    """Progress rows with their classified ``outcome`` and ``terminal`` flag."""
    out = classify_status(progress)
    return progress.withColumn("outcome_class", out).withColumn(
        "terminal", out.isin(*TERMINAL)
    )


def empty_patch(patch: Column) -> Column:
    """NULL or whitespace-only patch (Python ``not p or not p.strip()``)."""
    return is_blank(patch)


def join_predictions(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Dataset ⟕ predictions on ``instance_id``; orphan predictions vanish.

    ``has_prediction`` keeps the difference between "no prediction" and a
    prediction whose patch is NULL.
    """
    preds = predictions.select(
        "instance_id", "model_name_or_path", "model_patch", F.lit(True).alias("has_prediction")
    )
    return instances.join(preds, "instance_id", "left").withColumn(
        "has_prediction", F.coalesce(F.col("has_prediction"), F.lit(False))
    )


def orphan_predictions(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions whose id is not in the dataset (audit of ignored rows)."""
    return predictions.join(instances.select("instance_id"), "instance_id", "left_anti")


def pending_work(predictions: DataFrame, progress: DataFrame) -> DataFrame:
    """Resume set: non-empty patches without a terminal cached record.

    Errors are not terminal, so an instance whose last record is an error is
    evaluated again.
    """
    last = with_outcome(latest_progress(outcome_inputs(progress)))
    done = last.filter(F.col("terminal")).select("instance_id")
    return predictions.filter(~empty_patch(F.col("model_patch"))).join(
        done, "instance_id", "left_anti"
    )


def attach_outcome(joined: DataFrame, progress: DataFrame) -> DataFrame:
    """Evaluated rows ⟕ latest result, with the reference's error rules.

    A missing result raises in the reference (-> ``error``); a record that
    carries an ``error`` key raises too, before its status is looked at.
    Adds ``result_found`` and ``outcome`` (passed / failed / error).
    """
    last = latest_progress(outcome_inputs(progress))
    last = last.select(
        "instance_id",
        classify_status(last).alias("_cls"),
        F.coalesce(col_or_null(last.columns, "has_error_key").cast("boolean"), F.lit(False)).alias(
            "_err_key"
        ),
        F.lit(True).alias("result_found"),
    )
    out = joined.join(last, "instance_id", "left")
    outcome = (
        F.when(F.col("result_found").isNull(), F.lit("error"))
        .when(F.col("_err_key"), F.lit("error"))
        .otherwise(F.col("_cls"))
    )
    return (
        out.withColumn("outcome", outcome)
        .withColumn("result_found", F.coalesce(F.col("result_found"), F.lit(False)))
        .drop("_cls", "_err_key")
    )


def instance_status(instances: DataFrame, predictions: DataFrame, progress: DataFrame) -> DataFrame:
    """One row per dataset instance with its report bucket."""
    joined = join_predictions(instances.select("instance_id"), predictions)
    scored = attach_outcome(joined, progress)
    bucket = (
        F.when(~F.col("has_prediction"), F.lit("incomplete"))
        .when(empty_patch(F.col("model_patch")), F.lit("empty_patch"))
        .when(F.col("outcome") == "passed", F.lit("resolved"))
        .when(F.col("outcome") == "failed", F.lit("unresolved"))
        .otherwise(F.lit("error"))
    )
    return scored.select("instance_id", bucket.alias("bucket"))


def bucket_report(status: DataFrame) -> DataFrame:
    """Counts per bucket (long form; the JSON view is built from it on request)."""
    return status.groupBy("bucket").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def report_totals(status: DataFrame) -> DataFrame:
    """Single summary row: total / submitted / completed and per-bucket counts.

    ``completed = resolved + unresolved + error``; ``submitted`` excludes only
    ``incomplete``.
    """
    b = F.col("bucket")
    return status.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_instances"),
        F.count_if(b != "incomplete").cast("bigint").alias("submitted_instances"),
        F.count_if(b.isin("resolved", "unresolved", "error")).cast("bigint").alias(
            "completed_instances"
        ),
        F.count_if(b == "resolved").cast("bigint").alias("resolved_instances"),
        F.count_if(b == "unresolved").cast("bigint").alias("unresolved_instances"),
        F.count_if(b == "error").cast("bigint").alias("error_instances"),
        F.count_if(b == "empty_patch").cast("bigint").alias("empty_patch_instances"),
    )


def sorted_buckets(status: DataFrame) -> DataFrame:
    """Every id list of the report as a long table ordered by code point.

    ``(list_name, instance_id)`` rows; ``submitted`` and ``completed`` are the
    derived lists.  Binary UTF-8 order equals code-point order, so a plain
    ``orderBy`` reproduces Python's ``sorted``.  The sort is a range-partitioned
    distributed sort, never a single-task list.
    """
    b = F.col("bucket")
    lists = F.array(
        b,
        F.when(b != "incomplete", F.lit("submitted")),
        F.when(b.isin("resolved", "unresolved", "error"), F.lit("completed")),
    )
    return (
        status.select("instance_id", F.explode(lists).alias("list_name"))
        .filter(F.col("list_name").isNotNull())
        .select("list_name", "instance_id")
        .orderBy("list_name", "instance_id")
    )


def completed_union(status: DataFrame) -> DataFrame:
    """resolved ∪ unresolved ∪ error ids (UNION ALL as one filter)."""
    return status.filter(F.col("bucket").isin("resolved", "unresolved", "error")).select(
        "instance_id", "bucket"
    )


def report_json_chunks(status: DataFrame, ids_per_chunk: int = 100_000) -> DataFrame:
    """The report's id lists as ``(bucket, chunk, ids)`` rows for a JSON view.

    Ids are range-partitioned on ``(bucket, instance_id)``, so each chunk is a
    contiguous, sorted run of one bucket's ids and holds about
    ``ids_per_chunk`` of them; reading chunks in ``(bucket, chunk)`` order
    gives each sorted list.  No list is ever built whole in one task.  The
    number of chunks comes from one row count."""
    n = status.count()
    parts = max(1, -(-n // ids_per_chunk))
    ranged = status.select("bucket", "instance_id").repartitionByRange(parts, "bucket", "instance_id")
    chunked = ranged.withColumn("chunk", F.spark_partition_id())
    return chunked.groupBy("bucket", "chunk").agg(F.array_sort(F.collect_list("instance_id")).alias("ids"))
