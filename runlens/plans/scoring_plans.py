"""Queries for offline scoring: progress, outcomes, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with
from runlens.operators import scoring as S
from runlens.plans.registry import register

_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY seq DESC) rn
                   FROM fx_progress WHERE instance_id IS NOT NULL AND instance_id <> '') t WHERE rn = 1)"""

_CLASSIFY = """CASE WHEN {p}status IN ('passed','failed','error') THEN {p}status
            WHEN {p}details_error IS NOT NULL THEN 'error'
            WHEN coalesce({p}accepted, false) THEN 'passed' ELSE 'failed' END"""

_STATUS_CTE = (
    oracle_with("fx_instances", "fx_predictions", "fx_progress")
    + ",\n"
    + _LAST
    + """,
st AS (SELECT i.instance_id,
  CASE WHEN p.instance_id IS NULL THEN 'incomplete'
       WHEN regexp_matches(coalesce(p.model_patch, ''), '^\\s*$') THEN 'empty_patch'
       WHEN l.instance_id IS NULL THEN 'error'
       ELSE CASE """
    + _CLASSIFY.format(p="l.")
    + """ WHEN 'passed' THEN 'resolved' WHEN 'failed' THEN 'unresolved' ELSE 'error' END END AS bucket
  FROM fx_instances i LEFT JOIN fx_predictions p ON i.instance_id = p.instance_id
                      LEFT JOIN last l ON i.instance_id = l.instance_id)
"""
)


def _status(spark, sf):
    return S.instance_status(
        fixture(spark, sf, "fx_instances"),
        fixture(spark, sf, "fx_predictions"),
        fixture(spark, sf, "fx_progress"),
    )


@register("bucket_report", _STATUS_CTE + "SELECT bucket, count(*)::BIGINT AS n FROM st GROUP BY bucket")
def q_bucket_report(spark, sf):
    """Flagship: per-bucket counts of the offline scoring report."""
    return S.bucket_report(_status(spark, sf))


@register(
    "sorted_buckets",
    _STATUS_CTE
    + """SELECT list_name, instance_id FROM (
  SELECT bucket AS list_name, instance_id FROM st
  UNION ALL SELECT 'submitted', instance_id FROM st WHERE bucket <> 'incomplete'
  UNION ALL SELECT 'completed', instance_id FROM st WHERE bucket IN ('resolved','unresolved','error'))
ORDER BY list_name, instance_id""",
)
def q_sorted_buckets(spark, sf):
    return S.sorted_buckets(_status(spark, sf))


@register(
    "completed_union",
    _STATUS_CTE + "SELECT instance_id, bucket FROM st WHERE bucket IN ('resolved','unresolved','error')",
)
def q_completed_union(spark, sf):
    return S.completed_union(_status(spark, sf))


@register(
    "latest_progress",
    oracle_with("fx_progress")
    + ",\n"
    + _LAST
    + "\nSELECT instance_id, seq, ts, status, accepted, details_error, duration FROM last",
)
def q_latest_progress(spark, sf):
    return S.latest_progress(fixture(spark, sf, "fx_progress")).select(
        "instance_id", "seq", "ts", "status", "accepted", "details_error", "duration"
    )


@register(
    "classify_status",
    oracle_with("fx_progress")
    + "\nSELECT seq, instance_id, "
    + _CLASSIFY.format(p="")
    + " AS outcome FROM fx_progress",
)
def q_classify_status(spark, sf):
    prog = fixture(spark, sf, "fx_progress")
    return prog.select("seq", "instance_id", S.classify_status(prog).alias("outcome"))


@register(
    "empty_patch",
    oracle_with("fx_predictions")
    + "\nSELECT instance_id, regexp_matches(coalesce(model_patch, ''), '^\\s*$') AS empty_patch FROM fx_predictions",
)
def q_empty_patch(spark, sf):
    preds = fixture(spark, sf, "fx_predictions")
    return preds.select("instance_id", S.empty_patch(F.col("model_patch")).alias("empty_patch"))


@register(
    "join_predictions",
    oracle_with("fx_instances", "fx_predictions")
    + """
SELECT i.instance_id, i.task, p.model_name_or_path, p.model_patch, p.instance_id IS NOT NULL AS has_prediction
FROM fx_instances i LEFT JOIN fx_predictions p ON i.instance_id = p.instance_id""",
)
def q_join_predictions(spark, sf):
    inst = fixture(spark, sf, "fx_instances").select("instance_id", "task")
    return S.join_predictions(inst, fixture(spark, sf, "fx_predictions"))


@register(
    "orphan_predictions",
    oracle_with("fx_instances", "fx_predictions")
    + """
SELECT p.* FROM fx_predictions p WHERE NOT EXISTS (SELECT 1 FROM fx_instances i WHERE i.instance_id = p.instance_id)""",
)
def q_orphan_predictions(spark, sf):
    return S.orphan_predictions(fixture(spark, sf, "fx_instances"), fixture(spark, sf, "fx_predictions"))


@register(
    "pending_work",
    oracle_with("fx_predictions", "fx_progress")
    + ",\n"
    + _LAST
    + """
SELECT p.* FROM fx_predictions p
WHERE NOT regexp_matches(coalesce(p.model_patch, ''), '^\\s*$')
  AND NOT EXISTS (SELECT 1 FROM last l WHERE l.instance_id = p.instance_id
                  AND ("""
    + _CLASSIFY.format(p="l.")
    + """) IN ('passed','failed'))""",
)
def q_pending_work(spark, sf):
    return S.pending_work(fixture(spark, sf, "fx_predictions"), fixture(spark, sf, "fx_progress"))


@register(
    "attach_outcome",
    oracle_with("fx_instances", "fx_predictions", "fx_progress")
    + ",\n"
    + _LAST
    + """
SELECT i.instance_id, l.instance_id IS NOT NULL AS result_found,
  CASE WHEN l.instance_id IS NULL THEN 'error' ELSE """
    + _CLASSIFY.format(p="l.")
    + """ END AS outcome
FROM fx_instances i JOIN fx_predictions p ON i.instance_id = p.instance_id
LEFT JOIN last l ON i.instance_id = l.instance_id
WHERE NOT regexp_matches(coalesce(p.model_patch, ''), '^\\s*$')""",
)
def q_attach_outcome(spark, sf):
    joined = S.join_predictions(
        fixture(spark, sf, "fx_instances").select("instance_id"), fixture(spark, sf, "fx_predictions")
    ).filter(F.col("has_prediction") & ~S.empty_patch(F.col("model_patch")))
    return S.attach_outcome(joined.select("instance_id"), fixture(spark, sf, "fx_progress")).select(
        "instance_id", "result_found", "outcome"
    )
