"""Queries for run statistics, results analysis and progress counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with
from runlens.functions.numeric import sql_round as R
from runlens.operators import instances as I
from runlens.operators import runstats as RS
from runlens.operators import scoring as S
from runlens.plans.registry import register


def _dom(expr: str) -> str:
    return f"CASE WHEN lower(task) = 'doc2repo' THEN {expr} END"


def _oth(expr: str) -> str:
    return f"CASE WHEN lower(task) <> 'doc2repo' THEN {expr} END"


_N = "count(*)"
_SOLVED = "count(*) FILTER (WHERE score >= 1.0)"
_ALMOST = "count(*) FILTER (WHERE score >= 0.9)"


@register(
    "task_stats",
    oracle_with("fx_results")
    + f"""
SELECT lower(task) AS task, {_N} AS total,
  {_dom(R('avg(score)', 4))} AS avg_pass_rate,
  {_dom(_ALMOST)} AS almost_correct_num,
  {_dom(R(f'CAST({_ALMOST} AS DOUBLE) / {_N}', 4))} AS almost_correct_rate,
  {_dom(_SOLVED)} AS correct_num,
  {_dom(R(f'CAST({_SOLVED} AS DOUBLE) / {_N}', 4))} AS correct_rate,
  {_oth(_SOLVED)} AS solved,
  {_oth(R(f'CAST({_SOLVED} AS DOUBLE) / {_N}', 4))} AS solved_rate,
  count(*) FILTER (WHERE finish_reason = 'error') AS error_count
FROM fx_results WHERE coalesce(task, '') <> '' GROUP BY lower(task)""",
)
def q_task_stats(spark, sf):
    return RS.task_stats(fixture(spark, sf, "fx_results"))


@register(
    "overall_stats",
    oracle_with("fx_results")
    + f"""
SELECT {_N} AS total, {_SOLVED} AS solved, {R(f'CAST({_SOLVED} AS DOUBLE) / {_N}', 4)} AS solved_rate,
  count(*) FILTER (WHERE finish_reason = 'error') AS error_count FROM fx_results""",
)
def q_overall_stats(spark, sf):
    return RS.overall_stats(fixture(spark, sf, "fx_results"))


@register(
    "untagged_instances",
    oracle_with("fx_results") + "\nSELECT instance_id FROM fx_results WHERE coalesce(task, '') = ''",
)
def q_untagged(spark, sf):
    return RS.untagged_instances(fixture(spark, sf, "fx_results"))


@register(
    "run_summary",
    oracle_with("fx_results")
    + """
SELECT count(*) FILTER (WHERE score >= 1.0) AS succeeded, count(*) AS completed,
  count(*) FILTER (WHERE finish_reason = 'error') AS errors FROM fx_results""",
)
def q_run_summary(spark, sf):
    # stand-in result rows: accepted when the score is full, error text on agent errors
    res = fixture(spark, sf, "fx_results").select(
        (F.col("score") >= 1.0).alias("success"),
        F.when(F.col("finish_reason") == "error", F.lit("agent error")).alias("error"),
    )
    return RS.run_summary(res)


@register(
    "run_stats",
    oracle_with("fx_calls")
    + f"""
SELECT run_id, count(*) AS llm_calls, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
  {R('sum(llm_elapsed)', 3)} AS llm_time, {R('sum(tool_elapsed)', 3)} AS tool_time, count(*) AS steps
FROM fx_calls GROUP BY run_id""",
)
def q_run_stats(spark, sf):
    return RS.run_stats(fixture(spark, sf, "fx_calls"))


@register(
    "tool_usage",
    oracle_with("fx_calls")
    + f"""
SELECT run_id, tool_name, count(*) AS n, {R('sum(tool_elapsed)', 3)} AS tool_time
FROM fx_calls GROUP BY run_id, tool_name""",
)
def q_tool_usage(spark, sf):
    return RS.tool_usage(fixture(spark, sf, "fx_calls"))


_NORM_TYPE = """CASE WHEN translate(lower(coalesce(task, 'domainfix')), '_- ', '') IN
  ('doc2repo','crossrepo','depmigrate','domainfix') THEN translate(lower(coalesce(task, 'domainfix')), '_- ', '')
  ELSE 'domainfix' END"""


@register(
    "dataset_inventory",
    oracle_with("fx_instances")
    + f"""
SELECT task_type, language, count(*) AS n FROM (SELECT {_NORM_TYPE} AS task_type, language FROM fx_instances)
GROUP BY ROLLUP (task_type, language)""",
)
def q_dataset_inventory(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    return RS.dataset_inventory(inst.select(I.normalize_task_type(F.col("task")).alias("task_type"), "language"))


@register(
    "instances_vs_results",
    oracle_with("fx_predictions", "fx_results")
    + """
SELECT p.instance_id FROM fx_predictions p
WHERE NOT EXISTS (SELECT 1 FROM fx_results r WHERE r.instance_id = p.instance_id)""",
)
def q_instances_vs_results(spark, sf):
    # requested ids = the ids a run was asked to do (the prediction ids here)
    return RS.instances_vs_results(fixture(spark, sf, "fx_predictions"), fixture(spark, sf, "fx_results"))


@register(
    "preview_n",
    oracle_with("fx_instances")
    + """
SELECT line_no, line FROM (
  SELECT CAST(row_number() OVER (ORDER BY instance_id) AS BIGINT) AS line_no,
         concat('  ', instance_id, ' (image=', coalesce(nullif(left(image_url, 50), ''), 'none'), ')') AS line
  FROM fx_instances ORDER BY instance_id LIMIT 20)
UNION ALL
SELECT 21, concat('  ... and ', CAST(count(*) - 20 AS VARCHAR), ' more') FROM fx_instances HAVING count(*) > 20""",
)
def q_preview_n(spark, sf):
    return RS.preview_n(fixture(spark, sf, "fx_instances"), 20, image="image_url")


_ATTEMPTS = """att AS (SELECT instance_id, seq, status <> 'error' OR status IS NULL AS returned,
    CASE WHEN status = 'error' THEN concat('attempt ', CAST(seq AS VARCHAR), ' failed') END AS error,
    row_number() OVER (PARTITION BY instance_id ORDER BY seq) AS attempt FROM fx_progress)"""


@register(
    "best_attempt",
    oracle_with("fx_progress")
    + ",\n"
    + _ATTEMPTS
    + """,
k AS (SELECT * FROM att WHERE attempt <= 3),
ok AS (SELECT instance_id, min(attempt) AS a FROM k WHERE returned GROUP BY instance_id),
lst AS (SELECT instance_id, max(attempt) AS a FROM k GROUP BY instance_id)
SELECT l.instance_id, o.a IS NOT NULL AS returned, CAST(coalesce(o.a, l.a) AS BIGINT) AS attempts_used,
  k.seq AS final_seq, CASE WHEN o.a IS NULL THEN k.error END AS last_error
FROM lst l LEFT JOIN ok o ON l.instance_id = o.instance_id
JOIN k ON k.instance_id = l.instance_id AND k.attempt = coalesce(o.a, l.a)""",
)
def q_best_attempt(spark, sf):
    # stand-in attempts: an 'error' progress record is an attempt that raised
    prog = fixture(spark, sf, "fx_progress")
    att = prog.select(
        "instance_id", "seq",
        (F.coalesce(F.col("status"), F.lit("")) != "error").alias("returned"),
        F.when(F.col("status") == "error", F.concat(F.lit("attempt "), F.col("seq").cast("string"),
                                                   F.lit(" failed"))).alias("error"),
    )
    return RS.best_attempt(att, 3)


@register(
    "progress_running",
    oracle_with("fx_progress")
    + """,
c AS (SELECT seq, instance_id, CASE WHEN status IN ('passed','failed','error') THEN status
            WHEN details_error IS NOT NULL THEN 'error'
            WHEN coalesce(accepted, false) THEN 'passed' ELSE 'failed' END AS outcome FROM fx_progress)
SELECT seq, instance_id, outcome,
  CAST(count(*) OVER w AS BIGINT) AS completed,
  CAST(sum(CASE WHEN outcome = 'passed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS resolved,
  CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS unresolved,
  CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errored
FROM c WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def q_progress_running(spark, sf):
    prog = fixture(spark, sf, "fx_progress")
    events = prog.select("seq", "instance_id", S.classify_status(prog).alias("outcome"))
    return RS.progress_running(events, status="outcome")
