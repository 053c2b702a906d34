"""Queries for per-run step logic (windows, cut-offs, outcomes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with
from runlens.operators import steps as ST
from runlens.plans.registry import register

MAX_MESSAGES, KEEP_FIRST = 5, 2
CONTEXT_LIMIT = 4500
MAX_STEPS = 3
TOKEN_BUDGET = 400


@register(
    "condense_messages",
    oracle_with("fx_messages") + f""",
n AS (SELECT conv_id, count(*) AS n FROM fx_messages GROUP BY 1)
SELECT m.conv_id, m.turn, m.role FROM fx_messages m JOIN n ON m.conv_id = n.conv_id
WHERE n.n <= {MAX_MESSAGES} OR m.turn + 1 <= {KEEP_FIRST} OR m.turn + 1 > n.n - {MAX_MESSAGES - KEEP_FIRST}""",
)
def q_condense_messages(spark, sf):
    msgs = fixture(spark, sf, "fx_messages")
    return ST.condense_messages(msgs, MAX_MESSAGES, KEEP_FIRST).select("conv_id", "turn", "role")


@register(
    "context_cutoff",
    oracle_with("fx_calls") + f""",
v AS (SELECT run_id, min(step) FILTER (WHERE prompt_tokens + completion_tokens > {CONTEXT_LIMIT}) AS v,
        max(step) AS last FROM fx_calls GROUP BY 1)
SELECT c.run_id, CAST(c.step AS INTEGER) AS step, coalesce(v.v < v.last, false) AS cutoff FROM fx_calls c JOIN v ON c.run_id = v.run_id
WHERE v.v IS NULL OR c.step <= v.v""",
)
def q_context_cutoff(spark, sf):
    return ST.context_cutoff(fixture(spark, sf, "fx_calls"), CONTEXT_LIMIT).select("run_id", "step", "cutoff")


@register(
    "step_cap",
    oracle_with("fx_calls") + f"""
SELECT run_id, CAST(coalesce(min(step) FILTER (WHERE tool_name = 'finish') + 1, count(*)) AS BIGINT) AS steps,
  CASE WHEN min(step) FILTER (WHERE tool_name = 'finish') IS NOT NULL THEN 'finish' ELSE 'max_steps' END
    AS finish_reason
FROM fx_calls WHERE step < {MAX_STEPS} GROUP BY run_id""",
)
def q_step_cap(spark, sf):
    return ST.step_cap(fixture(spark, sf, "fx_calls"), MAX_STEPS, F.col("tool_name") == "finish")


# stand-in step log: action type, tool-call count, token-budget status and
# step errors derived from the call rows
_ACTION = """CASE WHEN tool_name = 'finish' AND step > 0 THEN 'finish'
                 WHEN completion_tokens % 10 = 0 THEN 'message' ELSE 'tool_call' END"""
_NCALLS = "CASE WHEN completion_tokens % 10 = 0 THEN 0 ELSE 1 END"
_FSTATUS = "CASE WHEN completion_tokens = 50 THEN 'length' END"
_ERROR = "CASE WHEN completion_tokens = 1 THEN 'step failed' END"
_OUT_MAX_STEPS, _OUT_LIMIT = 5, 4700


def _outcome_sql(has_reminder: bool) -> str:
    return oracle_with("fx_calls") + f""",
s AS (SELECT run_id, step, prompt_tokens + completion_tokens AS tok, {_ACTION} AS action_type, {_NCALLS} AS n_calls,
        {_FSTATUS} AS fstatus, {_ERROR} AS err FROM fx_calls WHERE step < {_OUT_MAX_STEPS}),
j AS (SELECT s.*, p.tok AS prev_tok FROM s LEFT JOIN s p ON p.run_id = s.run_id AND p.step + 1 = s.step),
t AS (SELECT run_id, step,
  CASE WHEN coalesce(prev_tok > {_OUT_LIMIT}, false) THEN 'context_length'
       WHEN err IS NOT NULL THEN 'error' WHEN fstatus = 'length' THEN 'context_length'
       WHEN action_type = 'finish' THEN 'finish'
       WHEN action_type = 'message' AND n_calls = 0 AND {str(not has_reminder).lower()} THEN 'finish' END AS reason,
  CASE WHEN coalesce(prev_tok > {_OUT_LIMIT}, false) THEN 0 ELSE 1 END AS ran FROM j),
f AS (SELECT run_id, min(step) FILTER (WHERE reason IS NOT NULL) AS ts, count(*) AS n FROM t GROUP BY 1)
SELECT f.run_id, CASE WHEN f.ts IS NOT NULL THEN t.reason WHEN f.n >= {_OUT_MAX_STEPS} THEN 'max_steps'
  ELSE 'incomplete' END AS finish_reason,
  CAST(CASE WHEN f.ts IS NOT NULL THEN f.ts + t.ran ELSE f.n END AS BIGINT) AS steps,
  CAST(f.ts AS BIGINT) AS terminal_step
FROM f LEFT JOIN t ON t.run_id = f.run_id AND t.step = f.ts"""


@register("run_outcome", _outcome_sql(has_reminder=False))
def q_run_outcome(spark, sf):
    calls = fixture(spark, sf, "fx_calls").select(
        "run_id", "step", "prompt_tokens", "completion_tokens", F.expr(_ACTION).alias("action_type"),
        F.expr(_NCALLS).alias("n_tool_calls"), F.expr(_FSTATUS).alias("finish_status"),
        F.expr(_ERROR).alias("error"))
    return ST.run_outcome(calls, _OUT_MAX_STEPS, _OUT_LIMIT, has_reminder=False)


_PARSE_OK = "completion_tokens % 7 <> 0"
_COMPLETE = "tool_name = 'finish'"


@register(
    "confirm_complete",
    oracle_with("fx_calls") + f""",
p AS (SELECT run_id, step, {_COMPLETE} AS c FROM fx_calls WHERE {_PARSE_OK}),
l AS (SELECT run_id, step, c AND coalesce(lag(c) OVER (PARTITION BY run_id ORDER BY step), false) AS ok FROM p),
fin AS (SELECT run_id, min(step) AS finish_step FROM l WHERE ok GROUP BY 1)
SELECT r.run_id, CAST(fin.finish_step AS INTEGER) AS finish_step FROM (SELECT DISTINCT run_id FROM fx_calls) r LEFT JOIN fin ON r.run_id = fin.run_id""",
)
def q_confirm_complete(spark, sf):
    calls = fixture(spark, sf, "fx_calls").select(
        "run_id", "step", F.expr(_PARSE_OK).alias("parse_ok"), F.expr(_COMPLETE).alias("is_complete"))
    return ST.confirm_complete(calls)


@register(
    "terminal_delta",
    oracle_with("fx_screens") + """,
l AS (SELECT *, trim(lag(buffer) OVER (PARTITION BY run_id ORDER BY step), ' ' || chr(10) || chr(9) || chr(13)) AS pb
      FROM fx_screens),
p AS (SELECT *, CASE WHEN pb IS NULL OR pb = '' THEN 0 ELSE strpos(reverse(buffer), reverse(pb)) END AS p FROM l),
n AS (SELECT *, CASE WHEN p > 0 THEN trim(substr(buffer, length(buffer) - p + 2), ' ' || chr(10) || chr(9) || chr(13))
      END AS new_part FROM p)
SELECT run_id, step, CASE WHEN p > 0 AND new_part <> '' THEN concat('New Terminal Output:', chr(10), new_part)
  ELSE concat('Current Terminal Screen:', chr(10), visible) END AS observation FROM n""",
)
def q_terminal_delta(spark, sf):
    return ST.terminal_delta(fixture(spark, sf, "fx_screens")).select("run_id", "step", "observation")


_PROMPT_LEN = "(run_id % 5) * 40"
_ADDED = "completion_tokens + CAST(tool_elapsed * 1000 AS BIGINT)"


@register(
    "token_offsets",
    oracle_with("fx_calls") + f""",
s AS (SELECT run_id, step, {_PROMPT_LEN} AS prompt_len, {_ADDED} AS added FROM fx_calls),
r AS (SELECT *, sum(added) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - added AS before FROM s)
SELECT run_id, CAST(step AS INTEGER) AS step, CAST(prompt_len + before AS BIGINT) AS seq_len,
  CAST({TOKEN_BUDGET} - prompt_len - before - 128 AS BIGINT) AS remaining,
  {TOKEN_BUDGET} - prompt_len - before - 128 <= 0 AS length FROM r""",
)
def q_token_offsets(spark, sf):
    calls = fixture(spark, sf, "fx_calls").select(
        "run_id", "step", F.expr(_PROMPT_LEN).alias("prompt_len"), F.expr(_ADDED).alias("added_tokens"))
    return ST.token_offsets(calls, TOKEN_BUDGET).select("run_id", "step", "seq_len", "remaining", "length")
