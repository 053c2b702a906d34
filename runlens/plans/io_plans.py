"""Queries for readers, writers and extension points.

Readers: the stand-in lines / documents made from the driver tables are
written with Spark's text writer into the shared scratch folder
(``spark.checkpoint.dir``) and the library's ``scan_*`` reader runs on those
files.  Two readers need file names Spark's writers cannot produce
(``task.toml`` / ``instruction.md`` folders): the queries over ``part`` feed the
parse job rows in the exact schema the ``binaryFile`` reader yields
(``(path, content)``), those over ``supplier`` write the folders file by file
and read them.  Writers: rows are written with
the library writer into the scratch folder and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.operators import hooks as H
from runlens.operators import runstats as RS
from runlens.operators import scoring as S
from runlens.plans import scoring_plans, stats_plans  # noqa: F401  (oracles reused below)
from runlens.functions.numeric import sql_round
from runlens.plans.registry import ORACLE, register
from runlens.plans.scoring_plans import _STATUS_CTE
from runlens.session import scratch_path
from runlens.sources import readers as RD
from runlens.sources import writers as W
from runlens.sources.file_tree import write_file_tree

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _text_files(spark, lines, name: str, partition: str | None = None) -> str:
    """Write a ``value`` column as text files (optionally one folder per
    ``partition`` value) and return the folder."""
    path = _scratch(spark, name)
    w = lines.repartition(partition).write.partitionBy(partition) if partition else lines.write
    w.mode("overwrite").text(path)
    return path


# ── instances ──────────────────────────────────────────────────────────────

INSTANCE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "instance_id", "task", "user_name", "repo", "image_url", "base_commit", "parent_commit", "problem_statement",
    "language")])


@register("scan_instances", oracle_with("fx_instances") + "\nSELECT * FROM fx_instances")
def q_scan_instances(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    lines = inst.select(F.to_json(F.struct(*inst.columns)).alias("value")).unionByName(
        inst.where(F.col("instance_id").endswith("7")).select(F.lit("   ").alias("value")))
    return RD.scan_instances(spark, _text_files(spark, lines, "instances"), INSTANCE_SCHEMA, keep_raw=False)


# ── predictions ────────────────────────────────────────────────────────────

def _prediction_lines(spark, sf, dirty: bool):
    docs = read_table(spark, sf, "documents").where(F.col("doc_id") % 5 != 0)
    p = fixture(spark, sf, "fx_predictions")
    if not dirty:
        return p.select(F.to_json(F.struct(*p.columns), _KEEP_NULLS).alias("value"))
    d = docs.select("doc_id", F.concat(F.lit("I-"), F.col("doc_id").cast("string")).alias("instance_id"),
                    F.lit("m1").alias("model_name_or_path"), F.col("lang"))
    base = F.struct("instance_id", "model_name_or_path", F.concat(F.lit("diff --git a/"), F.col("lang")).alias(
        "model_patch"))
    extra = F.struct("instance_id", "model_name_or_path", F.lit("p").alias("model_patch"), F.lit("x").alias("note"))
    missing = F.struct("instance_id", F.lit("p").alias("model_patch"))
    js = (F.when(F.col("doc_id") % 19 == 0, F.to_json(extra)).when(F.col("doc_id") % 23 == 0, F.to_json(missing))
          .otherwise(F.to_json(base, _KEEP_NULLS)))
    dups = d.where(F.col("doc_id") % 29 == 0).select(F.to_json(base, _KEEP_NULLS).alias("value"))
    return d.select(js.alias("value")).unionByName(dups)


@register("scan_predictions", oracle_with("fx_predictions") + "\nSELECT * FROM fx_predictions")
def q_scan_predictions(spark, sf):
    return RD.scan_predictions(spark, _text_files(spark, _prediction_lines(spark, sf, dirty=False), "predictions"))


@register(
    "schema_violations",
    """WITH d AS (SELECT doc_id, concat('I-', CAST(doc_id AS VARCHAR)) AS instance_id FROM documents WHERE doc_id % 5 <> 0)
SELECT 'unexpected_keys' AS kind, instance_id, 'note' AS detail FROM d WHERE doc_id % 19 = 0
UNION ALL SELECT 'missing_keys', instance_id, 'model_name_or_path' FROM d WHERE doc_id % 19 <> 0 AND doc_id % 23 = 0
UNION ALL SELECT 'duplicate_id', instance_id, '2' FROM d WHERE doc_id % 29 = 0""",
)
def q_schema_violations(spark, sf):
    return RD.schema_violations(RD.parse_prediction_lines(_prediction_lines(spark, sf, dirty=True)))


# ── progress ───────────────────────────────────────────────────────────────

def _progress_lines(spark, sf, null_details: bool = False):
    """Log lines; with ``null_details`` every 41st record has a null
    ``details.error`` (its key is present)."""
    prog = fixture(spark, sf, "fx_progress")
    iid = F.when(F.col("seq") % 37 != 0, F.col("instance_id"))
    rec = F.struct(F.col("seq"), iid.alias("instance_id"), "status", "accepted", "duration",
                   F.when(F.col("details_error").isNotNull(), F.struct(F.col("details_error").alias("error")))
                   .alias("details"))
    rec_err = F.struct(F.col("seq"), iid.alias("instance_id"), F.lit("error").alias("status"),
                       F.concat(F.lit("exit "), F.col("seq").cast("string")).alias("error"))
    rec_null = F.struct(F.col("seq"), iid.alias("instance_id"), "status", "accepted", "duration",
                        F.struct(F.lit(None).cast("string").alias("error")).alias("details"))
    line = F.when(F.col("status") == "error", F.to_json(rec_err))
    if null_details:
        line = line.when(F.col("seq") % 41 == 0, F.to_json(rec_null, _KEEP_NULLS))
    return prog.select(line.otherwise(F.to_json(rec)).alias("value"))


_PROGRESS_RECORD = ("seq bigint, instance_id string, status string, accepted boolean, duration double, "
                    "details struct<error:string>, error string")

def _progress_oracle(null_details: str) -> str:
    return f"""
SELECT seq, instance_id, status, CAST(NULL AS VARCHAR) AS outcome,
  CASE WHEN status = 'error' THEN NULL ELSE accepted END AS accepted,
  coalesce(status = 'error', false) AS has_error_key,
  CASE WHEN status = 'error' OR {null_details} THEN NULL ELSE details_error END AS details_error,
  NOT coalesce(status = 'error', false) AND (details_error IS NOT NULL OR {null_details}) AS has_details_error,
  CASE WHEN status = 'error' THEN NULL ELSE duration END AS duration
FROM fx_progress WHERE seq % 37 <> 0"""


@register("scan_progress", oracle_with("fx_progress") + _progress_oracle("seq % 41 = 0"))
def q_scan_progress(spark, sf):
    return RD.scan_progress(spark, _text_files(spark, _progress_lines(spark, sf, null_details=True), "progress-log")).drop("log_pos")


@register("write_progress", oracle_with("fx_progress") + _progress_oracle("false"))
def q_write_progress(spark, sf):
    out = _scratch(spark, "progress")
    records = _progress_lines(spark, sf).select(F.from_json("value", _PROGRESS_RECORD).alias("r")).select("r.*")
    W.write_progress(records, out)
    return RD.scan_progress(spark, out).drop("log_pos")


# ── results ────────────────────────────────────────────────────────────────

_RUN_DIR = "concat('/data/out/m1_20260101_00000', right(instance_id, 1))"


@register(
    "scan_results",
    oracle_with("fx_results") + f"""
SELECT regexp_extract({_RUN_DIR}, '[^/]+$') AS run_id, instance_id, CAST(NULL AS VARCHAR) AS dataset_id, task,
  CAST(NULL AS BOOLEAN) AS success, score, CAST(NULL AS VARCHAR) AS error, finish_reason FROM fx_results""",
)
def q_scan_results(spark, sf):
    # one folder per run (Spark's partitioned writer names it run=<run id>)
    res = fixture(spark, sf, "fx_results")
    lines = res.select(F.to_json(F.struct(*res.columns)).alias("value"),
                       F.regexp_extract(F.expr(_RUN_DIR), "[^/]+$", 0).alias("run"))
    return RD.scan_results(spark, _text_files(spark, lines, "results-runs", partition="run"), pattern="*/*.txt")


def _runs(spark, sf):
    res = fixture(spark, sf, "fx_results")
    return res.select(
        F.regexp_extract(F.expr(_RUN_DIR), "[^/]+$", 0).alias("run_id"), "instance_id",
        F.lit("scale_swe").alias("dataset_id"), "task",
        (F.col("score") >= 1.0).alias("accepted"),
        F.when(F.col("finish_reason") != "error", F.col("score")).alias("eval_score"),
        F.when(F.col("finish_reason") == "error", F.lit("agent crashed")).alias("error"),
        F.when(F.col("finish_reason") != "max_steps", F.col("finish_reason")).alias("finish_reason"))


@register(
    "write_results",
    oracle_with("fx_results") + f"""
SELECT regexp_extract({_RUN_DIR}, '[^/]+$') AS run_id, instance_id, 'scale_swe' AS dataset_id, task,
  score >= 1.0 AS success, CASE WHEN finish_reason <> 'error' THEN score ELSE 0.0 END AS score,
  CASE WHEN finish_reason = 'error' THEN 'agent crashed' END AS error,
  CASE WHEN finish_reason <> 'max_steps' THEN finish_reason ELSE '' END AS finish_reason FROM fx_results""",
)
def q_write_results(spark, sf):
    out = _scratch(spark, "results")
    W.write_results(_runs(spark, sf), out)
    schema = T.StructType([T.StructField("run_id", T.StringType())] + list(RD.RESULT_SCHEMA.fields))
    back = spark.read.schema(schema).json(out)
    return back.select(*[f.name for f in schema.fields])


# ── trajectories ───────────────────────────────────────────────────────────

def _trajectory_records(spark, sf):
    calls = fixture(spark, sf, "fx_calls")
    action_type = F.when(F.col("tool_name") == "finish", F.lit("finish")).otherwise(F.lit("tool_call"))
    tc = F.array(F.struct(F.concat(F.lit("c"), F.col("step").cast("string")).alias("id"),
                          F.col("tool_name").alias("name"), F.lit("{}").alias("arguments"),
                          F.lit(None).cast("struct<name:string,arguments:string>").alias("function")))
    step = F.struct(F.col("step").cast("int").alias("step"),
                    F.struct(action_type.alias("type"),
                             F.concat(F.lit("step "), F.col("step").cast("string")).alias("content"),
                             tc.alias("tool_calls")).alias("action"),
                    F.array(F.concat(F.lit("obs "), F.col("step").cast("string"))).alias("observations"))
    runs = calls.groupBy("run_id").agg(F.array_sort(F.collect_list(step)).alias("trajectory"))
    return runs.select(
        F.concat(F.lit("run"), (F.col("run_id") % 3).cast("string")).alias("run_key"),
        F.concat(F.lit("I-"), F.col("run_id").cast("string")).alias("instance_id"),
        F.lit(False).alias("success"), F.lit(0.0).alias("score"), F.lit("finish").alias("finish_reason"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("duration"),
        F.lit("").alias("patch"),
        F.when(F.col("run_id") % 5 != 0, F.col("trajectory")).alias("trajectory"),
        F.struct((F.col("run_id") % 2 == 0).alias("accepted"), F.lit(0.5).alias("score"), F.lit(1.0).alias("duration"),
                 F.struct((F.col("run_id") % 7).alias("n_failed")).alias("details")).alias("eval_result"),
        F.struct((F.col("run_id") % 11).alias("n_calls")).alias("stats"))


_TRAJ_STEPS = """
SELECT concat('I-', CAST(run_id AS VARCHAR)) AS instance_id, CAST(step AS INTEGER) AS pos, CAST(step AS INTEGER) AS step,
  CASE WHEN tool_name = 'finish' THEN 'finish' ELSE 'tool_call' END AS action_type,
  concat('step ', CAST(step AS VARCHAR)) AS content, tool_name AS first_call, 1 AS n_observations,
  run_id % 11 AS n_calls, run_id % 7 AS n_failed
FROM fx_calls WHERE run_id % 5 <> 0"""
# runs without an agent result keep one row without step fields
_TRAJ_EMPTY = """
UNION ALL SELECT DISTINCT concat('I-', CAST(run_id AS VARCHAR)), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), NULL, NULL, NULL,
  CAST(NULL AS INTEGER), run_id % 11, run_id % 7 FROM fx_calls WHERE run_id % 5 = 0"""


def _traj_out(trajectories):
    info = trajectories.withColumns({"n_calls": F.try_variant_get("stats", "$.n_calls", "bigint"),
                                     "n_failed": F.try_variant_get("eval_result.details", "$.n_failed", "bigint")})
    return RD.trajectory_steps(info, ("n_calls", "n_failed")).select(
        "instance_id", F.col("pos").cast("int").alias("pos"), "step", "action_type", "content",
        F.try_element_at("tool_calls", F.lit(1))["name"].alias("first_call"),
        F.when(F.col("observations").isNotNull(), F.size("observations")).alias("n_observations"), "n_calls", "n_failed")


@register("scan_trajectories", oracle_with("fx_calls") + _TRAJ_STEPS + _TRAJ_EMPTY)
def q_scan_trajectories(spark, sf):
    recs = _trajectory_records(spark, sf).drop("run_key")
    lines = recs.select(F.to_json(F.struct(*recs.columns)).alias("value"))
    return _traj_out(RD.scan_trajectories(spark, _text_files(spark, lines, "trajectory-log")))


@register("write_trajectories", oracle_with("fx_calls") + _TRAJ_STEPS)
def q_write_trajectories(spark, sf):
    out = _scratch(spark, "trajectories")
    W.write_trajectories(_trajectory_records(spark, sf).withColumnRenamed("run_key", "run_id"), out)
    return _traj_out(RD.scan_trajectories(spark, out))


# ── task directories ───────────────────────────────────────────────────────

_TOML = """concat('[environment]', chr(10),
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('docker_image = "reg.io/', lower(replace(p_brand, '#', '')), ':1"', chr(10)) END,
  'cpus = ', CAST(p_size % 4 + 1 AS STRING), chr(10),
  'memory = "', CAST(p_size AS STRING), 'G"', chr(10),
  CASE WHEN p_partkey % 17 = 0 THEN 'broken = [' ELSE '' END, chr(10),
  '[agent]', chr(10), 'timeout_sec = ', CAST(p_size * 10 AS STRING), chr(10))"""


def _task_files(spark, sf):
    part = read_table(spark, sf, "part")
    d = F.concat(F.lit("/tasks/t"), F.col("p_partkey").cast("string"))
    toml = part.select(F.concat(d, F.lit("/task.toml")).alias("path"), F.encode(F.expr(_TOML), "UTF-8").alias("content"))
    instr = part.where(F.col("p_partkey") % 11 != 0).select(
        F.concat(d, F.lit("/instruction.md")).alias("path"), F.encode(F.col("p_name"), "UTF-8").alias("content"))
    tests = part.select(F.concat(d, F.lit("/tests/test_"), F.col("p_size").cast("string"), F.lit(".py")).alias("path"),
                        F.encode(F.col("p_type"), "UTF-8").alias("content"))
    nested = part.where(F.col("p_partkey") % 2 == 0).select(
        F.concat(d, F.lit("/tests/data/tests/case.txt")).alias("path"), F.encode(F.col("p_name"), "UTF-8").alias("content"))
    other = part.select(F.concat(d, F.lit("/solution.sh")).alias("path"), F.encode(F.lit("echo"), "UTF-8")
                        .alias("content"))
    return toml.unionByName(instr).unionByName(tests).unionByName(nested).unionByName(other)


@register(
    "scan_task_dirs",
    """SELECT concat('/tasks/t', CAST(p_partkey AS VARCHAR)) AS task_dir, concat('t', CAST(p_partkey AS VARCHAR)) AS instance_id,
  CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL
       ELSE concat('reg.io/', lower(replace(p_brand, '#', '')), ':1') END AS docker_image,
  CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size % 4 + 1 AS BIGINT) END AS cpus,
  CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE concat(CAST(p_size AS VARCHAR), 'G') END AS memory,
  CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS agent_timeout_sec,
  p_name AS instruction, p_partkey % 13 = 0 OR p_partkey % 17 = 0 AS broken
FROM part WHERE p_partkey % 11 <> 0""",
)
def q_scan_task_dirs(spark, sf):
    t = RD.task_dirs(_task_files(spark, sf))
    return t.select("task_dir", "instance_id", "docker_image", "cpus", "memory", "agent_timeout_sec", "instruction",
                    F.col("error").isNotNull().alias("broken"))


@register(
    "collect_task_files",
    """SELECT concat('/tasks/t', CAST(p_partkey AS VARCHAR)) AS task_dir,
  concat('/tests/test_', CAST(p_size AS VARCHAR), '.py') AS key, to_base64(encode(p_type)) AS content_b64 FROM part
  WHERE p_partkey % 11 <> 0
UNION ALL SELECT concat('/tasks/t', CAST(p_partkey AS VARCHAR)), '/tests/data/tests/case.txt', to_base64(encode(p_name))
FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 11 <> 0""",
)
def q_collect_task_files(spark, sf):
    return RD.task_files(_task_files(spark, sf))


def _task_folders(spark, sf, name):
    """Task folders on disk, one per supplier; the root."""
    sup = read_table(spark, sf, "supplier")
    d = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))

    def files(tail, content, where="true"):
        return sup.where(where).select(F.concat(d, F.lit(tail)).alias("path"), F.encode(F.expr(content), "UTF-8").alias("content"))

    toml = """concat('[environment]', chr(10),
      CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('docker_image = "reg.io/n', CAST(s_nationkey AS STRING), ':1"', chr(10)) END,
      CASE WHEN s_suppkey % 5 = 0 THEN concat('memory_mb = ', CAST(s_suppkey AS STRING), chr(10)) ELSE '' END,
      CASE WHEN s_suppkey % 17 = 0 THEN '[[broken' ELSE '' END, chr(10),
      '[verifier]', chr(10), 'timeout_sec = ', CAST(s_nationkey + 1 AS STRING), chr(10))"""
    tree = (files("/task.toml", toml).unionByName(files("/instruction.md", "s_name", "s_suppkey % 11 <> 0"))
            .unionByName(files("/tests/test_outputs.py", "concat('# ', s_name, chr(10))"))
            .unionByName(files("/tests/data/tests/__init__.py", "''", "s_suppkey % 2 = 0"))
            .unionByName(files("/environment/Dockerfile", "'FROM scratch'")))
    root = _scratch(spark, name)
    write_file_tree(tree, root)
    return root


@register(
    "scan_task_folders",
    """SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS instance_id,
  CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 THEN NULL ELSE concat('reg.io/n', CAST(s_nationkey AS VARCHAR), ':1') END AS docker_image,
  CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey AS BIGINT) ELSE 2048 END AS memory_mb,
  CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 THEN NULL ELSE CAST(s_nationkey + 1 AS DOUBLE) END AS verifier_timeout_sec,
  s_name AS instruction, s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 AS broken
FROM supplier WHERE s_suppkey % 11 <> 0""",
)
def q_scan_task_folders(spark, sf):
    tasks = RD.scan_task_dirs(spark, _task_folders(spark, sf, "task-folders"))
    return tasks.select("instance_id", "docker_image", "memory_mb", "verifier_timeout_sec", "instruction",
                        F.col("error").isNotNull().alias("broken"))


@register(
    "collect_task_folders",
    """SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS instance_id, '/tests/test_outputs.py' AS key,
  to_base64(encode(concat('# ', s_name, chr(10)))) AS content_b64 FROM supplier WHERE s_suppkey % 11 <> 0
UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR)), '/tests/data/tests/__init__.py', '' FROM supplier
WHERE s_suppkey % 2 = 0 AND s_suppkey % 11 <> 0""",
)
def q_collect_task_folders(spark, sf):
    files = RD.collect_task_files(spark, _task_folders(spark, sf, "task-files"))
    return files.select(F.substring_index("task_dir", "/", -1).alias("instance_id"), "key", "content_b64")


# ── id lists and search payloads ───────────────────────────────────────────

@register(
    "scan_id_list",
    """SELECT CAST(floor(doc_id / 500) AS BIGINT) AS list_id,
  CAST(row_number() OVER (PARTITION BY floor(doc_id / 500) ORDER BY doc_id) - 1 AS INTEGER) AS pos,
  concat('I-', CAST(doc_id AS VARCHAR)) AS instance_id FROM documents""",
)
def q_scan_id_list(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).cast("bigint").alias("list_id"),
                                                     "doc_id")
    lists = docs.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct(
        "doc_id", F.concat(F.lit("I-"), F.col("doc_id").cast("string")).alias("id")))).alias("_l"))
    text = lists.select("list_id", F.to_json(F.transform("_l", lambda x: x["id"])).alias("value"))
    # one id-list document per file (one folder per list)
    ids = RD.scan_id_list(spark, f"{_text_files(spark, text, 'id-lists', partition='list_id')}/*/*.txt")
    return ids.select(F.regexp_extract("list_id", r"list_id=(\d+)", 1).cast("bigint").alias("list_id"),
                      "pos", "instance_id")


_HIT = "named_struct('position', page_id % 9, 'title', regexp_extract(html, '<title>([^<]*)</title>', 1), " \
       "'link', url, 'snippet', regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1))"


def _payloads(spark, sf):
    pages = read_table(spark, sf, "pages")
    hit = F.expr(_HIT)
    alt = F.struct(F.col("url").alias("url"), F.lit(3).alias("position"))
    payload = (
        F.when(F.col("page_id") % 5 == 0, F.to_json(F.struct(F.array(hit).alias("results"))))
        .when(F.col("page_id") % 5 == 1, F.to_json(F.struct(F.array(hit).alias("organic_results"))))
        .when(F.col("page_id") % 5 == 2, F.to_json(alt))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("no json: "), F.col("url")))
        .otherwise(F.to_json(F.array(hit))))
    return pages.select(F.col("page_id").alias("query_id"), payload.alias("payload"))


@register(
    "scan_search_hits",
    """SELECT page_id AS query_id, 0 AS item_pos,
  CAST(CASE page_id % 5 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE page_id % 9 END AS INTEGER) AS position,
  CASE page_id % 5 WHEN 2 THEN '' WHEN 3 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE page_id % 5 WHEN 3 THEN '' ELSE url END AS url,
  CASE page_id % 5 WHEN 2 THEN '' WHEN 3 THEN concat('no json: ', url)
       ELSE regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) END AS description,
  CASE WHEN page_id % 5 IN (2, 3) THEN 0
       WHEN regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) <> '' THEN 1 ELSE 0 END AS n_snippets
FROM pages""",
)
def q_scan_search_hits(spark, sf):
    # stand-in search-call log: one {"query_id", "response"} line per call
    log = _payloads(spark, sf).select(F.to_json(F.struct(F.col("query_id").cast("string").alias("query_id"),
                                                         F.col("payload").alias("response"))).alias("value"))
    hits = RD.scan_search_log(spark, _text_files(spark, log, "search-log")).withColumn(
        "query_id", F.col("query_id").cast("bigint"))
    return hits.select("query_id", F.col("item_pos").cast("int").alias("item_pos"),
                       F.col("position").cast("int").alias("position"), "title", "url", "description",
                       F.size("snippets").alias("n_snippets"))


# ── report / analysis / rollout writers ────────────────────────────────────

_TOTALS = {
    "total_instances": "true", "submitted_instances": "bucket <> 'incomplete'",
    "completed_instances": "bucket IN ('resolved', 'unresolved', 'error')", "resolved_instances": "bucket = 'resolved'",
    "unresolved_instances": "bucket = 'unresolved'", "error_instances": "bucket = 'error'",
    "empty_patch_instances": "bucket = 'empty_patch'",
}


@register("write_report", _STATUS_CTE + """SELECT 'count' AS part, bucket AS name, count(*) AS n FROM st GROUP BY bucket
UNION ALL SELECT concat('instance ', bucket), instance_id, 1 FROM st
UNION ALL """ + "\nUNION ALL ".join(
    f"SELECT 'total 1.0', '{name}', count(*) FILTER (WHERE {test}) FROM st" for name, test in _TOTALS.items()))
def q_write_report(spark, sf):
    status = S.instance_status(fixture(spark, sf, "fx_instances"), fixture(spark, sf, "fx_predictions"),
                               fixture(spark, sf, "fx_progress"))
    out = _scratch(spark, "report")
    W.write_report(status, out)
    counts = spark.read.schema("bucket string, n bigint").json(f"{out}/counts")
    listed = spark.read.schema("instance_id string, bucket string").parquet(f"{out}/instances")
    totals = spark.read.schema("schema_version string, " + ", ".join(f"{k} bigint" for k in _TOTALS)).json(f"{out}/totals")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in _TOTALS])).alias("t")
    return (
        counts.select(F.lit("count").alias("part"), F.col("bucket").alias("name"), "n")
        .unionByName(listed.select(F.concat(F.lit("instance "), "bucket").alias("part"), F.col("instance_id").alias("name"),
                                   F.lit(1).cast("bigint").alias("n")))
        .unionByName(totals.select(F.concat(F.lit("total "), "schema_version").alias("part"), pairs)
                     .select("part", "t.name", "t.n")))


# the document's lines: each id list in its order, and the counts
_LISTS = {"completed": "bucket IN ('resolved', 'unresolved', 'error')", "submitted": "bucket <> 'incomplete'",
          **{b: f"bucket = '{b}'" for b in ("empty_patch", "error", "incomplete", "resolved", "unresolved")}}
_DOCUMENT = "\nUNION ALL ".join(
    ["SELECT '{' AS line", "SELECT '}'", """SELECT '  "schema_version": "1.0",'"""]
    + [f"""SELECT concat('  "{name}": ', count(*) FILTER (WHERE {test}){'' if name == 'unresolved_instances' else ", ','"}) FROM st"""
       for name, test in _TOTALS.items()]
    + [f"""SELECT concat('  "{name}_ids": [', CASE WHEN count(*) = 0 THEN '],' ELSE '' END) FROM st WHERE {test}
UNION ALL SELECT '  ],' FROM st WHERE {test} HAVING count(*) > 0
UNION ALL SELECT concat('    "', instance_id, '"', CASE WHEN row_number() OVER (ORDER BY instance_id DESC) > 1 THEN ',' ELSE '' END)
FROM st WHERE {test}""" for name, test in _LISTS.items()])


@register("report_document", _STATUS_CTE + _DOCUMENT)
def q_report_document(spark, sf):
    status = S.instance_status(fixture(spark, sf, "fx_instances"), fixture(spark, sf, "fx_predictions"),
                               fixture(spark, sf, "fx_progress"))
    out = _scratch(spark, "report-document")
    W.write_report(status, out, with_document=True)
    return spark.read.text(f"{out}/report.json").withColumnRenamed("value", "line")


_OVERALL = f"""
UNION ALL SELECT 'overall', count(*), NULL, NULL, NULL, NULL, NULL, count(*) FILTER (WHERE score >= 1.0),
  {sql_round('CAST(count(*) FILTER (WHERE score >= 1.0) AS DOUBLE) / count(*)', 4)},
  count(*) FILTER (WHERE finish_reason = 'error') FROM fx_results"""


@register("write_analysis", ORACLE["task_stats"] + _OVERALL)
def q_write_analysis(spark, sf):
    res = fixture(spark, sf, "fx_results")
    report = RS.analysis_report(res)
    out = _scratch(spark, "analysis")
    W.write_analysis(report, out)
    return spark.read.schema(report.schema).json(f"{out}/analysis")


_ROLL_REWARD = "CASE status WHEN 'completed' THEN 1.0 WHEN 'truncated' THEN -1.0 ELSE 0.0 END"


@register(
    "write_rollout",
    oracle_with("fx_samples") + f"""
SELECT CAST(floor(sample_index / 8) AS BIGINT) AS rollout_id, group_id, sample_index, status, n_tokens,
  CAST({_ROLL_REWARD} AS DOUBLE) AS reward
FROM fx_samples""",
)
def q_write_rollout(spark, sf):
    # stand-in: a rollout is a batch of 8 consecutive samples
    s = fixture(spark, sf, "fx_samples").withColumn("rollout_id", F.floor(F.col("sample_index") / 8).cast("bigint")) \
        .withColumn(
        "reward", F.expr(_ROLL_REWARD)).withColumn("spec_info", F.struct(F.lit("draft").alias("mode")))
    first = s.groupBy("group_id").agg(F.min("sample_index").alias("first_index"))
    from runlens.operators.rl import rollout_info

    info = rollout_info(s.join(first, "group_id"))
    out = _scratch(spark, "rollout")
    W.write_rollout(s, info, out)
    back = spark.read.schema("group_id bigint, sample_index bigint, status string, n_tokens bigint, reward double, "
                             "rollout_id bigint").json(f"{out}/rollout_data")
    return back.select("rollout_id", "group_id", "sample_index", "status", "n_tokens", "reward")


# ── run keys and secrets ───────────────────────────────────────────────────

_MODEL = """concat(CASE user_id % 3 WHEN 0 THEN 'Qwen/' WHEN 1 THEN 'org/sub/' ELSE '' END, 'Model-', event_type,
  ' v', CAST(user_id % 4 AS STRING), CASE WHEN user_id % 5 = 0 THEN '@beta' ELSE '.1' END)"""


@register(
    "run_partition_key",
    f"""SELECT event_id, concat(regexp_replace(regexp_extract({_MODEL}, '[^/]*$'), '[^A-Za-z0-9_\\-.]', '_', 'g'), '_',
  strftime(ts, '%Y%m%d_%H%M%S')) AS run_key FROM events""",
)
def q_run_partition_key(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", W.run_partition_key(F.expr(_MODEL), F.col("ts")).alias("run_key"))


@register(
    "redact_secrets",
    """SELECT doc_id, to_json({'model': source, 'llm': {'base_url': lang, 'nested': {'keep': n_chars}},
  'tools': [{'token': 'z', 'name': 'bash'}], 'headers': MAP {'Accept': 'json'}})::VARCHAR AS config FROM documents""",
)
def q_redact_secrets(spark, sf):
    docs = read_table(spark, sf, "documents")
    cfg = docs.select(
        "doc_id",
        F.col("source").alias("model"),
        F.concat(F.lit("sk-"), F.col("doc_id").cast("string")).alias("API_KEY"),
        F.struct(F.lit("t").alias("Token"), F.col("lang").alias("base_url"),
                 F.struct(F.lit("x").alias("PASSWORD"), F.col("n_chars").alias("keep")).alias("nested")).alias("llm"),
        F.array(F.struct(F.lit("z").alias("token"), F.lit("bash").alias("name"))).alias("tools"),
        F.create_map(F.lit("Accept"), F.lit("json"), F.lit("Secret"), F.lit("s")).alias("headers"),
        F.lit("s").alias("secret"))
    red = W.redact_secrets(cfg)
    return red.select("doc_id", F.to_json(F.struct(*[c for c in red.columns if c != "doc_id"])).alias("config"))


# a config whose depth follows the row: level k holds a secret, a list and level k + 1
_DEPTH = 7


def _open_config(level: int, clean: bool) -> str:
    """SQL text expression of the config below ``level``, with or without secrets."""
    secret = "" if clean else ["'\"Api_Key\":\"k\",'", "'\"TOKEN\":{\"x\":[1]},'", "'\"password\":null,'"][level % 3] + " || "
    below = f" || CASE WHEN doc_id % {_DEPTH} >= {level} THEN ',\"next\":' || {_open_config(level + 1, clean)} ELSE '' END" if level < _DEPTH else ""
    return f"'{{' || {secret}'\"n{level}\":' || CAST(n_chars AS STRING){below} || ',\"tools\":[{{\"token\":\"z\"}}]}}'"


@register("redact_open_json", f"SELECT doc_id, {_open_config(0, True)} AS config, {_open_config(0, True)} AS typed FROM documents".replace("STRING", "VARCHAR"))
def q_redact_open_json(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.expr(_open_config(0, False)).alias("config"))
    red = W.redact_secrets(docs.withColumn("typed", F.parse_json("config")), json_columns=("config",))
    # a VARIANT orders the keys of an object by name; the stand-in has them in that order
    return red.select("doc_id", "config", F.to_json("typed").alias("typed"))


# ── extension points ───────────────────────────────────────────────────────

def demo_scorer(instance, prediction):
    """Example user scorer: a patch must touch the file of the instance's
    language; a missing patch raises (-> error row)."""
    patch = prediction["model_patch"]
    if patch is None:
        raise ValueError("no patch")
    return {"accepted": f"src/{instance['language']}.py" in patch}


@register(
    "register_scorer",
    oracle_with("fx_instances", "fx_predictions") + """
SELECT i.instance_id, CASE WHEN p.model_patch IS NULL THEN 'error'
    WHEN contains(p.model_patch, concat('src/', i.language, '.py')) THEN 'passed' ELSE 'failed' END AS status,
  coalesce(contains(p.model_patch, concat('src/', i.language, '.py')), false) AS accepted,
  CAST(CASE WHEN contains(p.model_patch, concat('src/', i.language, '.py')) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM fx_instances i JOIN fx_predictions p ON i.instance_id = p.instance_id""",
)
def q_register_scorer(spark, sf):
    pairs = fixture(spark, sf, "fx_instances").select("instance_id", "language").join(
        fixture(spark, sf, "fx_predictions").select("instance_id", "model_patch"), "instance_id")
    out = H.apply_scorer(pairs, demo_scorer, ["language"], ["model_patch"], ["instance_id"])
    return out.select("instance_id", "status", "accepted", "score")


_KIND = """CASE event_type WHEN 'purchase' THEN 'submit_int' WHEN 'click' THEN 'file_fl' WHEN 'view' THEN 'submit_file'
  WHEN 'signup' THEN 'default' ELSE 'unknown' END"""
_PARAMS = """CASE event_type WHEN 'purchase' THEN replace(props, '"k"', '"answer"')
  WHEN 'click' THEN concat('{"files": "a', CAST(user_id AS STRING), '.py\\\\n b.py \\\\n\\\\n"}')
  WHEN 'view' THEN concat('{"file_path": " /tmp/x', CAST(user_id AS STRING), '.txt "}')
  ELSE '{}' END"""


@register(
    "register_answer_parser",
    f"""SELECT event_id, {_KIND} AS kind, CASE event_type
  WHEN 'purchase' THEN CAST(TRY_CAST(json_extract_string(replace(props, '"k"', '"answer"'), '$.answer') AS BIGINT) AS VARCHAR)
  WHEN 'click' THEN concat('a', CAST(user_id AS VARCHAR), '.py', chr(10), 'b.py')
  WHEN 'view' THEN concat('/tmp/x', CAST(user_id AS VARCHAR), '.txt') END AS answer FROM events""",
)
def q_register_answer_parser(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", F.expr(_KIND).alias("kind"), F.expr(_PARAMS).alias("params"))
    return ev.select("event_id", "kind", H.parse_answer(F.col("kind"), F.col("params")).alias("answer"))


@register(
    "answer_rows",
    """SELECT event_id, CAST(p AS INTEGER) AS pos, f AS file FROM (
  SELECT event_id, unnest([0, 1]) AS p, unnest([concat('a', CAST(user_id AS VARCHAR), '.py'), 'b.py']) AS f
  FROM events WHERE event_type = 'click')""",
)
def q_answer_rows(spark, sf):
    H.register_answer_rows(spark)
    read_table(spark, sf, "events").select("event_id", F.expr(_KIND).alias("kind"), F.expr(_PARAMS).alias("params")).createOrReplaceTempView("answers_given")
    return spark.sql("SELECT event_id, r.pos, r.file FROM answers_given a, LATERAL answer_rows('file_fl', a.params) r WHERE a.kind = 'file_fl'")


def _count_calls_hook(pdf):
    """Example step callback: tool calls made so far in each run (written
    per run group, so it accepts a batch of complete runs)."""
    calls = (pdf["tool_name"] != "finish").astype("int64").groupby(pdf["run_id"]).cumsum()
    return pdf[["run_id", "step"]].assign(calls_so_far=calls.values)


@register(
    "step_hook",
    oracle_with("fx_calls") + """
SELECT run_id, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN tool_name <> 'finish' THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS calls_so_far
FROM fx_calls""",
)
def q_step_hook(spark, sf):
    calls = fixture(spark, sf, "fx_calls").select("run_id", "step", "tool_name")
    return H.run_step_hooks(calls, _count_calls_hook, "run_id long, step int, calls_so_far long", per_run=False)

