"""Queries for instance shaping, id selection, routing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.operators import instances as I
from runlens.plans.registry import register

_NORM = """CASE WHEN translate(lower(coalesce({c}, 'domainfix')), '_- ', '') IN
  ('doc2repo','crossrepo','depmigrate','domainfix') THEN translate(lower(coalesce({c}, 'domainfix')), '_- ', '')
  ELSE 'domainfix' END"""


@register(
    "normalize_task_type",
    oracle_with("fx_instances") + f"\nSELECT instance_id, {_NORM.format(c='task')} AS task_type FROM fx_instances",
)
def q_normalize_task_type(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    return inst.select("instance_id", I.normalize_task_type(F.col("task")).alias("task_type"))


@register(
    "shape_instances_multi",
    oracle_with("fx_instances")
    + f"""
SELECT instance_id, {_NORM.format(c='task')} AS task_type,
  coalesce(nullif(base_commit, ''), nullif(parent_commit, ''), '') AS base_commit,
  '/workspace' AS workdir, coalesce(image_url, '') AS image, coalesce(language, 'python') AS language,
  coalesce(repo, '') AS repo, coalesce(problem_statement, '') AS problem_statement,
  coalesce(parent_commit, '') AS parent_commit, CAST(0 AS INTEGER) AS n_setup_commands
FROM fx_instances""",
)
def q_shape_multi(spark, sf):
    out = I.shape_instances_multi(fixture(spark, sf, "fx_instances"))
    return out.select(
        "instance_id", "task_type", "base_commit", "workdir", "image", "language", "repo",
        "problem_statement", "parent_commit", F.size("setup_commands").alias("n_setup_commands"),
    )


@register(
    "shape_instances_scale",
    oracle_with("fx_instances")
    + """
SELECT instance_id, coalesce(parent_commit, base_commit, '') AS base_commit, '/testbed' AS workdir,
  coalesce(image_url, '') AS image, coalesce(language, 'python') AS language,
  CASE WHEN coalesce(user_name, '') <> '' AND coalesce(repo, '') <> '' THEN concat(user_name, '/', repo)
       ELSE coalesce(repo, '') END AS repo,
  coalesce(problem_statement, '') AS problem_statement, CAST(0 AS INTEGER) AS n_setup_commands
FROM fx_instances""",
)
def q_shape_scale(spark, sf):
    out = I.shape_instances_scale(fixture(spark, sf, "fx_instances"), user="user_name")
    return out.select(
        "instance_id", "base_commit", "workdir", "image", "language", "repo", "problem_statement",
        F.size("setup_commands").alias("n_setup_commands"),
    )


@register(
    "full_repo_name",
    oracle_with("fx_instances")
    + """
SELECT instance_id, CASE WHEN coalesce(user_name, '') <> '' AND coalesce(repo, '') <> ''
  THEN concat(user_name, '/', repo) ELSE coalesce(repo, '') END AS full_repo FROM fx_instances""",
)
def q_full_repo_name(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    return inst.select("instance_id", I.full_repo_name(F.col("user_name"), F.col("repo")).alias("full_repo"))


# stand-in pre_commands text: real trailing newline, literal backslash-n, blank
_PRE = """CASE turn % 3 WHEN 0 THEN concat(' pip install ', role, chr(10))
                   WHEN 1 THEN concat('make ', role, chr(92), 'n')
                   ELSE '   ' END"""


@register(
    "setup_commands",
    """WITH p AS (SELECT conv_id, turn, """
    + _PRE
    + """ AS pre_commands FROM conversations),
s AS (SELECT conv_id, turn, regexp_replace(pre_commands, '^\\s+|\\s+$', '', 'g') AS t FROM p)
SELECT conv_id, turn, CASE WHEN t = '' THEN 0 ELSE 1 END AS n_commands,
  CASE WHEN t = '' THEN NULL WHEN suffix(t, chr(92) || 'n') THEN left(t, length(t) - 2) ELSE t END AS command
FROM s""",
)
def q_setup_commands(spark, sf):
    conv = read_table(spark, sf, "conversations")
    raw = conv.select("conv_id", "turn", F.expr(_PRE).alias("pre_commands"))
    cmds = I.setup_commands(raw)
    return raw.select("conv_id", "turn", F.size(cmds).alias("n_commands"),
                      F.try_element_at(cmds, F.lit(1)).alias("command"))


_PREFIX = "mirror.example/team//"


@register(
    "rewrite_image",
    oracle_with("fx_instances")
    + """
SELECT instance_id, concat('mirror.example/team/', regexp_extract(image_url, '[^/]*$', 0)) AS image
FROM fx_instances""",
)
def q_rewrite_image(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    return inst.select("instance_id", I.rewrite_image(F.col("image_url"), _PREFIX).alias("image"))


# stand-in size strings built from part rows: number, optional fraction, unit
_SIZE = """CASE WHEN p_partkey % 23 = 0 THEN 'lots'
     WHEN p_partkey % 19 = 0 THEN concat('-', CAST(p_size AS STRING), 'K')
     WHEN p_partkey % 17 = 0 THEN concat(CAST(p_size AS STRING), '.5.1G')
     ELSE concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING),
       CASE p_partkey % 13 WHEN 0 THEN 'G' WHEN 1 THEN 'Gi' WHEN 2 THEN 'M' WHEN 3 THEN 'mi' WHEN 4 THEN 'K'
         WHEN 5 THEN 'Ki' WHEN 6 THEN 'GB' WHEN 7 THEN 'mb' WHEN 8 THEN 'KB' WHEN 9 THEN '' WHEN 10 THEN 'x'
         WHEN 11 THEN ' MB' ELSE 'kb' END) END"""

_PARSE_SQL = """(CASE WHEN v IS NULL THEN 0
  WHEN u IN ('G','GI') THEN CAST(trunc(v * 1024) AS BIGINT)
  WHEN u IN ('M','MI') THEN CAST(trunc(v) AS BIGINT)
  WHEN u IN ('K','KI') THEN greatest(CAST(trunc(v / 1024) AS BIGINT), 0)
  WHEN u = 'GB' THEN CAST(trunc(v * 1000) AS BIGINT)
  WHEN u = 'MB' THEN CAST(trunc(v) AS BIGINT)
  WHEN u = 'KB' THEN greatest(CAST(trunc(v / 1000) AS BIGINT), 0)
  ELSE CAST(trunc(v) AS BIGINT) END)"""

_SIZES_CTE = f"""s AS (SELECT p_partkey, p_size, {_SIZE} AS size_text FROM part),
n AS (SELECT *, regexp_extract(size_text, '^[0-9.\\-]*', 0) AS num FROM s),
x AS (SELECT *, CASE WHEN num = '' THEN 0.0 ELSE TRY_CAST(num AS DOUBLE) END AS v,
             upper(substr(size_text, length(num) + 1)) AS u FROM n)"""


@register("parse_size_mb", f"WITH {_SIZES_CTE}\nSELECT p_partkey, size_text, {_PARSE_SQL} AS size_mb FROM x")
def q_parse_size_mb(spark, sf):
    part = read_table(spark, sf, "part")
    sizes = part.select("p_partkey", F.expr(_SIZE).alias("size_text"))
    return sizes.select("p_partkey", "size_text", I.parse_size_mb(F.col("size_text")).alias("size_mb"))


@register(
    "resource_limits",
    f"""WITH {_SIZES_CTE},
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN size_text END AS memory,
        CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 100 AS BIGINT) END AS memory_mb,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 4 END AS cpus, {_PARSE_SQL} AS parsed FROM x)
SELECT p_partkey, CAST(coalesce(cpus, 1) AS VARCHAR) AS cpu,
  concat(CAST(CASE WHEN memory IS NOT NULL THEN parsed ELSE coalesce(memory_mb, 2048) END AS VARCHAR), 'Mi')
    AS memory_limit,
  CAST(10240 AS BIGINT) AS storage_mb_eff FROM r""",
)
def q_resource_limits(spark, sf):
    part = read_table(spark, sf, "part")
    toml = part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.expr(_SIZE)).alias("memory"),
        F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") * 100).cast("bigint")).alias("memory_mb"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 4).alias("cpus"),
    )
    return I.resource_limits(toml).select("p_partkey", "cpu", "memory_limit", "storage_mb_eff")


@register(
    "filter_ids_ci",
    oracle_with("fx_instances")
    + """
SELECT instance_id, task FROM fx_instances
WHERE lower(instance_id) IN (SELECT lower(concat('i-', CAST(user_id AS VARCHAR))) FROM events)""",
)
def q_filter_ids_ci(spark, sf):
    ids = read_table(spark, sf, "events").select(F.concat(F.lit("i-"), F.col("user_id").cast("string"))
                                                 .alias("instance_id"))
    inst = fixture(spark, sf, "fx_instances").select("instance_id", "task")
    return I.filter_ids_ci(inst, ids)


@register(
    "filter_ids_ordered",
    oracle_with("fx_progress", "fx_predictions")
    + """
SELECT seq AS pos, instance_id FROM fx_progress
WHERE instance_id IN (SELECT instance_id FROM fx_predictions) ORDER BY seq""",
)
def q_filter_ids_ordered(spark, sf):
    id_list = fixture(spark, sf, "fx_progress").select(F.col("seq").alias("pos"), "instance_id")
    return I.filter_ids_ordered(id_list, fixture(spark, sf, "fx_predictions"))


# stand-in routing context: dataset and search mode from the instance language
_CTX = """CASE language WHEN 'en' THEN 'beyond_swe' WHEN 'fr' THEN 'scale_swe' ELSE 'other' END"""
_SEARCH = "language IN ('en', 'de')"

_ROUTES_SQL = """routes(dataset_id, task_type, search, system_key, user_key) AS (VALUES
 ('beyond_swe','doc2repo',false,'beyondswe','doc2repo'),
 ('beyond_swe','doc2repo',true,'search_beyondswe','search_doc2repo'),
 ('beyond_swe','crossrepo',false,'beyondswe','crossrepo'),
 ('beyond_swe','crossrepo',true,'search_beyondswe','search_crossrepo'),
 ('beyond_swe','depmigrate',false,'beyondswe','depmigrate'),
 ('beyond_swe','depmigrate',true,'search_beyondswe','search_depmigrate'),
 ('beyond_swe','domainfix',false,'beyondswe','domainfix'),
 ('beyond_swe','domainfix',true,'search_domainfix','search_domainfix'),
 ('scale_swe',NULL,false,'openhands','scaleswe'))"""

_ROUTED = f""",
{_ROUTES_SQL},
ctx AS (SELECT instance_id, {_CTX} AS dataset_id, {_NORM.format(c='task')} AS task_type, {_SEARCH} AS search,
          base_commit, parent_commit, problem_statement FROM fx_instances),
routed AS (SELECT c.*, coalesce(e.system_key, w.system_key, 'beyondswe') AS system_key,
          coalesce(e.user_key, w.user_key, 'domainfix') AS user_key
  FROM ctx c LEFT JOIN routes e ON e.task_type IS NOT NULL AND c.dataset_id = e.dataset_id
                               AND c.task_type = e.task_type AND c.search = e.search
             LEFT JOIN routes w ON w.task_type IS NULL AND c.dataset_id = w.dataset_id AND c.search = w.search)"""


def _routed(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    ctx = inst.select(
        "instance_id", F.expr(_CTX).alias("dataset_id"), I.normalize_task_type(F.col("task")).alias("task_type"),
        F.expr(_SEARCH).alias("search"), "base_commit", "parent_commit", "problem_statement",
    )
    return I.route_prompt(ctx)


@register(
    "route_prompt",
    oracle_with("fx_instances") + _ROUTED + "\nSELECT instance_id, dataset_id, task_type, search, system_key,"
    " user_key FROM routed",
)
def q_route_prompt(spark, sf):
    return _routed(spark, sf).select("instance_id", "dataset_id", "task_type", "search", "system_key", "user_key")


_KEYS = ["doc2repo", "search_doc2repo", "crossrepo", "search_crossrepo", "depmigrate", "search_depmigrate",
         "domainfix", "search_domainfix", "scaleswe"]
_KEY_ARRAY = "array(" + ", ".join(f"'{k}'" for k in _KEYS) + ")"
_TEMPLATE = ("concat(text, chr(10), 'Workspace: {{workspace_dir}}', chr(10), '{{problem_statement}}', chr(10),"
             " 'Base commit: {{base_commit}}; literal braces {{{{x}}}}')")


@register(
    "render_prompt",
    oracle_with("fx_instances")
    + _ROUTED
    + f""",
tpl AS (SELECT {_KEY_ARRAY.replace('array(', '[').rstrip(')')}][CAST(item_id % 9 AS INTEGER) + 1] AS user_key,
          arg_min({_TEMPLATE.format()}, item_id) AS template FROM benchmark GROUP BY 1),
shaped AS (SELECT r.instance_id, r.user_key, t.template,
  coalesce(nullif(r.base_commit, ''), nullif(r.parent_commit, ''), '') AS bc, r.problem_statement AS ps
  FROM routed r LEFT JOIN tpl t ON r.user_key = t.user_key)
SELECT instance_id, user_key,
  replace(replace(replace(replace(replace(template, '{{workspace_dir}}', '/workspace'),
    '{{problem_statement}}', ps), '{{base_commit}}', bc), '{{{{', '{{'), '}}}}', '}}') AS prompt,
  CAST(NULL AS VARCHAR) AS render_error
FROM shaped""",
)
def q_render_prompt(spark, sf):
    bench = read_table(spark, sf, "benchmark")
    keyed = bench.select(
        F.element_at(F.expr(_KEY_ARRAY), (F.col("item_id") % 9 + 1).cast("int")).alias("user_key"),
        F.expr(_TEMPLATE.format()).alias("template"), "item_id",
    )
    templates = keyed.groupBy("user_key").agg(F.min_by("template", "item_id").alias("template"))
    shaped = I.shape_instances_multi(fixture(spark, sf, "fx_instances"))
    routed = _routed(spark, sf).select("instance_id", "user_key")
    rows = shaped.join(routed, "instance_id")
    variables = {
        "workspace_dir": F.col("workdir"),
        "problem_statement": F.col("problem_statement"),
        "base_commit": F.col("base_commit"),
        "workspace_tree": F.lit(""),
        "installed_packages": F.lit(""),
        "REPO_DOCUMENT": F.col("repo_document"),
    }
    out = I.render_prompt(rows, templates, variables)
    return out.select("instance_id", "user_key", "prompt", "render_error")
