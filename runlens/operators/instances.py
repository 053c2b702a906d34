"""Shaping benchmark instances: task types, field mappings, ids, routes,
resources and prompt rendering.

Instances arrive with an open schema; a column missing from the DataFrame is
a missing key.  Two null rules are kept apart:

* key-presence default (``raw.get(a, raw.get(b, d))``): ``coalesce(a, b, d)``
  -- an explicit ``''`` wins;
* truthiness chain (``a or b or c``): ``''`` and NULL both fall through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import col_or_null, py_strip, truthy_chain

# Fixed values of the reference: known multi-type task types and the fallback.
KNOWN_TASK_TYPES = ("doc2repo", "crossrepo", "depmigrate", "domainfix")
DEFAULT_TASK_TYPE = "domainfix"

# Fixed values of the reference: prompt route table
# (dataset_id, task_type or None for any type, search) -> (system key, user key).
PROMPT_ROUTES = [
    ("beyond_swe", "doc2repo", False, "beyondswe", "doc2repo"),
    ("beyond_swe", "doc2repo", True, "search_beyondswe", "search_doc2repo"),
    ("beyond_swe", "crossrepo", False, "beyondswe", "crossrepo"),
    ("beyond_swe", "crossrepo", True, "search_beyondswe", "search_crossrepo"),
    ("beyond_swe", "depmigrate", False, "beyondswe", "depmigrate"),
    ("beyond_swe", "depmigrate", True, "search_beyondswe", "search_depmigrate"),
    ("beyond_swe", "domainfix", False, "beyondswe", "domainfix"),
    ("beyond_swe", "domainfix", True, "search_domainfix", "search_domainfix"),
    ("scale_swe", None, False, "openhands", "scaleswe"),
]
DEFAULT_ROUTE = ("beyondswe", "domainfix")

# Fixed values of the reference: terminal task resource defaults.
DEFAULT_CPUS = 1
DEFAULT_MEMORY_MB = 2048
DEFAULT_STORAGE_MB = 10240
DEFAULT_TIMEOUT_SEC = 600.0


def normalize_task_type(c: Column) -> Column:
    """lower-case, drop ``_ - space``; unknown or missing -> ``domainfix``."""
    key = F.translate(F.lower(F.coalesce(c, F.lit(DEFAULT_TASK_TYPE))), "_- ", "")
    return F.when(key.isin(*KNOWN_TASK_TYPES), key).otherwise(F.lit(DEFAULT_TASK_TYPE))


def setup_commands(df: DataFrame, field: str = "pre_commands") -> Column:
    """``pre_commands`` -> ``array<string>``.

    String form: stripped, one literal trailing backslash-n (two characters)
    removed, empty -> ``[]``.  Struct form: ``execute_command.commands``.
    """
    if field not in df.columns:
        return F.array().cast("array<string>")
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.StringType):
        s = py_strip(F.col(field))
        cmd = F.regexp_replace(s, r"\\n\z", "")
        return F.when(F.coalesce(s, F.lit("")) != "", F.array(cmd)).otherwise(F.array().cast("array<string>"))
    if isinstance(dtype, T.StructType) and "execute_command" in dtype.fieldNames():
        return F.coalesce(F.col(f"{field}.execute_command.commands").cast("array<string>"),
                          F.array().cast("array<string>"))
    return F.array().cast("array<string>")


def full_repo_name(user: Column, repo: Column) -> Column:
    """``user/repo`` only if both are non-empty, else ``repo``."""
    u, r = F.coalesce(user, F.lit("")), F.coalesce(repo, F.lit(""))
    return F.when((u != "") & (r != ""), F.concat(u, F.lit("/"), r)).otherwise(r)


def shape_instances_multi(raw: DataFrame) -> DataFrame:
    """Multi-type mapping: base commit by truthiness chain (incl. ``base.sha``),
    ``image`` before ``image_url``, ``patch`` before ``fix_patch``,
    workdir default ``/workspace``."""
    c = lambda n: col_or_null(raw.columns, n)
    base_sha = F.col("base.sha") if "base" in raw.columns else F.lit(None)
    return raw.select(
        F.coalesce(c("instance_id"), F.lit("")).alias("instance_id"),
        normalize_task_type(c("task")).alias("task_type"),
        truthy_chain(c("base_commit"), c("pre_agent_commit_id"), c("parent_commit"), base_sha).alias("base_commit"),
        F.coalesce(c("workdir"), F.lit("/workspace")).alias("workdir"),
        F.coalesce(c("image"), c("image_url"), F.lit("")).alias("image"),
        F.coalesce(c("language"), F.lit("python")).alias("language"),
        F.coalesce(c("repo"), F.lit("")).alias("repo"),
        F.coalesce(c("problem_statement"), F.lit("")).alias("problem_statement"),
        F.coalesce(c("REPO_DOCUMENT_CONTENT"), F.lit("")).alias("repo_document"),
        F.coalesce(c("patch"), c("fix_patch"), F.lit("")).alias("gold_patch"),
        F.coalesce(c("parent_commit"), F.lit("")).alias("parent_commit"),
        setup_commands(raw).alias("setup_commands"),
    )


def shape_instances_scale(raw: DataFrame, user: str = "user") -> DataFrame:
    """Scale mapping: ``parent_commit`` before ``base_commit`` by key presence,
    ``image_url`` before ``image``, workdir default ``/testbed``, repo is
    ``user/repo``."""
    c = lambda n: col_or_null(raw.columns, n)
    return raw.select(
        F.coalesce(c("instance_id"), F.lit("")).alias("instance_id"),
        F.coalesce(c("parent_commit"), c("base_commit"), F.lit("")).alias("base_commit"),
        F.coalesce(c("workdir"), F.lit("/testbed")).alias("workdir"),
        F.coalesce(c("image_url"), c("image"), F.lit("")).alias("image"),
        F.coalesce(c("language"), F.lit("python")).alias("language"),
        full_repo_name(c(user), c("repo")).alias("repo"),
        F.coalesce(c("problem_statement"), F.lit("")).alias("problem_statement"),
        F.coalesce(c("patch"), c("fix_patch"), F.lit("")).alias("gold_patch"),
        setup_commands(raw).alias("setup_commands"),
    )


def rewrite_image(image_url: Column, prefix: str | None) -> Column:
    """With a registry prefix keep only the image name (text after the last
    ``/``) under the prefix (right-stripped of ``/``); no prefix: unchanged."""
    if not prefix:
        return image_url
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.substring_index(image_url, "/", -1))


def parse_size_mb(size: Column) -> Column:
    """Size text -> whole MB.

    Leading ``[0-9.-]`` characters are the number (empty -> 0, unparsable ->
    0); the rest, upper-cased, is the unit: G/GI x1024, M/MI x1, K/KI /1024
    (floored at 0), GB x1000, MB x1, KB /1000 (floored at 0), anything else
    x1.  Results truncate toward zero.
    """
    s = py_strip(size.cast("string"))
    num = F.regexp_extract(s, r"^[0-9.\-]*", 0)
    val = F.when(num == "", F.lit(0.0)).otherwise(num.try_cast("double"))
    unit = F.upper(F.regexp_replace(s, r"^[0-9.\-]*", ""))
    trunc = lambda x: x.cast("bigint")  # noqa: E731  (cast truncates toward zero)
    return (
        F.when(val.isNull(), F.lit(0).cast("bigint"))
        .when(unit.isin("G", "GI"), trunc(val * 1024))
        .when(unit.isin("M", "MI"), trunc(val))
        .when(unit.isin("K", "KI"), F.greatest(trunc(val / 1024), F.lit(0).cast("bigint")))
        .when(unit == "GB", trunc(val * 1000))
        .when(unit == "MB", trunc(val))
        .when(unit == "KB", F.greatest(trunc(val / 1000), F.lit(0).cast("bigint")))
        .otherwise(trunc(val))
    )


def resource_limits(df: DataFrame) -> DataFrame:
    """Container limits of a terminal task: ``memory``/``storage`` text
    override ``memory_mb``/``storage_mb``; output ``cpu`` as text and
    ``memory`` as ``{mb}Mi``."""
    c = lambda n: col_or_null(df.columns, n)
    mem_mb = F.when(c("memory").isNotNull(), parse_size_mb(c("memory"))).otherwise(
        F.coalesce(c("memory_mb").cast("bigint"), F.lit(DEFAULT_MEMORY_MB).cast("bigint")))
    sto_mb = F.when(c("storage").isNotNull(), parse_size_mb(c("storage"))).otherwise(
        F.coalesce(c("storage_mb").cast("bigint"), F.lit(DEFAULT_STORAGE_MB).cast("bigint")))
    cpus = F.coalesce(c("cpus").cast("bigint"), F.lit(DEFAULT_CPUS).cast("bigint"))
    return df.select(
        "*",
        cpus.cast("string").alias("cpu"),
        F.concat(mem_mb.cast("string"), F.lit("Mi")).alias("memory_limit"),
        mem_mb.alias("memory_mb_eff"),
        sto_mb.alias("storage_mb_eff"),
        F.coalesce(c("agent_timeout_sec").cast("double"), F.lit(DEFAULT_TIMEOUT_SEC)).alias("agent_timeout"),
    )


def filter_ids_ci(instances: DataFrame, ids: DataFrame | None, key: str = "instance_id") -> DataFrame:
    """Case-insensitive id selection; ``None`` keeps every instance."""
    if ids is None:
        return instances
    wanted = ids.select(F.lower(F.col(key)).alias("_lid")).distinct()
    return instances.join(wanted, F.lower(instances[key]) == wanted["_lid"], "left_semi")


def filter_ids_ordered(id_list: DataFrame, wanted: DataFrame | None, key: str = "instance_id",
                       pos: str = "pos") -> DataFrame:
    """Terminal tasks: case-sensitive membership, dataset list order kept."""
    kept = id_list if wanted is None else id_list.join(wanted.select(key), key, "left_semi")
    return kept.orderBy(pos)


def route_table(spark) -> DataFrame:
    schema = "dataset_id string, task_type string, search boolean, system_key string, user_key string"
    return spark.createDataFrame(PROMPT_ROUTES, schema)


def route_prompt(df: DataFrame, dataset: str = "dataset_id", task_type: str = "task_type",
                 search: str = "search") -> DataFrame:
    """(system_key, user_key): exact route, else the dataset wildcard route,
    else the default.  The route table is a fixed 9-row constant, so it is
    broadcast; the two lookups are equi-joins, not an OR-join."""
    routes = F.broadcast(route_table(df.sparkSession))
    exact = routes.where(F.col("task_type").isNotNull()).select(
        F.col("dataset_id").alias("_ed"), F.col("task_type").alias("_et"), F.col("search").alias("_es"),
        F.col("system_key").alias("_esys"), F.col("user_key").alias("_eusr"))
    wild = routes.where(F.col("task_type").isNull()).select(
        F.col("dataset_id").alias("_wd"), F.col("search").alias("_ws"),
        F.col("system_key").alias("_wsys"), F.col("user_key").alias("_wusr"))
    out = df.join(exact, (df[dataset] == exact["_ed"]) & (df[task_type] == exact["_et"])
                  & (df[search] == exact["_es"]), "left")
    out = out.join(wild, (out[dataset] == wild["_wd"]) & (out[search] == wild["_ws"]), "left")
    return out.select(
        *df.columns,
        F.coalesce("_esys", "_wsys", F.lit(DEFAULT_ROUTE[0])).alias("system_key"),
        F.coalesce("_eusr", "_wusr", F.lit(DEFAULT_ROUTE[1])).alias("user_key"),
    )


_TOKEN = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def tokenize_templates(templates: DataFrame, text: str = "template") -> DataFrame:
    """Split each template once into literal and ``{field}`` tokens."""
    return templates.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(f"({_TOKEN})"), 1))


def render_prompt(df: DataFrame, templates: DataFrame, variables: dict[str, Column],
                  key: str = "user_key") -> DataFrame:
    """``str.format`` of the routed template with the row's variables.

    Each template is tokenized once (template side); a row substitutes every
    ``{name}`` token exactly once, so a value that itself contains ``{x}`` is
    never expanded again.  ``{{``/``}}`` unescape to braces.  A placeholder
    that is not a known variable yields ``prompt = NULL`` and names the field
    in ``render_error`` (the reference raises ``KeyError``).
    """
    toks = tokenize_templates(templates).select(F.col(key).alias("_tk"), "_tokens")
    vars_map = F.create_map(*[x for k, v in variables.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    out = df.join(toks, df[key] == toks["_tk"], "left").withColumn("_vars", vars_map)

    def sub(t):
        name = F.substring(t, 2, F.length(t) - 2)
        return (
            F.when(t == "{{", F.lit("{"))
            .when(t == "}}", F.lit("}"))
            .when(t.startswith("{") & t.endswith("}") & (F.length(t) >= 2), F.try_element_at(F.col("_vars"), name))
            .otherwise(t)
        )

    parts = F.transform(F.col("_tokens"), sub)
    missing = F.filter(
        F.col("_tokens"),
        lambda t: t.startswith("{") & t.endswith("}") & (t != "{{") & (t != "}}")
        & ~F.map_contains_key(F.col("_vars"), F.substring(t, 2, F.length(t) - 2)),
    )
    return out.select(
        *df.columns,
        F.when(F.size(missing) == 0, F.array_join(parts, "")).alias("prompt"),
        F.when(F.size(missing) > 0, F.element_at(missing, 1)).alias("render_error"),
    )
