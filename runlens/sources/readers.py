"""Readers for the files an agent harness writes: JSONL instances,
predictions, progress logs, results, trajectories, task directories, id
lists and search payloads.

Each reader is one Spark read (``text`` / ``json`` / ``binaryFile``) followed
by a parsing job over the rows that read yields (``parse_*``); the parsing
jobs take a DataFrame so they run the same on files and on derived tables.
"""

from __future__ import annotations

import logging
import re
import tomllib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import py_strip
from runlens.session import scratch_path

log = logging.getLogger(__name__)

# Fixed values of the reference: the strict prediction schema.
PREDICTION_KEYS = ("instance_id", "model_name_or_path", "model_patch")


def _nonblank(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.where(py_strip(F.col(col)) != "")


def _parse_strict(text: Column) -> Column:
    """``parse_json`` that raises on malformed lines; blank text gives NULL
    (guarded so that constant folding never parses a blank literal)."""
    return F.when(text != "", F.parse_json(text))


def _typed(raw: Column, schema: T.StructType) -> list[Column]:
    """Typed columns of a VARIANT document (missing keys -> NULL)."""
    return [F.try_variant_get(raw, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields]


# ── instances ──────────────────────────────────────────────────────────────


def parse_instance_lines(lines: DataFrame, schema: T.StructType, keep_raw: bool = True) -> DataFrame:
    """JSONL rows -> typed instance rows (+ ``raw`` VARIANT of the whole record).

    Blank lines are skipped; a malformed line fails the job (``parse_json``
    raises), as the reference loader does."""
    doc = _parse_strict(py_strip(F.col("value")))
    out = _nonblank(lines).select(doc.alias("raw"))
    cols = _typed(F.col("raw"), schema)
    return out.select(*cols, *(["raw"] if keep_raw else []))


def scan_instances(spark: SparkSession, path: str, schema: T.StructType, keep_raw: bool = True) -> DataFrame:
    return parse_instance_lines(spark.read.text(path), schema, keep_raw)


# ── predictions ────────────────────────────────────────────────────────────


def parse_prediction_lines(lines: DataFrame) -> DataFrame:
    """Prediction rows with their key set: ``keys`` (array) next to the three
    fields.  Malformed JSON fails the job."""
    text = py_strip(F.col("value"))
    out = _nonblank(lines).select(_parse_strict(text).alias("_v"), F.json_object_keys(text).alias("keys"))
    return out.select(
        F.try_variant_get("_v", "$.instance_id", "string").alias("instance_id"),
        F.try_variant_get("_v", "$.model_name_or_path", "string").alias("model_name_or_path"),
        F.try_variant_get("_v", "$.model_patch", "string").alias("model_patch"),
        "keys",
    )


def schema_violations(predictions: DataFrame) -> DataFrame:
    """One row per broken prediction: missing required keys, unexpected keys,
    or an id seen more than once (``kind``, ``instance_id``, ``detail``).

    Missing and unexpected keys come out of one generator over the parsed
    rows (no filter that the optimizer could push below the parse); the
    duplicate check is one aggregation."""
    allowed = F.array(*[F.lit(k) for k in PREDICTION_KEYS])
    missing = F.array_sort(F.array_except(allowed, F.col("keys")))
    extra = F.array_sort(F.array_except(F.col("keys"), allowed))

    def violation(kind: str, keys: Column) -> Column:
        return F.when(F.size(keys) > 0, F.struct(F.lit(kind).alias("kind"), F.array_join(keys, ",").alias("detail")))

    keyed = predictions.select("instance_id", F.inline(F.array_compact(F.array(
        violation("missing_keys", missing), violation("unexpected_keys", extra)))))
    keyed = keyed.select("kind", "instance_id", "detail")
    dup = predictions.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        F.lit("duplicate_id").alias("kind"), "instance_id", F.col("n").cast("string").alias("detail"))
    return keyed.unionByName(dup)


def scan_predictions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Predictions; with ``strict`` the job that reads them fails on the first
    broken one (missing or unexpected keys, an id seen more than once), as the
    reference loader does.  The checks are part of that job: one read, one
    shuffle on the id."""
    preds = parse_prediction_lines(spark.read.text(path))
    if not strict:
        return preds.drop("keys")
    allowed = F.array(*[F.lit(k) for k in PREDICTION_KEYS])
    missing = F.array_except(allowed, F.col("keys"))
    extra = F.array_except(F.col("keys"), allowed)
    times = F.count(F.lit(1)).over(Window.partitionBy("instance_id"))

    def broken(kind: str, detail: Column) -> Column:
        return F.raise_error(F.concat_ws(" ", F.lit(f"Prediction schema violation: {kind}"), F.col("instance_id"), detail))

    ok = (F.when(F.size(missing) > 0, broken("missing_keys", F.array_join(missing, ",")))
          .when(F.size(extra) > 0, broken("unexpected_keys", F.array_join(extra, ",")))
          .when(F.col("_times") > 1, broken("duplicate_id", F.col("_times").cast("string")))
          .cast("boolean"))
    return preds.withColumn("_times", times).where(ok.isNull()).drop("keys", "_times")


# ── progress log ───────────────────────────────────────────────────────────

PROGRESS_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("duration", T.DoubleType()),
])


def progress_records(lines: DataFrame) -> DataFrame:
    """Progress records of text ``lines`` (batch or stream); rows without an
    instance id are dropped.

    ``has_error_key`` and ``has_details_error`` are key presence of ``error``
    and ``details.error`` (null values count), ``details_error`` is the value
    of the latter, ``seq`` the writer's sequence number (NULL if it wrote
    none).  A ``log_pos`` column of the lines is kept."""
    text = py_strip(F.col("value"))
    v = _parse_strict(text)
    kept = [c for c in ("log_pos",) if c in lines.columns]
    base = _nonblank(lines).select(*kept, v.alias("_v"), F.json_object_keys(text).alias("_keys"),
                                   F.json_object_keys(F.get_json_object(text, "$.details")).alias("_details"))
    rec = F.struct(
        F.try_variant_get("_v", "$.seq", "bigint").alias("seq"),
        F.try_variant_get("_v", "$.instance_id", "string").alias("instance_id"),
        F.try_variant_get("_v", "$.status", "string").alias("status"),
        F.try_variant_get("_v", "$.outcome", "string").alias("outcome"),
        F.try_variant_get("_v", "$.accepted", "boolean").alias("accepted"),
        F.array_contains("_keys", "error").alias("has_error_key"),
        F.try_variant_get("_v", "$.details.error", "string").alias("details_error"),
        F.coalesce(F.array_contains("_details", "error"), F.lit(False)).alias("has_details_error"),
        F.try_variant_get("_v", "$.duration", "double").alias("duration"),
        *kept,
    )
    # rows without an id are dropped through a generator rather than a
    # filter, so the JSON parse is not pushed into a filter and run twice
    keep = F.coalesce(F.try_variant_get("_v", "$.instance_id", "string"), F.lit("")) != ""
    return base.select(F.inline(F.array_compact(F.array(F.when(keep, rec)))))


LOG_POS = "struct<written:timestamp,path:string,block:bigint,line:bigint>"


def _file_place() -> list[Column]:
    return [F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block")]


def place_stream_lines(lines: DataFrame) -> DataFrame:
    """``value`` and ``log_pos`` of ``spark.readStream.text``: the place that
    ``scan_progress`` gives a line.  Streams have no row-number expression, so
    a counter runs along the rows of each task, which come in file order."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())],
                                             names=[*batch.schema.names, "line"])
            at += batch.num_rows

    numbered = lines.select("value", *_file_place()).mapInArrow(number, "value string, written timestamp, path string, block long, line long")
    return numbered.select("value", F.struct("written", "path", "block", "line").alias("log_pos"))


def scan_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress records with their place in the log.

    ``log_pos`` orders records that carry no ``seq``: by the file's
    modification time, its path, and the line's place in the file, however
    Spark packs files and blocks into tasks (``latest_progress`` uses it after
    ``seq``).  A missing progress file reads as an empty log."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
        lines.schema  # noqa: B018  (forces the path check)
    except AnalysisException:
        return progress_records(spark.createDataFrame([], f"value string, log_pos {LOG_POS}"))
    place = F.struct(*_file_place(), F.monotonically_increasing_id().alias("line"))
    return progress_records(lines.select("value", place.alias("log_pos")))


# ── results and trajectories ───────────────────────────────────────────────

RESULT_SCHEMA = T.StructType([
    T.StructField("instance_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
])


def parse_result_lines(lines: DataFrame, path_col: str = "file_path") -> DataFrame:
    """``results.jsonl`` rows of many run folders; the run id is the name of
    the folder holding the file (a Hive-style ``key=`` prefix is dropped).  A
    malformed line fails the job."""
    folder = F.regexp_extract(F.col(path_col), r"([^/]+)/[^/]+$", 1)
    rows = _nonblank(lines).select(F.from_json(py_strip(F.col("value")), RESULT_SCHEMA, {"mode": "FAILFAST"}).alias("r"),
                                   F.regexp_replace(folder, r"^[^=/]*=", "").alias("run_id"))
    return rows.select("run_id", "r.*")


def scan_results(spark: SparkSession, root: str, pattern: str = "*/results.jsonl") -> DataFrame:
    lines = spark.read.text(f"{root}/{pattern}").select("value", F.col("_metadata.file_path").alias("file_path"))
    return parse_result_lines(lines)


TOOL_CALL_TYPE = ("array<struct<id:string,name:string,arguments:string,"
                  "function:struct<name:string,arguments:string>>>")
TRAJECTORY_SCHEMA = (
    "instance_id string, success boolean, score double, finish_reason string, error string, "
    "duration double, patch string, "
    f"trajectory array<struct<step:int,action:struct<type:string,content:string,tool_calls:{TOOL_CALL_TYPE}>,"
    "observations:array<string>>>, "
    "eval_result struct<accepted:boolean,score:double,duration:double,details:variant>, stats variant"
)


def trajectory_steps(trajectories: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested run records -> one row per step (runs without steps keep one
    row with NULL step fields); ``keep`` names columns of the record that its
    rows carry, so they need no join."""
    ex = trajectories.select("instance_id", "finish_reason", *keep, F.posexplode_outer("trajectory").alias("pos", "s"))
    return ex.select("instance_id", "finish_reason", *keep, "pos", F.col("s.step").alias("step"),
                     F.col("s.action.type").alias("action_type"), F.col("s.action.content").alias("content"),
                     F.col("s.action.tool_calls").alias("tool_calls"), F.col("s.observations").alias("observations"))


def parse_trajectory_lines(lines: DataFrame) -> DataFrame:
    return _nonblank(lines).select(F.from_json(py_strip(F.col("value")), TRAJECTORY_SCHEMA, {"mode": "FAILFAST"}).alias("t")).select("t.*")


def scan_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY_SCHEMA).option("mode", "FAILFAST").json(path)


# ── terminal task directories ──────────────────────────────────────────────

_TASK_DIR = r"^(.*)/([^/]+)$"
TASK_SCHEMA = T.StructType([
    T.StructField("task_dir", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("docker_image", T.StringType()),
    T.StructField("cpus", T.LongType()),
    T.StructField("memory", T.StringType()),
    T.StructField("memory_mb", T.LongType()),
    T.StructField("storage", T.StringType()),
    T.StructField("storage_mb", T.LongType()),
    T.StructField("agent_timeout_sec", T.DoubleType()),
    T.StructField("verifier_timeout_sec", T.DoubleType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _parse_task_tomls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-partition TOML parsing (stdlib ``tomllib``); broken files become
    rows with ``error`` set instead of failing the job."""
    for pdf in batches:
        rows = []
        for d, iid, toml_bytes, instr in zip(pdf["task_dir"], pdf["instance_id"], pdf["toml"], pdf["instruction"]):
            rec = {f.name: None for f in TASK_SCHEMA.fields}
            rec.update(task_dir=d, instance_id=iid, instruction=instr)
            try:
                cfg = tomllib.loads(bytes(toml_bytes).decode("utf-8"))
                env = cfg.get("environment", {}) or {}
                image = env.get("docker_image")
                if not image:
                    raise ValueError("task.toml has no environment.docker_image")
                mem, sto = env.get("memory"), env.get("storage")
                rec.update(
                    docker_image=str(image), cpus=int(env.get("cpus", 1)),
                    memory=None if mem is None else str(mem), memory_mb=int(env.get("memory_mb", 2048)),
                    storage=None if sto is None else str(sto), storage_mb=int(env.get("storage_mb", 10240)),
                    agent_timeout_sec=float((cfg.get("agent", {}) or {}).get("timeout_sec", 600.0)),
                    verifier_timeout_sec=float((cfg.get("verifier", {}) or {}).get("timeout_sec", 600.0)),
                )
            except Exception as exc:  # noqa: BLE001
                rec["error"] = f"{type(exc).__name__}: {exc}"
            rows.append(rec)
        yield pd.DataFrame(rows, columns=[f.name for f in TASK_SCHEMA.fields])


def task_dirs(files: DataFrame) -> DataFrame:
    """``(path, content)`` file rows -> one row per task directory.

    A directory is a task when it holds both ``task.toml`` and
    ``instruction.md``; its TOML must name ``environment.docker_image``.
    Broken tasks keep a row with ``error`` set (the reference skips them
    with a warning; filter on ``error IS NULL`` for the usable list)."""
    f = files.select(F.regexp_extract("path", _TASK_DIR, 1).alias("task_dir"),
                     F.regexp_extract("path", _TASK_DIR, 2).alias("name"), "content")
    f = f.where(F.col("name").isin("task.toml", "instruction.md"))
    grouped = f.groupBy("task_dir").agg(
        F.max(F.when(F.col("name") == "task.toml", F.col("content"))).alias("toml"),
        F.max(F.when(F.col("name") == "instruction.md", F.col("content"))).alias("_instr"),
    )
    tasks = grouped.where(F.col("toml").isNotNull() & F.col("_instr").isNotNull()).select(
        "task_dir", F.substring_index("task_dir", "/", -1).alias("instance_id"), "toml",
        F.decode(F.col("_instr"), "UTF-8").alias("instruction"))
    return tasks.mapInPandas(_parse_task_tomls, TASK_SCHEMA)


def _binary_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    files = spark.read.format("binaryFile").options(**options).load(path)
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), "content")


def _spark_hides(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def unlisted_files(files: DataFrame) -> DataFrame:
    """``(path, content)`` of the files that Spark's readers leave out, in and
    below the folders that hold a ``task.toml`` of ``files``: those without a
    byte, and those with a part below the folder that starts with ``_`` or
    ``.`` (``__init__.py``, ``_helpers.py``, ``.coveragerc``).

    Tasks list and read them with Arrow's file systems (local or mounted paths,
    and the object stores that the installed build knows), a few files at a time."""
    folders = (files.select(F.regexp_extract("path", _TASK_DIR, 1).alias("task_dir"), F.regexp_extract("path", _TASK_DIR, 2).alias("name"))
               .where("name = 'task.toml'").select("task_dir").distinct())

    def listed(batches):
        for pdf in batches:
            for folder in pdf["task_dir"]:
                system, base = pa_fs.FileSystem.from_uri(folder)
                for info in system.get_file_info(pa_fs.FileSelector(base, recursive=True)):
                    below = info.path[len(base):]
                    if info.type == pa_fs.FileType.File and (info.size == 0 or any(map(_spark_hides, below.split("/")))):
                        with system.open_input_stream(info.path) as f:
                            yield pd.DataFrame({"path": [folder + below], "content": [f.read()]})

    # a folder inside a task folder is listed with both
    return folders.mapInPandas(listed, "path string, content binary").dropDuplicates(["path"])


def scan_task_dirs(spark: SparkSession, root: str, unlisted: bool = True) -> DataFrame:
    """Tasks among the direct children of ``root``; with ``unlisted`` also those
    whose instruction is an empty file."""
    files = _binary_files(spark, f"{root.rstrip('/')}/*/", pathGlobFilter="{task.toml,instruction.md}")
    if unlisted:
        tomls = _binary_files(spark, f"{root.rstrip('/')}/*/", pathGlobFilter="task.toml").select("path")
        folder = F.regexp_extract("path", _TASK_DIR, 1)
        blank = unlisted_files(tomls).where(F.substring_index("path", "/", -1) == "instruction.md").withColumn("folder", folder)
        files = files.unionByName(blank.join(tomls.select(folder.alias("folder")), "folder", "left_semi").drop("folder"))
    return task_dirs(files)


def task_files(files: DataFrame, tests_dir: str = "tests") -> DataFrame:
    """Files under each task's ``tests/`` folder as ``(task_dir, key,
    content_b64)`` with key ``/tests/<relative path>`` (long form; build a map
    per task only when needed).

    A task is a folder that holds ``task.toml`` and ``instruction.md``; a path
    belongs to the task above its ``tests`` folder, so ``tests`` folders deeper
    inside are part of the key, and files of other folders are left out."""
    return _in_tasks(files, tests_dir).select("task_dir", "key", F.base64("content").alias("content_b64"))


def _in_tasks(files: DataFrame, tests_dir: str = "tests") -> DataFrame:
    """``task_dir, key`` and the columns of ``files`` that lie under a task's tests folder."""
    parts = files.select(F.regexp_extract("path", _TASK_DIR, 1).alias("task_dir"), F.regexp_extract("path", _TASK_DIR, 2).alias("name"))
    tasks = (parts.where(F.col("name").isin("task.toml", "instruction.md")).groupBy("task_dir")
             .agg(F.count_distinct("name").alias("n")).where(F.col("n") == 2).select("task_dir"))
    # every folder that the path could belong to, one row each: the text before each "/tests/"
    cuts = F.split("path", f"/{tests_dir}/")
    above = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.array_join(F.slice(cuts, 1, i), f"/{tests_dir}/"))
    rows = files.where(F.col("path").contains(f"/{tests_dir}/")).select("*", F.explode(above).alias("task_dir"))
    return rows.join(tasks, "task_dir").withColumn("key", F.substr(F.col("path"), F.length("task_dir") + 1))


def task_files_map(files: DataFrame) -> DataFrame:
    """On-demand map form ``task_dir -> {"/tests/...": base64}`` of
    ``task_files`` output; one map per task, bounded by the task's files."""
    return files.groupBy("task_dir").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("key", "content_b64")))).alias("test_files"))


def listed_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, hidden`` of every file below ``root``, ``hidden`` as Spark's
    readers see it.

    Tasks list the folders with Arrow's file systems and write what they find to
    a scratch table, so no file status goes to the driver.  The folders of the
    first two levels are dealt over the tasks; deeper ones stay with theirs."""
    base = re.sub("^file:/+", "/", root.rstrip("/"))

    def lister(deep: bool):
        def listed(batches):
            for pdf in batches:
                for folder in pdf["path"]:
                    system, top = pa_fs.FileSystem.from_uri(folder)
                    infos = system.get_file_info(pa_fs.FileSelector(top, recursive=deep))
                    for k in range(0, len(infos), 10_000):
                        part = infos[k:k + 10_000]
                        paths = [folder + i.path[len(top):] for i in part]
                        yield pd.DataFrame({
                            "path": paths, "size": [i.size or 0 for i in part], "folder": [i.type == pa_fs.FileType.Directory for i in part],
                            "hidden": [any(map(_spark_hides, p[len(base):].split("/"))) for p in paths]})
        return listed

    out = scratch_path(spark, f"tree-{uuid.uuid4().hex[:12]}")
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level = spark.createDataFrame([(base,)], "path string")
    for k in range(3):
        level.mapInPandas(lister(k == 2), "path string, size long, folder boolean, hidden boolean").write.parquet(f"{out}/{k}")
        # a set number of partitions: adaptive execution would put the few bytes of the names into one
        level = spark.read.parquet(f"{out}/{k}").where("folder").select("path").repartition(n_parts, "path")
    return spark.read.parquet(*[f"{out}/{k}" for k in range(3)]).where("NOT folder").drop("folder")


def _read_whole(files: DataFrame) -> DataFrame:
    """``task_dir, key, content`` of ``task_dir, key, path``: tasks read the files."""
    def read(batches):
        for pdf in batches:
            for task, key, path in zip(pdf["task_dir"], pdf["key"], pdf["path"], strict=True):
                system, name = pa_fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as f:
                    yield pd.DataFrame({"task_dir": [task], "key": [key], "content": [f.read()]})

    return files.select("task_dir", "key", "path").mapInPandas(read, "task_dir string, key string, content binary")


def collect_task_files(spark: SparkSession, root: str, unlisted: bool = True) -> DataFrame:
    """``task_files`` of all folders below ``root``; with ``unlisted`` also the
    files that Spark's readers leave out.

    With ``unlisted`` and the full name of one folder, tasks list and read the
    files (``listed_tree``); a pattern or a relative name goes through Spark's reader."""
    if unlisted and re.match(r"(/|[A-Za-z][A-Za-z0-9+.-]*:/)", root) and not re.search(r"[*?\[{\\]", root):
        tree = listed_tree(spark, root)
        plain = tree.where("NOT hidden AND size > 0").select("path")
        tops = (plain.where(F.regexp_extract("path", _TASK_DIR, 2) == "task.toml")
                .select(F.regexp_extract("path", _TASK_DIR, 1).alias("top")).distinct())
        # of the others those below a folder with a task.toml that Spark's readers list
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        others = tree.where("hidden OR size = 0").select("path", F.explode(above).alias("top")).join(tops, "top").select("path").distinct()
        found = _in_tasks(plain.unionByName(others))
        return _read_whole(found).select("task_dir", "key", F.base64("content").alias("content_b64"))
    files = _binary_files(spark, root, recursiveFileLookup="true")
    if unlisted:
        tomls = _binary_files(spark, root, recursiveFileLookup="true", pathGlobFilter="task.toml").select("path")
        files = files.unionByName(unlisted_files(tomls))
    return task_files(files)


# ── id lists and search payloads ───────────────────────────────────────────


def parse_id_lists(docs: DataFrame, key: str = "list_id", text: str = "value") -> DataFrame:
    """Whole-file JSON documents that must be arrays of ids -> ``(key, pos,
    instance_id)`` keeping the list order; any other document fails the job."""
    arr = F.from_json(F.col(text), "array<string>")
    checked = F.when(arr.isNull(), F.raise_error(F.lit("data_file must be a JSON array of instance IDs"))) \
        .otherwise(arr)
    return docs.select(key, F.posexplode(checked).alias("pos", "instance_id"))


def scan_id_list(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("wholetext", "true").text(path).select(
        F.col("_metadata.file_path").alias("list_id"), "value")
    return parse_id_lists(docs)


_HIT_ITEM = "array<struct<position:bigint,title:string,url:string,link:string,description:string," \
            "snippet:string,snippets:array<string>>>"
_HIT_STRUCT = _HIT_ITEM[len("array<"):-1]


def parse_search_payloads(payloads: DataFrame, text: str = "payload", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Search tool payloads -> normalised hit rows.

    Payload shapes: a JSON list of hits; an object with ``results`` (else
    ``organic_results``, else ``organic``, else the object itself as one hit); text that is not JSON
    becomes one hit whose description is the text.  Missing fields default
    to position 0, '' and [] (url from ``link``, description from
    ``snippet``, snippets = [snippet] when there is one)."""
    t = F.col(text)
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    as_list = F.from_json(t, _HIT_ITEM)
    obj_results = F.try_variant_get(v, "$.results", "variant")
    obj_organic = F.coalesce(F.try_variant_get(v, "$.organic_results", "variant"), F.try_variant_get(v, "$.organic", "variant"))
    inner = F.coalesce(obj_results, obj_organic)
    from_obj = F.when(inner.isNotNull(), F.from_json(F.to_json(inner), _HIT_ITEM)).otherwise(
        F.array(F.from_json(t, _HIT_STRUCT)))
    not_json = F.array(F.struct(F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("title"),
                                F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("link"),
                                t.alias("description"), F.lit(None).cast("string").alias("snippet"),
                                F.lit(None).cast("array<string>").alias("snippets")))
    items = (F.when(v.isNull(), not_json).when(kind.startswith("ARRAY"), as_list)
             .when(kind.startswith("OBJECT"), from_obj).otherwise(F.array().cast(_HIT_ITEM)))
    ex = payloads.select(*keys, F.posexplode_outer(items).alias("item_pos", "h"))
    snip = F.coalesce(F.col("h.snippet"), F.lit(""))
    return ex.where(F.col("h").isNotNull()).select(
        *keys, "item_pos",
        F.coalesce(F.col("h.position"), F.lit(0).cast("bigint")).alias("position"),
        F.coalesce(F.col("h.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("h.url"), F.col("h.link"), F.lit("")).alias("url"),
        F.coalesce(F.col("h.description"), F.col("h.snippet"), F.lit("")).alias("description"),
        F.coalesce(F.col("h.snippets"), F.when(snip != "", F.array(snip)), F.array().cast("array<string>"))
        .alias("snippets"),
    )


def scan_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """One payload per file (the raw search response), keyed by file path."""
    docs = spark.read.option("wholetext", "true").text(path).select(
        F.col("_metadata.file_path").alias("query_id"), F.col("value").alias("payload"))
    return parse_search_payloads(docs)


def scan_search_log(spark: SparkSession, path: str, key: str = "query_id") -> DataFrame:
    """A log of search calls: one JSON object per line with the call's key
    and the raw ``response`` text (any payload shape), parsed like
    ``scan_search_hits``."""
    lines = _nonblank(spark.read.text(path))
    recs = lines.select(F.from_json(F.col("value"), f"{key} string, response string", {"mode": "FAILFAST"}).alias("r"))
    return parse_search_payloads(recs.select(F.col(f"r.{key}").alias(key), F.col("r.response").alias("payload")),
                                 keys=(key,))
