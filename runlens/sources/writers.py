"""Writers: results, trajectories, progress, reports, analysis, rollouts.

Appends go through Spark's file commit protocol, so concurrent jobs append
whole files atomically (the reference serialises appends with a lock).
Outputs are partitioned by run so a run's files stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.open_json import dropper
from runlens.sources.report_file import CLOSE, FIELD, ITEM, OPEN
from runlens.sources.report_file import register as register_document

# Fixed values of the reference: config keys never written to disk.
ROLLOUTS_PER_FOLDER = 1000
# Fixed value: the version of the report document.
REPORT_SCHEMA_VERSION = "1.0"
SECRET_KEYS = ("api_key", "secret", "token", "password", "credentials")


def results_rows(runs: DataFrame) -> DataFrame:
    """Summary row per finished run: score 0.0 when there was no evaluation,
    finish_reason '' when the agent produced no result."""
    evaluated = F.col("eval_score").isNotNull()
    return runs.select(
        "run_id", "instance_id", "dataset_id", "task",
        F.coalesce(F.col("accepted"), F.lit(False)).alias("success"),
        F.when(evaluated, F.col("eval_score")).otherwise(F.lit(0.0)).alias("score"),
        "error",
        F.coalesce(F.col("finish_reason"), F.lit("")).alias("finish_reason"),
    )


def _clustered(rows: DataFrame, folder: str = "run_id", key: str = "instance_id") -> DataFrame:
    """Rows of one folder in a few tasks (up to 16 for a large one), so a
    folder gets a few files and not one per task."""
    return rows.repartition(F.col(folder), F.pmod(F.hash(key), F.lit(16)))


def write_results(runs: DataFrame, path: str, fmt: str = "json") -> None:
    _clustered(results_rows(runs)).write.mode("append").partitionBy("run_id").format(fmt).save(path)


def trajectory_records(runs: DataFrame) -> DataFrame:
    """Runs that have an agent result (trajectory present)."""
    return runs.where(F.col("trajectory").isNotNull())


def write_trajectories(runs: DataFrame, path: str) -> None:
    _clustered(trajectory_records(runs)).write.mode("append").partitionBy("run_id").json(path)


def write_progress(records: DataFrame, path: str) -> None:
    """Append progress records (with their ``seq``) as JSON lines."""
    records.write.mode("append").json(path)


def write_progress_stream(stream: DataFrame, path: str, checkpoint: str):
    """Streaming form: each micro-batch is appended (checkpointed).  A
    replayed batch can append its records again; readers reduce by ``seq``
    (``latest_progress``), so such duplicates do not change any result."""
    def append(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").json(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


#: fixed values: the report's id lists, which stand in its document by name
REPORT_LISTS = ("completed", "empty_patch", "error", "incomplete", "resolved", "submitted", "unresolved")


def report_tokens(status: DataFrame) -> DataFrame:
    """The report document's tokens (``json_document``), unsorted: every id of
    each list, and from one row of totals the lists' ends and the counts.  A
    bucket that the report does not know counts in the totals only; an instance
    without id is ``null`` in its lists."""
    from runlens.operators.scoring import report_totals, sorted_buckets

    totals = report_totals(status)
    entries = sorted([f"{name}_ids" for name in REPORT_LISTS] + totals.columns + ["schema_version"])
    place = {name: at for at, name in enumerate(entries)}

    def one(name: str, kind: int, value: Column) -> Column:
        return F.struct(F.lit(place[name]).alias("place"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(name).alias("name"))

    frame = [one(f"{name}_ids", kind, F.lit(None)) for name in REPORT_LISTS for kind in (OPEN, CLOSE)]
    frame += [one(c, FIELD, F.col(c)) for c in totals.columns] + [one("schema_version", FIELD, F.lit(f'"{REPORT_SCHEMA_VERSION}"'))]
    at = F.create_map(*[F.lit(x) for name in REPORT_LISTS for x in (name, place[f"{name}_ids"])])
    ids = sorted_buckets(status).where(F.col("list_name").isin(*REPORT_LISTS)).select(
        at[F.col("list_name")].alias("place"), F.lit(ITEM).alias("kind"), F.col("instance_id").alias("value"), F.lit(None).cast("string").alias("name"))
    return totals.select(F.explode(F.array(*frame)).alias("t")).select("t.*").unionByName(ids)


def write_report_document(status: DataFrame, file: str) -> None:
    """The whole report as one JSON file, ids by code point, as an indented
    dump of the report writes it.  ``status`` is read twice (totals and lists):
    give it as a table.  See ``report_file`` for how parts become one file."""
    register_document(status.sparkSession)
    rows = report_tokens(status).orderBy("place", "kind", "value")
    rows.write.format("json_document").mode("overwrite").save(file)


def write_report(status: DataFrame, path: str, with_json_view: bool = False, with_document: bool = False) -> None:
    """The report of ``status`` (instance_id, bucket): the long instance table,
    then from what was written the bucket counts and the summary document
    (``schema_version``, totals, submitted, completed and bucket counts); on
    request also the id lists as sorted, bounded JSON chunks, and the whole
    report as one file ``report.json``.  The pipeline behind ``status`` runs
    once."""
    from runlens.operators.scoring import bucket_report, report_json_chunks, report_totals

    status.repartition("bucket", F.hash("instance_id") % 64).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/instances")
    written = status.sparkSession.read.schema("instance_id string, bucket string").parquet(f"{path}/instances")
    bucket_report(written).write.mode("overwrite").json(f"{path}/counts")
    report_totals(written).select(F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"), "*").write.mode("overwrite").json(f"{path}/totals")
    if with_json_view:
        report_json_chunks(written).write.mode("overwrite").json(f"{path}/report")
    if with_document:
        write_report_document(written, f"{path}/report.json")


def write_analysis(report: DataFrame, path: str) -> None:
    """Per-task and overall statistics (``runstats.analysis_report``) next to
    the results."""
    report.write.mode("overwrite").json(f"{path}/analysis")


def write_rollout(samples: DataFrame, info: DataFrame, path: str) -> None:
    """Flat sample dump without ``spec_info``, plus one info row per rollout.

    Rollouts are small and many, so folders hold ``ROLLOUTS_PER_FOLDER``
    consecutive ones, each rollout in one file and sorted by its id."""
    folder = F.floor(F.col("rollout_id") / ROLLOUTS_PER_FOLDER).cast("bigint")
    data = samples.drop("spec_info").withColumn("rollout_folder", folder)
    data.repartition("rollout_folder", F.pmod("rollout_id", F.lit(8))).sortWithinPartitions("rollout_folder", "rollout_id").write.mode(
        "append").partitionBy("rollout_folder").json(f"{path}/rollout_data")
    info.write.mode("append").json(f"{path}/rollout_info")


def run_partition_key(model: Column, ts: Column) -> Column:
    """``{model}_{YYYYMMDD_HHMMSS}``: text after the last ``/`` with every
    character other than word characters, ``-`` and ``.`` replaced by
    ``_`` (Unicode word characters, as Python's ``\\w``)."""
    name = F.regexp_replace(F.substring_index(model, "/", -1), r"(?U)[^\w\-.]", "_")
    return F.concat(name, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def _redact_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _redact_type(f.dataType), f.nullable)
                             for f in dt.fields if f.name.lower() not in SECRET_KEYS])
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        return T.MapType(dt.keyType, _redact_type(dt.valueType), dt.valueContainsNull)
    return dt


def _redact_text(c: Column) -> Column:
    return F.pandas_udf(dropper(frozenset(SECRET_KEYS)), "string")(c)


def _redact(c: Column, dt: T.DataType) -> Column:
    """Drop secret fields of a struct, recursing into structs (not arrays)."""
    if isinstance(dt, T.VariantType):
        return F.try_parse_json(_redact_text(F.to_json(c)))
    if isinstance(dt, T.StructType):
        keep = [f for f in dt.fields if f.name.lower() not in SECRET_KEYS]
        if not keep:
            return F.lit(None).cast(_redact_type(dt))
        return F.when(c.isNull(), F.lit(None).cast(_redact_type(dt))).otherwise(
            F.struct(*[_redact(c[f.name], f.dataType).alias(f.name) for f in keep]))
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        kept = F.map_filter(c, lambda k, v: ~F.lower(k).isin(*SECRET_KEYS))
        if isinstance(dt.valueType, T.StructType | T.MapType):
            return F.transform_values(kept, lambda k, v: _redact(v, dt.valueType))
        return kept
    return c


def redact_secrets(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Remove secret-looking keys (case-insensitive) from every column,
    recursing into nested structs and the values of string-keyed maps, but not
    into arrays, as the reference config snapshot does.

    VARIANT columns and the text columns named in ``json_columns`` hold
    documents of any shape and depth: they are read whole and written again
    without those keys, numbers as written, arrays untouched.  A text in
    ``json_columns`` that is not JSON becomes NULL."""
    keep = [f for f in df.schema.fields if f.name.lower() not in SECRET_KEYS]
    return df.select(*[(_redact_text(F.col(f.name)) if f.name in json_columns else _redact(F.col(f.name), f.dataType)).alias(f.name) for f in keep])
