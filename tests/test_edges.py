"""Awkward inputs: logs in several files, broken lines, null keys, missing ids."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.operators import hooks as H
from runlens.operators import scoring as S
from runlens.session import checkpoint_dir
from runlens.sources import readers as RD
from runlens.streaming import streams as ST

from .conftest import scratch


def test_last_record_over_files_without_sequence_numbers(spark):
    """A small old file and a large new one, and the reverse."""
    for first, second in ((1, 3000), (3000, 1)):
        base = scratch(spark, f"log-{first}")
        os.makedirs(base)
        for k, (n, status) in enumerate(((first, "failed"), (second, "passed"))):
            path = f"{base}/part-{9 - k}.jsonl"  # names sort against the writing order
            with open(path, "w") as f:
                f.writelines(f'{{"instance_id": "I-{i}", "status": "error", "note": "{"x" * 50}"}}\n' for i in range(n))
                f.write(f'{{"instance_id": "I-0", "status": "error"}}\n{{"instance_id": "I-0", "status": "{status}"}}\n')
            os.utime(path, (1000 + k, 1000 + k))
        log = RD.scan_progress(spark, base)
        last = {r.instance_id: r.status for r in S.latest_progress(log).collect()}
        assert last["I-0"] == "passed"
        assert "log_pos" not in S.latest_progress(log).columns
        kept = S.latest_progress(S.outcome_inputs(log))
        assert kept.select("instance_id", S.classify_status(kept).alias("o")).where("instance_id = 'I-0'").first().o == "passed"


def test_recorded_sequence_wins_and_missing_log_is_empty(spark):
    base = scratch(spark, "log-seq")
    spark.createDataFrame([('{"seq": 5, "instance_id": "a", "status": "passed"}',), ('{"seq": 4, "instance_id": "a", "status": "failed"}',)], "value string").coalesce(1).write.text(base)
    assert S.latest_progress(RD.scan_progress(spark, base)).first().status == "passed"
    assert RD.scan_progress(spark, base + "-missing").count() == 0


def test_null_details_error_is_an_error(spark):
    lines = spark.createDataFrame([('{"instance_id": "a", "accepted": true, "details": {"error": null}}',), ('{"instance_id": "b", "accepted": true, "details": {"x": 1}}',)], "value string")
    rows = RD.progress_records(lines)
    assert {r.instance_id: r.o for r in rows.select("instance_id", S.classify_status(rows).alias("o")).collect()} == {"a": "error", "b": "passed"}


def test_stream_reads_outcome_and_error_fields(spark):
    base = scratch(spark, "stream-fields")
    spark.createDataFrame([('{"seq":1,"instance_id":"a","outcome":"passed"}',), ('{"seq":2,"instance_id":"b","error":"x","accepted":true}',)], "value string").write.text(f"{base}/in")
    ST.start_progress_counts(ST.read_progress_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/ck").awaitTermination()
    assert {r.outcome: r.n for r in ST.progress_counts(spark, f"{base}/out").collect()} == {"passed": 1, "error": 1}


def test_group_that_overshoots_in_one_batch_is_emitted(spark):
    base = scratch(spark, "overshoot")
    rows = [(1, 10 + i, "completed", 5, 2) for i in range(3)] + [(2, 20, "aborted", 5, 2)]
    spark.createDataFrame(rows, ST.SAMPLE_STREAM_SCHEMA).coalesce(1).write.json(f"{base}/in")
    stream = spark.readStream.schema(ST.SAMPLE_STREAM_SCHEMA).json(f"{base}/in")
    ST.start_groups(stream, f"{base}/out", f"{base}/ck").awaitTermination()
    assert [(r.group_id, r.n_samples) for r in spark.read.parquet(f"{base}/out").collect()] == [(1, 3)]


def test_malformed_result_line_fails(spark):
    lines = spark.createDataFrame([('{"instance_id": "a"', "/x/run1/results.jsonl")], "value string, file_path string")
    with pytest.raises(Exception, match="(?i)malformed"):
        RD.parse_result_lines(lines).collect()


def test_organic_results_payload(spark):
    payloads = spark.createDataFrame([("q", '{"organic_results": [{"title": "a", "link": "u"}, {"title": "b", "snippet": "s"}]}')], "query_id string, payload string")
    got = [(r.title, r.url, r.description) for r in RD.parse_search_payloads(payloads).orderBy("item_pos").collect()]
    assert got == [("a", "u", ""), ("b", "", "s")]


def test_trajectories_keep_stats_and_details(spark):
    path = scratch(spark, "traj")
    line = '{"instance_id": "a", "stats": {"n": 3}, "eval_result": {"accepted": true, "details": {"k": [1, 2]}}, "trajectory": []}'
    spark.createDataFrame([(line,)], "value string").write.text(path)
    r = RD.scan_trajectories(spark, path).select(F.try_variant_get("stats", "$.n", "int").alias("n"), F.try_variant_get("eval_result.details", "$.k[1]", "int").alias("k")).first()
    assert (r.n, r.k) == (3, 2)


@pytest.mark.parametrize("per_run", [True, False])
def test_step_hooks_keep_rows_without_run_id(spark, per_run):
    rows = [("a", 1), (None, 1), (None, 2), ("b", 1)]

    def hook(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(n=len(pdf) if per_run else 0)

    for parts in (rows, rows[1:3]):
        df = spark.createDataFrame(parts, "run_id string, step int")
        got = sorted((r.run_id or "", r.step, r.n) for r in H.run_step_hooks(df, hook, "run_id string, step int, n int", per_run=per_run).collect())
        counts = {k: sum(x == k for x, _ in parts) for k, _ in parts}
        assert got == sorted((k or "", s, counts[k] if per_run else 0) for k, s in parts)


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf({k.replace("_", "."): v for k, v in values.items()})


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x", ""])
def test_no_shared_folder_raises_off_local(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(spark_master=master))


def test_named_folder_is_used():
    assert checkpoint_dir(_Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/ck")) == "hdfs://x/ck"
