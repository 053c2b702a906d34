"""Streaming equals batch under availableNow, across several micro-batches."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens.fixtures import BASE_TABLES
from runlens.operators import scoring as S
from runlens.plans import ORACLE, QUERIES
from runlens.sources import readers as RD
from runlens.sources import tail
from runlens.streaming import processors as PR
from runlens.streaming import streams as ST
from runlens.streaming import watchdog as WD

from .conftest import SF_MID, SF_SMALL, rows, scratch

# the record as writers append it (readers parse text lines)
RECORD = "seq bigint, instance_id string, status string, accepted boolean, duration double, details struct<error:string>"


def test_progress_latest_stream_equals_batch(spark):
    rows = [(i, f"I-{i % 7}", ["passed", "failed", "error", None][i % 4], i % 5 == 0, float(i), None)
            for i in range(200)]
    df = spark.createDataFrame(rows, RECORD)
    base = scratch(spark, "t-stream-latest")
    for k in range(4):
        df.where(F.col("seq") % 4 == k).write.mode("append").json(f"{base}/landing")
    q = ST.start_progress_latest(ST.read_progress_stream(spark, f"{base}/landing", files_per_trigger=1),
                                 f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    got = sorted((r.instance_id, r.seq) for r in ST.latest_view(spark, f"{base}/out").collect())
    exp = sorted((r.instance_id, r.seq) for r in S.latest_progress(df).collect())
    assert got == exp
    assert spark.read.parquet(f"{base}/out").select("epoch").distinct().count() > 1


def test_watchdog_gap_rule():
    assert [PR.warnings_in_gap(g, 30.0) for g in (0, 10, 30, 31, 60, 61, 95)] == [0, 0, 0, 1, 1, 2, 3]


def test_watchdog_listener_counts_idle_batches():
    class P:
        def __init__(self, n):
            self.id, self.numInputRows = "q", n

    class E:
        def __init__(self, n):
            self.progress = P(n)

    clock = iter([0.0, 10.0, 45.0, 50.0, 80.0]).__next__
    w = WD.WatchdogListener(timeout=30.0, clock=clock)
    w.last_progress["q"] = 0.0
    for n in (5, 0, 0, 0, 0):
        w.onQueryProgress(E(n))
    assert len(w.warnings) == 2


def test_results_append_is_exactly_once_across_restarts(spark):
    base = scratch(spark, "results-restart")
    landing, out, ckpt = f"{base}/landing", f"{base}/out", f"{base}/ckpt"
    rows = [(f"r{i % 3}", f"I-{i}", "t", float(i % 2), "finish") for i in range(30)]
    df = spark.createDataFrame(rows, ST.RESULT_STREAM_SCHEMA)

    def run_once():
        stream = spark.readStream.schema(ST.RESULT_STREAM_SCHEMA).json(landing)
        ST.start_results_append(stream, out, ckpt).awaitTermination()

    df.where("instance_id < 'I-2'").write.mode("append").json(landing)
    run_once()
    run_once()                                  # restart with nothing new: no duplicates
    df.where("instance_id >= 'I-2'").write.mode("append").json(landing)
    run_once()                                  # restart: only the new files are processed
    got = sorted(r.instance_id for r in spark.read.parquet(out).collect())
    assert got == sorted(r[1] for r in rows)


def test_watchdog_state_is_carried_over_batches(spark):
    base = scratch(spark, "wd-waves")
    schema = "rollout_id bigint, event_id bigint, ts_seconds double"
    waves = [[(7, 1, 0.0), (7, 2, 40.0), (8, 1, 5.0)], [(7, 3, 100.0)], [(8, 2, 200.0), (7, 4, 101.0)]]
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(schema).json(f"{base}/in")
        (WD.watchdog_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination())
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(7, 2, 40.0, 1), (7, 3, 60.0, 1), (8, 2, 195.0, 6)]


def test_watchdog_live_timer_fires_on_continuous_trigger(spark):
    import time

    base = scratch(spark, "wd-live")
    rows = [(r % 3, i, float(i)) for i, r in enumerate(range(30))]
    spark.createDataFrame(rows, "rollout_id bigint, event_id bigint, ts_seconds double").write.json(f"{base}/in")
    s = spark.readStream.schema("rollout_id bigint, event_id bigint, ts_seconds double").json(f"{base}/in")
    q = (WD.watchdog_stream(s, timeout=1.0, live=True).writeStream.outputMode("append").format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
         .trigger(processingTime="500 milliseconds").start())
    time.sleep(8)
    q.stop()
    out = spark.read.parquet(f"{base}/out")
    assert out.where("event_id IS NULL").count() > 0


def test_latest_view_with_snapshot_compaction(spark):
    base = scratch(spark, "compact")
    schema = RECORD
    first = spark.createDataFrame([(i, f"I-{i % 4}", "failed", False, 1.0, None) for i in range(8)], schema)
    second = spark.createDataFrame([(100 + i, f"I-{i % 2}", "passed", True, 1.0, None) for i in range(4)], schema)

    def run():
        ST.start_progress_latest(ST.read_progress_stream(spark, f"{base}/in"), f"{base}/log", f"{base}/ck") \
            .awaitTermination()

    first.write.mode("append").json(f"{base}/in")
    run()
    ST.compact_latest(spark, f"{base}/log", f"{base}/snap1")
    second.write.mode("append").json(f"{base}/in")
    run()
    full = sorted((r.instance_id, r.seq) for r in ST.latest_view(spark, f"{base}/log").collect())
    fast = sorted((r.instance_id, r.seq) for r in ST.latest_view(spark, f"{base}/log", f"{base}/snap1").collect())
    assert full == fast == [("I-0", 102), ("I-1", 103), ("I-2", 6), ("I-3", 7)]
    ST.compact_latest(spark, f"{base}/log", f"{base}/snap2", previous=f"{base}/snap1")
    assert sorted((r.instance_id, r.seq) for r in ST.latest_view(spark, f"{base}/log", f"{base}/snap2").collect()) == full


def write_lines(path, records, written):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
    if written:
        os.utime(path, (written, written))


def test_log_without_seq_keeps_its_order_in_the_stream(spark):
    base = scratch(spark, "no-seq")
    write_lines(f"{base}/in/b.jsonl", [{"instance_id": "x", "status": "passed"}, {"instance_id": "y", "status": "passed"}], 1000)
    write_lines(f"{base}/in/a.jsonl", [{"instance_id": "y", "status": "passed"}, {"instance_id": "x", "status": "failed"}, {"instance_id": "y", "status": "error"}], 2000)
    stream = ST.read_progress_stream(spark, f"{base}/in", files_per_trigger=1)
    ST.start_progress_latest(stream, f"{base}/out", f"{base}/ck").awaitTermination()
    got = sorted((r.instance_id, r.status) for r in ST.latest_view(spark, f"{base}/out").collect())
    batch = sorted((r.instance_id, r.status) for r in S.latest_progress(RD.scan_progress(spark, f"{base}/in")).collect())
    assert got == batch == [("x", "failed"), ("y", "error")]


def test_counts_equal_the_latest_outcomes_after_every_wave(spark):
    base = scratch(spark, "counts")
    waves = [[("a", "passed"), ("b", "failed"), ("a", "failed")], [("a", "passed"), ("c", "error"), ("b", "failed")], [("c", "passed"), ("b", "passed")]]
    want = []
    for k, wave in enumerate(waves):
        write_lines(f"{base}/in/{k}.jsonl", [{"instance_id": i, "status": s} for i, s in wave], 1000 + k)
        stream = ST.read_progress_stream(spark, f"{base}/in")
        ST.start_progress_counts(stream, f"{base}/out", f"{base}/ck").awaitTermination()
        last = S.latest_progress(RD.scan_progress(spark, f"{base}/in"))
        want.append(sorted(tuple(r) for r in last.groupBy(S.classify_status(last).alias("o")).count().collect()))
        assert sorted(tuple(r) for r in ST.progress_counts(spark, f"{base}/out").collect()) == want[-1]
    assert [sorted(tuple(r) for r in ST.progress_counts(spark, f"{base}/out", k).collect()) for k in range(3)] == want


def test_tail_reads_lines_as_they_are_appended(spark):
    base = scratch(spark, "tail")
    path = f"{base}/in/log.jsonl"

    def run():
        ST.start_progress_latest(ST.tail_progress_stream(spark, f"{base}/in/*.jsonl"), f"{base}/out", f"{base}/ck").awaitTermination()
        return sorted((r.instance_id, r.status) for r in ST.latest_view(spark, f"{base}/out").collect())

    write_lines(path, [{"instance_id": "x", "status": "failed"}], None)
    with open(path, "a") as f:
        f.write('{"instance_id": "y", "sta')  # a line that is being written
    assert run() == [("x", "failed")]
    with open(path, "a") as f:
        f.write('tus": "error"}\n')
    write_lines(path, [{"instance_id": "x", "status": "passed"}], None)
    assert run() == run() == [("x", "passed"), ("y", "error")]


def test_tail_pieces_give_every_line_once(tmp_path, monkeypatch):
    lines = [f"line {i} " + "é" * (i % 9) for i in range(200)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nhalf")
    for chunk, step in [(1, 3), (7, 5), (50, 64), (10**6, 1)]:
        monkeypatch.setattr(tail, "CHUNK", chunk)
        monkeypatch.setattr(tail, "STEP", step)
        reader = tail.LogTailReader(f"{tmp_path}/*.log")
        pieces = reader.partitions({}, reader.latestOffset())
        assert [r[0] for p in pieces for r in reader.read(p)] == lines


def groups_of(spark, base):
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())


def test_groups_are_emitted_once_and_their_state_expires(spark):
    base = scratch(spark, "groups")

    def wave(rows, **options):
        spark.createDataFrame(rows, ST.SAMPLE_STREAM_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(ST.SAMPLE_STREAM_SCHEMA).json(f"{base}/in")
        q = ST.start_groups(stream, f"{base}/out", f"{base}/ck", **options)
        q.awaitTermination()

    wave([(1, 0, "completed", 5, 2), (2, 4, "completed", 5, 2)], keep_ms=3_600_000)
    wave([(1, 1, "aborted", 5, 2), (2, 5, "completed", 5, 2), (2, 6, "completed", 5, 2)], keep_ms=3_600_000)
    want = [(1, "retry", 2, 0, 1), (2, "batch", 3, 4, 0)]
    assert groups_of(spark, base) == want
    wave([(1, 9, "completed", 5, 2), (2, 9, "aborted", 5, 2), (2, 8, "aborted", 5, 2)], keep_ms=3_600_000)  # late
    assert groups_of(spark, base) == want


def test_state_of_groups_falls_to_nothing(spark):
    import time

    base = scratch(spark, "groups-ttl")
    rows = [(g, i, "completed", 5, 2) for g in range(20) for i in range(1 + g % 2)]

    def wave(rows):
        spark.createDataFrame(rows, ST.SAMPLE_STREAM_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(ST.SAMPLE_STREAM_SCHEMA).json(f"{base}/in")
        q = ST.start_groups(stream, f"{base}/out", f"{base}/ck", keep_ms=1000)
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    assert wave(rows) > 0
    time.sleep(2)
    # a group of one sample leaves only its own mark
    assert wave([(99, 0, "completed", 5, 1)]) < 5
    assert len(groups_of(spark, base)) == 11


def test_collector_stops_at_its_target(spark):
    base = scratch(spark, "collector")
    for k in range(3):
        rows = [(10 * k + g, i, "aborted" if g == 1 else "completed", 5, 2) for g in range(4) for i in range(2)]
        spark.createDataFrame(rows, ST.SAMPLE_STREAM_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(ST.SAMPLE_STREAM_SCHEMA).json(f"{base}/in")
        ST.start_collector(stream, f"{base}/out", f"{base}/ck", target=5).awaitTermination()
    got = {r["group_id"]: r["route"] for r in spark.read.parquet(f"{base}/out/groups").collect()}
    assert [g for g, r in sorted(got.items()) if r == "batch"] == [0, 2, 3, 10, 12]
    assert [g for g, r in sorted(got.items()) if r == "queued"] == [13, 20, 22, 23]
    assert [g for g, r in sorted(got.items()) if r == "retry"] == [1, 11, 21]


def test_watchdog_gap_rule_against_loop_simulation():
    # collector loop at millisecond ticks: warn once more than `timeout` passed
    # since the last completion or warning, then restart the timer
    import random

    rnd = random.Random(5)
    for _ in range(200):
        timeout = rnd.choice([1.0, 2.5, 30.0])
        gap_ms = rnd.randint(0, int(timeout * 1000 * 5))
        mark, warned = 0, 0
        for now in range(1, gap_ms):
            if now - mark > timeout * 1000:
                warned, mark = warned + 1, now
        assert PR.warnings_in_gap(gap_ms / 1000, timeout) == warned, (gap_ms, timeout)


@pytest.mark.parametrize("key", ["stream_progress_counts", "stream_groups", "stream_collector", "stream_watchdog", "stream_step_hook"])
def test_stateful_streams_run_in_a_session_with_the_default_state_store(spark, key):
    provider = "spark.sql.streaming.stateStore.providerClass"
    was, default = spark.conf.get(provider), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(ORACLE[key])
    cols = [d[0] for d in want.description]
    spark.conf.set(provider, default)
    try:
        got = rows(QUERIES[key](spark, SF_SMALL), *cols)
        assert spark.conf.get(provider) == default
    finally:
        spark.conf.set(provider, was)
    want = sorted(want.fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w) if key == "stream_watchdog" else g == w


@pytest.mark.parametrize("key, start, batches", [("stream_groups", "start_groups", 3), ("stream_progress_counts", "start_progress_counts", 4)])
def test_micro_batches_do_not_grow_with_the_files_of_the_input(spark, monkeypatch, key, start, batches):
    started, run = [], getattr(ST, start)
    monkeypatch.setattr(ST, start, lambda *a, **b: started.append(run(*a, **b)) or started[-1])
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    were = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert QUERIES[key](spark, SF_MID).count() > 0
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    ran = [sum(p.numInputRows > 0 for p in q.recentProgress) for q in started]
    assert ran and all(0 < n <= batches for n in ran), ran
