"""Step hooks on streams and tables: the same rows, whatever order steps come in."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators import hooks as H
from runlens.streaming.step_order import StepBuckets, StepOrder, Values, stream_step_hooks

from .conftest import scratch

STEP = "run_id string, step long, tool string, ts timestamp"


def seen(memo, step):
    memo = (memo or []) + [step["tool"]]
    return memo, None if step["tool"] == "skip" else {"path": ">".join(memo)}


def run_stream(spark, waves, **options):
    base = scratch(spark, "steps")
    for k, wave in enumerate(waves):
        df = spark.createDataFrame([(r, s, t, ts) for r, s, t, ts in wave], "run_id string, step long, tool string, at long")
        df.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).drop("at").coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(STEP).json(f"{base}/in")
        (stream_step_hooks(stream, seen, "path string", **options).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination())
    return sorted((r.run_id or "", r.step, r.path) for r in spark.read.parquet(f"{base}/out").collect())


def test_shuffled_stream_equals_table(spark):
    steps = [(f"r{i % 5}", i // 5, ["bash", "edit", "skip"][i * 7 % 3], i // 5) for i in range(60)]
    mixed = steps + steps[::9]  # some steps come twice
    random.Random(3).shuffle(mixed)
    got = run_stream(spark, [mixed[k::3] for k in range(3)])
    table = spark.createDataFrame(steps, "run_id string, step long, tool string, at long").drop("at")
    want = H.run_step_hooks(table, H.fold_hook(seen, ["path"]), "run_id string, step long, path string")
    assert got == sorted((r.run_id, r.step, r.path) for r in want.collect())


def test_silent_run_is_closed_over_its_gap_and_steps_without_run_do_not_wait(spark):
    waves = [[("a", 0, "x", 0), ("a", 2, "z", 2), (None, 9, "n", 0), (None, 9, "m", 0)], [("b", 0, "y", 9000)], [("b", 1, "w", 9001)]]
    got = run_stream(spark, waves, keep_seconds=60)
    assert got == [("", 9, "m"), ("", 9, "n"), ("a", 0, "x"), ("a", 2, "x>z"), ("b", 0, "y"), ("b", 1, "y>w")]


def test_runs_over_many_batches_and_single_steps_without_run(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [(k, s) for k, n in (("a", 23), ("b", 1), ("c", 8), ("d", 4)) for s in range(n)] + [(None, s) for s in range(11)]
        df = spark.createDataFrame(rows, "run_id string, step int").repartition(3)

        def hook(pdf: pd.DataFrame) -> pd.DataFrame:
            assert pdf["step"].is_monotonic_increasing or pdf["run_id"].nunique() > 1
            return pdf.assign(n=pdf.groupby("run_id", dropna=False)["step"].transform("size"))

        sizes = {"a": 23, "b": 1, "c": 8, "d": 4}
        for per_run in (True, False):
            for unnamed, n in (("run", 11), ("step", 1)):
                out = H.run_step_hooks(df, hook, "run_id string, step int, n int", per_run=per_run, unnamed=unnamed)
                assert sorted((r.run_id or "", r.step, r.n) for r in out.collect()) == sorted((k or "", s, sizes.get(k, n)) for k, s in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_waiting_steps_reach_the_callback_as_they_came(spark):
    base, t0 = scratch(spark, "steps"), dt.datetime(2026, 1, 2, 3, 4, 5, 678901)
    schema = "run_id string, step long, tags array<string>, size decimal(9,2), ts timestamp"
    rows = [("a", s, ["x", None] * s, Decimal(s) / 4, t0 + dt.timedelta(seconds=s)) for s in range(4)]

    def told(memo, step):
        return None, {"all": repr((step["tags"], step["size"], step["ts"].timestamp()))}

    for wave in (rows[2:], rows[:2]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        (stream_step_hooks(spark.readStream.schema(schema).parquet(f"{base}/in"), told, "all string").writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination())
    got = {r.step: r["all"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {s: repr((tags, Decimal(size).quantize(Decimal("0.01")), ts.timestamp())) for _, s, tags, size, ts in rows}


class Handle:
    """Counts the calls on one run's state and timers."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    put = update

    def clear(self):
        self.update(None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_a_run_costs_two_state_calls_per_batch_and_one_timer():
    columns, handle = T.StructType().add("step", "long").add("tool", "string"), Handle()
    order = StepOrder(seen, ("run_id", "step", "millis"), columns, ["path"], 0, 1000)
    order.init(handle)

    def batch(*steps):
        before = handle.calls
        out = list(order.handleInputRows(("a",), iter([{"step": s, "tool": str(s), "millis": 100 * s} for s in steps]), Times(0)))
        return [r.path for r in out], handle.calls - before

    def expire(watermark):
        fired = [t for t in handle.timers if t < watermark]
        out = [r.path for t in fired for r in order.handleExpiredTimer(("a",), Times(watermark), None)]
        handle.timers.difference_update(fired)
        return out

    assert batch(2, 5) == ([], 3)
    assert batch(1) == ([], 2)
    assert batch(0, 7) == (["0", "0>1", "0>1>2"], 2)
    assert handle.timers == {1500}
    assert expire(1600) == [] and handle.timers == {1700}
    assert expire(1700) == [] and handle.timers == {1700}
    assert expire(1701) == ["0>1>2>5", "0>1>2>5>7"] and not handle.timers and handle.value is None


def test_many_runs_are_few_states(spark):
    base = scratch(spark, "steps")
    steps = spark.range(600).selectExpr("id % 200 AS run_id", "id DIV 200 AS step", "'x' AS tool", "timestamp_seconds(1700000000 + id) AS ts")
    for wave in ("step > 0", "step = 0"):
        steps.where(wave).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema("run_id long, step long, tool string, ts timestamp").json(f"{base}/in")
        q = (stream_step_hooks(stream, seen, "path string", buckets=8).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p.stateOperators) <= 8
    got = {(r.run_id, r.step, r.path) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(i, s, ">".join("x" * (s + 1))) for i in range(200) for s in range(3)}


class Bucket:
    """The state of a bucket and its timer."""

    hasTimedOut, get, due, watermark = False, None, None, 0  # noqa: N815
    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = self.due = None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at >= max(self.watermark, 1)
        self.due = at


def test_a_bucket_gives_what_a_state_per_run_gives():
    rnd, keep, kinds = random.Random(7), 500, [T.LongType(), T.StringType()]
    columns = T.StructType().add("step", "long").add("tool", "string")
    for case in range(60):
        handles, bucket, watermark = {}, Bucket(), 0
        buckets = StepBuckets(seen, columns.names, "step", Values(T.StringType(), "UTC"), [Values(k, "UTC") for k in kinds],
                              ["run_id", "step", "path"], 0, keep)
        for _ in range(12):
            rows = [(rnd.choice("abcde") if rnd.random() < 0.95 else None, None if rnd.random() < 0.05 else rnd.randint(-1, 6),
                     rnd.choice(["x", "y", "skip"]), watermark + rnd.randint(1, 400)) for _ in range(rnd.choice([0, 1, 5, 20]))]
            want = []
            for run in dict.fromkeys(r[0] for r in rows):
                order = StepOrder(seen, ("run_id", "step", "millis"), columns, ["path"], 0, keep)
                order.init(handles.setdefault(run, Handle()))
                given = [{"step": s, "tool": t, "millis": m} for r, s, t, m in rows if r == run]
                want += order.handleInputRows((run,), iter(given), Times(watermark))
            for run, handle in handles.items():
                fired = [t for t in handle.timers if t < watermark]
                handle.timers.difference_update(fired)
                order = StepOrder(seen, ("run_id", "step", "millis"), columns, ["path"], 0, keep)
                order.init(handle)
                want += [r for _ in fired for r in order.handleExpiredTimer((run,), Times(watermark), None)]
            frame = pd.DataFrame({"run": pd.Series([r[0] for r in rows], dtype=object), "millis": pd.Series([r[3] for r in rows], dtype="int64"),
                                  "c0": pd.Series([r[1] or 0 for r in rows], dtype="int64"),
                                  "c0_null": pd.Series([r[1] is None for r in rows], dtype=bool), "c1": pd.Series([r[2] for r in rows], dtype=object)})
            bucket.watermark, got = watermark, []
            bucket.hasTimedOut = not rows and bucket.due is not None and bucket.due < watermark
            if rows or bucket.hasTimedOut:
                bucket.due = None
                for found in buckets.handle((0,), iter([frame[:3], frame[3:]]), bucket):
                    got += found.itertuples(index=False, name=None)
            tell = lambda out: sorted(out, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2]))
            assert tell(got) == tell([(r.run_id, r.step, r.path) for r in want]), case
            watermark += rnd.choice([0, 100, 500, 900])


def test_steps_of_any_type_reach_the_callback_unchanged(spark):
    base = scratch(spark, "steps")
    schema = ("run_id int, step int, a long, b boolean, c float, d double, e date, f binary, g timestamp, h array<long>, "
              "i struct<x: int, y: string>, j decimal(20,3), k string, ts timestamp")
    at, utc = dt.datetime(2026, 1, 2, 3, 4, 5, 678901, tzinfo=dt.timezone.utc), dt.timezone.utc
    full = (2**53 + 1, True, 0.1, 1e300, dt.date(2026, 1, 2), b"\x00\xff", dt.datetime(4000, 1, 1, tzinfo=utc), [2**60 + 1, None], (1, None), Decimal("12345678901234567.125"), "")
    none = (None,) * len(full)
    rows = [(1, 0, *full, at), (1, 1, *none, at), (1, 2, *full, at), (1, 4, *full, dt.datetime(9000, 1, 1, tzinfo=utc)),
            (None, 7, *full, at), (None, None, *none, at), (2, 0, *full, None)]
    names = [x.split()[0] for x in schema.split(", ") if ":" not in x] + ["i"]

    def told(memo, step):
        assert set(step) == set(names) - {"run_id"}
        return None, {"all": repr([step[c] if c != "g" or step[c] is None else step[c].timestamp() for c in "abcdefghijk"]), "n": step["a"]}

    for wave in (rows[1:], rows[:1]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        (stream_step_hooks(spark.readStream.schema(schema).parquet(f"{base}/in"), told, "all string, n long", keep_seconds=10**11)
         .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
         .trigger(availableNow=True).start().awaitTermination())
    got = {(r.run_id, r.step): (r["all"], r.n) for r in spark.read.parquet(f"{base}/out").collect()}
    whole = [*full[:2], 0.10000000149011612, *full[3:6], full[6].timestamp(), full[7], {"x": 1, "y": None}, *full[9:]]
    want = {True: (repr(whole), full[0]), False: (repr([None] * len(full)), None)}
    assert got == {(1, 0): want[True], (1, 1): want[False], (1, 2): want[True], (None, 7): want[True], (None, None): want[False]}
