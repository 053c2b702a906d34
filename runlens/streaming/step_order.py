"""Per-step callbacks on a stream whose steps come in any order.

Steps of a run wait in the state until those before them have come; then the
callback sees them one by one, in step order, with what it remembered of the
run.  The state of a run is its next step, the callback's memo and the steps
that wait.  A run that has been silent for ``keep`` of event time is closed:
what still waits is released in step order, over its gaps, and its state goes.

``StepBuckets`` keeps the runs of a bucket as one state and puts their steps in
order with array operations; ``StepOrder`` keeps a state for each run.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from itertools import compress
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from runlens.operators.hooks import StepFold


class StepOrder(StatefulProcessor):
    def __init__(self, fold: StepFold, names: tuple[str, str, str], columns: T.StructType, out: list[str],
                 first: int, keep_ms: int) -> None:
        self.fold, self.columns, self.out, self.first, self.keep_ms = fold, columns, out, first, keep_ms
        self.run, self.step, self.millis = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # every call on the state is a round trip to the JVM: all of a run is one value, its waiting steps included
        run = T.StructType().add("next", "long").add("memo", "string").add("due", "long")
        self.run_state = handle.getValueState("run", run.add("waiting", T.ArrayType(self.columns)))

    def _call(self, run: Any, memo: Any, step: dict[str, Any]) -> tuple[Any, list[Row]]:
        memo, found = self.fold(memo, step)
        if found is None:
            return memo, []
        return memo, [Row(**{self.run: run, self.step: step[self.step], **{c: found.get(c) for c in self.out}})]

    def _named(self, values) -> dict[str, Any]:
        return dict(zip(self.columns.names, values, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        run = key[0]
        if run is None:
            for r in rows:
                yield from self._call(None, None, self._named([r[c] for c in self.columns.names]))[1]
            return
        state = self.run_state.get()
        at, text, newest, waiting = state or (self.first, "null", 0, [])
        memo = json.loads(text)
        # a run has few steps (max_steps); one read and one write of the state for all rows of a micro-batch
        steps = {w[self.step]: w for w in map(self._named, waiting)}
        for r in rows:
            newest = max(r[self.millis] + self.keep_ms, newest)
            if r[self.step] is not None and r[self.step] >= at:
                steps.setdefault(r[self.step], self._named([r[c] for c in self.columns.names]))
        while at in steps:
            memo, found = self._call(run, memo, steps.pop(at))
            yield from found
            at += 1
        self.run_state.update((at, json.dumps(memo), newest, [tuple(w[c] for c in self.columns.names) for w in steps.values()]))
        if state is None:
            self.handle.registerTimer(newest)  # the one timer of a run; it is moved when it expires

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, text, due, waiting = self.run_state.get()
        if due >= timerValues.getCurrentWatermarkInMs():  # the run has had steps since
            self.handle.registerTimer(due)
            return
        memo = json.loads(text)
        for step in sorted(map(self._named, waiting), key=lambda w: w[self.step]):
            memo, found = self._call(key[0], memo, step)
            yield from found
        self.run_state.clear()

    def close(self) -> None:
        pass


class Values:
    """How a column's values go to Python in a frame, are kept as Arrow arrays
    and come to the callback, without a change: pandas has no NULL for numbers
    and fewer years for times.  What is neither a number, text nor a time goes
    as the pickled Python value, times come back in the session's zone."""

    def __init__(self, kind: T.DataType, zone: str) -> None:
        self.kind, self.zone = kind, zone
        self.time = isinstance(kind, T.TimestampType)
        self.text = isinstance(kind, T.StringType)
        self.number = self.time or isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType))
        self.type = pa.int64() if self.time else to_arrow_type(kind) if self.number else pa.large_string() if self.text else pa.large_binary()

    def sent(self, value: Column, name: str) -> list[Column]:
        if self.number:
            plain, zero = (F.unix_micros(value), F.lit(0).cast("long")) if self.time else (value, F.lit(0).cast(self.kind))
            return [F.coalesce(plain, zero).alias(name), value.isNull().alias(f"{name}_null")]
        if self.text:
            return [value.alias(name)]

        def pickled(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else pickle.dumps(v, 5) for v in values.to_pylist()], pa.binary())

        return [F.arrow_udf(pickled, T.BinaryType())(value).alias(name)]

    def array(self, frame: pd.DataFrame, name: str) -> pa.Array:
        if self.number:
            return pa.array(frame[name].to_numpy(), self.type, mask=frame[f"{name}_null"].to_numpy())
        return pa.array(frame[name].to_numpy(), self.type, from_pandas=True)

    def values(self, array: pa.Array) -> list:
        if not self.number:
            found = array.to_numpy(zero_copy_only=False).tolist()
            return found if self.text else [None if v is None else pickle.loads(v) for v in found]
        found = (array.fill_null(False if self.type == pa.bool_() else 0) if array.null_count else array).to_numpy(zero_copy_only=False).tolist()
        if self.time:
            times = pd.DatetimeIndex(np.array(found, "int64").view("datetime64[us]")).tz_localize("UTC")
            found = times.tz_convert(self.zone).to_pydatetime().tolist()
        if array.null_count:
            for i in np.flatnonzero(array.is_null().to_numpy(zero_copy_only=False)).tolist():
                found[i] = None
        return found


def _pack(arrays: list[pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays(arrays, [str(i) for i in range(len(arrays))]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> list[pa.Array]:
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_next_batch().columns


class StepBuckets:
    """The runs of a bucket: their ids, next steps, memos and when they are due
    to be closed, and the steps that wait.  A micro-batch reads and writes the
    state once per bucket, however many runs have steps in it."""

    STATE = "runs binary, waiting binary"

    def __init__(self, fold: StepFold, names: list[str], step: str, run_values: Values, values: list[Values],
                 out: list[str], first: int, keep_ms: int) -> None:
        self.fold, self.names, self.out, self.first, self.keep_ms = fold, names, out, first, keep_ms
        self.at_step, self.run_values, self.of = names.index(step), run_values, values

    def _calls(self, ids: pa.Array, memos: list[str], code: np.ndarray, body: list[pa.Array]) -> pd.DataFrame:
        """What the callback gives for steps that are in order; ``code`` has the place of each one's run in ``ids`` and ``memos``."""
        fold, names, told = self.fold, self.names, np.ones(len(code), bool)
        found_columns = [[] for _ in self.out[2:]]
        puts = [(c, v.append) for c, v in zip(self.out[2:], found_columns, strict=True)]
        columns = [v.values(a) for v, a in zip(self.of, body, strict=True)]
        last, memo = None, None
        for i, (run, row) in enumerate(zip(code.tolist(), zip(*columns, strict=True), strict=True)):
            if run != last:
                if last is not None:
                    memos[last] = json.dumps(memo)
                last, memo = run, None if memos[run] == "null" else json.loads(memos[run])
            memo, found = fold(memo, dict(zip(names, row, strict=True)))
            if found is None:
                told[i] = False
            else:
                for name, put in puts:
                    put(found.get(name))
        if last is not None:
            memos[last] = json.dumps(memo)
        runs, steps = self.run_values.values(ids.take(pa.array(code[told]))), list(compress(columns[self.at_step], told.tolist()))
        values = [runs, steps, *found_columns]
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.out, values, strict=True)})

    def _alone(self, body: list[pa.Array]) -> pd.DataFrame:
        n = len(body[self.at_step])
        return self._calls(pa.nulls(n, self.run_values.type), ["null"] * n, np.arange(n), body)

    def handle(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            (ids, at, due, memos), (of_run, *body) = map(_unpack, state.get)
            at, due, of_run = (a.to_numpy() for a in (at, due, of_run))
        else:
            ids, memos, of_run = pa.array([], self.run_values.type), pa.array([], pa.large_string()), np.array([], "int32")
            at, due, body = np.array([], "int64"), np.array([], "int64"), [pa.array([], v.type) for v in self.of]
        memos = memos.to_numpy(zero_copy_only=False).tolist()

        new_ids, new_due, parts = [], [], [body]
        for frame in () if state.hasTimedOut else frames:
            run, rows = self.run_values.array(frame, "run"), [v.array(frame, f"c{i}") for i, v in enumerate(self.of)]
            alone = run.is_null()
            if run.null_count:  # steps without run id never wait
                yield self._alone([a.filter(alone) for a in rows])
                run, rows = run.drop_null(), [a.filter(pc.invert(alone)) for a in rows]
            new_ids.append(run)
            new_due.append(frame["millis"].to_numpy()[~alone.to_numpy(zero_copy_only=False)] + self.keep_ms)
            parts.append(rows)

        # a run's code is its place in ids; those of the state keep theirs
        known = pa.concat_arrays([ids, *new_ids]).dictionary_encode()
        code, n = known.indices.to_numpy()[len(ids):], len(known.dictionary)
        ids, more = known.dictionary, n - len(memos)
        memos += ["null"] * more
        at, due = np.append(at, np.full(more, self.first)), np.append(due, np.zeros(more, "int64"))
        np.maximum.at(due, code, np.concatenate([due[:0], *new_due]))
        body, code = [pa.concat_arrays(p) for p in zip(*parts, strict=True)], np.append(of_run, code)

        # in the order of run and step; of a step that came twice, the first
        step = body[self.at_step]
        wanted = ~step.is_null().to_numpy(zero_copy_only=False)
        step = step.fill_null(0).to_numpy()
        rows = np.flatnonzero(wanted & (step >= at[code]))
        rows = rows[np.lexsort((step[rows], code[rows]))]
        code, step = code[rows], step[rows]
        new_run = np.append(True, code[1:] != code[:-1])[: len(rows)]
        once = new_run | np.append(True, step[1:] != step[:-1])[: len(rows)]
        rows, code, step, new_run = rows[once], code[once], step[once], new_run[once]
        place = np.arange(len(rows))
        place -= np.maximum.accumulate(np.where(new_run, place, 0))
        ready = step - place == at[code]  # none before it is missing
        at += np.bincount(code[ready], minlength=n)
        watermark = state.getCurrentWatermarkMs()
        closed = due < watermark
        ready |= closed[code]
        if ready.any():
            yield self._calls(ids, memos, code[ready], [a.take(pa.array(rows[ready])) for a in body])

        kept = np.flatnonzero(~closed)
        if not len(kept):
            if state.exists:
                state.remove()
            return
        moved = (np.cumsum(~closed) - 1).astype("int32")
        state.update((
            _pack([ids.take(pa.array(kept)), pa.array(at[kept]), pa.array(due[kept]), pa.array([memos[i] for i in kept.tolist()], pa.large_string())]),
            _pack([pa.array(moved[code[~ready]]), *(a.take(pa.array(rows[~ready])) for a in body)])))
        state.setTimeoutTimestamp(max(int(due[kept].min()), watermark, 1))


#: the times that pandas can hold: those beyond count as these for the watermark
FIRST_TIME, LAST_TIME = "TIMESTAMP '1678-01-01 00:00:00'", "TIMESTAMP '2262-01-01 00:00:00'"


def stream_step_hooks(steps: DataFrame, fold: StepFold, schema: str, run: str = "run_id", step: str = "step",
                      ts: str = "ts", first: int = 0, keep_seconds: int = 3600, buckets: int = 1024) -> DataFrame:
    """``run, step`` and the columns of ``schema`` that ``fold(memo, step)``
    gives, as ``run_step_hooks(steps, fold_hook(fold, ..), ..)`` does on a table.

    ``first`` is the number of a run's first step, ``ts`` the event time;
    steps later than ``keep_seconds`` behind the newest, or without a time, are
    dropped, as by any watermark.  A repeated step counts once, the first one to
    come; a step without a number is left out; a step without run id is a run of
    its own and never waits.  Steps that come after their run was closed wait
    until it is closed again and begin with an empty memo.

    Runs are dealt to ``buckets``, each one state: a task needs memory for the open
    runs of a bucket, so take more for more runs, but never another number for the
    same checkpoint.  With ``buckets=0`` each run is a state of its own, which suits
    few steps for many open runs."""
    kept = steps.where(F.col(ts).isNotNull()).withColumn(step, F.col(step).cast("long"))
    columns = T.StructType([f for f in kept.schema.fields if f.name != run])
    extra = T.DataType.fromDDL(schema)
    out = T.StructType([steps.schema[run], T.StructField(step, T.LongType()), *extra.fields])
    alone = F.xxhash64(*columns.names)
    if not buckets:
        salt, millis = "run_part", "event_millis"
        while {salt.lower(), millis.lower()} & {c.lower() for c in steps.columns}:
            salt, millis = salt + "_", millis + "_"
        keyed = kept.withWatermark(ts, f"{keep_seconds} seconds").withColumn(salt, F.when(F.col(run).isNull(), alone).otherwise(F.lit(0)))
        keyed = keyed.withColumn(millis, F.unix_millis(ts))
        order = StepOrder(fold, (run, step, millis), columns, extra.names, first, keep_seconds * 1000)
        return keyed.groupBy(run, salt).transformWithState(order, out, "Append", "EventTime")
    zone = steps.sparkSession.conf.get("spark.sql.session.timeZone")
    run_values, values = Values(steps.schema[run].dataType, zone), [Values(f.dataType, zone) for f in columns.fields]
    sent = kept.select(
        F.pmod(F.when(F.col(run).isNull(), alone).otherwise(F.xxhash64(run)), F.lit(buckets)).cast("int").alias("bucket"),
        F.greatest(F.least(F.col(ts), F.expr(LAST_TIME)), F.expr(FIRST_TIME)).alias("event"), F.unix_millis(ts).alias("millis"),
        *run_values.sent(F.col(run), "run"), *[c for i, v in enumerate(values) for c in v.sent(F.col(columns.names[i]), f"c{i}")])
    order = StepBuckets(fold, columns.names, step, run_values, values, out.names, first, keep_seconds * 1000)
    return sent.withWatermark("event", f"{keep_seconds} seconds").groupBy("bucket").applyInPandasWithState(
        order.handle, out, StepBuckets.STATE, "append", "EventTimeTimeout")
