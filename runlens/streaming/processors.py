"""Stateful processors (``transformWithState``) of the streaming jobs.

State is per key and small: one record of an instance, the samples of one
group, the last completion of a rollout.  Each processor reads its rows one by
one, so a key with many rows in a micro-batch needs no more memory than others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# ── outcome changes per instance ───────────────────────────────────────────

#: what orders an instance's records, and their outcome
RECORD = "seq long, written long, path string, block long, line long, outcome string"


def order_key(record) -> tuple:
    """Comparable form of a record's place in the log; NULLs come first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in tuple(record)[:5])


class OutcomeChanges(StatefulProcessor):
    """For each instance whose newest record changes its outcome: -1 for the
    outcome it had, +1 for the one it has now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", RECORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.newest.get() if self.newest.exists() else None
        best = before
        for r in rows:
            now = (r["seq"], r["written"], r["path"], r["block"], r["line"], r["outcome"])
            if best is None or (order_key(now), now[5]) > (order_key(best), best[5]):
                best = now
        if best is not before:
            self.newest.update(tuple(best))
            if before is None or before[5] != best[5]:
                if before is not None:
                    yield Row(outcome=before[5], delta=-1)
                yield Row(outcome=best[5], delta=1)

    def close(self) -> None:
        pass


def outcome_changes(records: DataFrame) -> DataFrame:
    """``outcome, delta`` from ``instance_id, seq, log_pos, outcome``."""
    place = records.select(
        "instance_id", "seq", F.unix_micros("log_pos.written").alias("written"), F.col("log_pos.path").alias("path"),
        F.col("log_pos.block").alias("block"), F.col("log_pos.line").alias("line"), "outcome")
    return place.groupBy("instance_id").transformWithState(OutcomeChanges(), "outcome string, delta long", "Append", "None")


# ── sample groups ──────────────────────────────────────────────────────────

GROUP = "group_id long, route string, n_samples long, first_index long, n_aborted long"


class GroupCollector(StatefulProcessor):
    """Emits a group once, when its samples reach the expected size, and drops
    them; what is kept then is a mark that ignores late samples.  Samples of a
    group that never completes and the marks expire after ``keep_ms``."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "sample_index long, aborted boolean", self.keep_ms)
        self.emitted = handle.getValueState("emitted", "n long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.emitted.exists():
            return
        new, size = [], None
        for r in rows:
            new.append((r["sample_index"], r["status"] == "aborted"))
            size = r["group_size"] if size is None else max(size, r["group_size"])
        seen = list(self.samples.get()) + new if self.samples.exists() else new
        if size is not None and len(seen) >= size:
            self.samples.clear()
            self.emitted.update((len(seen),))
            aborted = sum(1 for _, a in seen if a)
            yield Row(group_id=key[0], route="retry" if aborted else "batch", n_samples=len(seen),
                      first_index=min(i for i, _ in seen), n_aborted=aborted)
        elif new:
            self.samples.appendList(new)

    def close(self) -> None:
        pass


def complete_groups(samples: DataFrame, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``samples``: ``group_id, sample_index, status, group_size``."""
    return samples.groupBy("group_id").transformWithState(GroupCollector(keep_ms), GROUP, "Append", "ProcessingTime")


# ── watchdog ───────────────────────────────────────────────────────────────

WARNING = "rollout_id long, event_id long, gap_seconds double, warnings long"


def warnings_in_gap(gap: float, timeout: float) -> int:
    """Warnings logged while waiting ``gap`` seconds: one each time more than
    ``timeout`` seconds passed since the last progress or warning."""
    return max(int(math.ceil(gap / timeout)) - 1, 0) if gap > 0 else 0


class Watchdog(StatefulProcessor):
    """Per rollout: the last completion, and in live form a processing-time
    timer that is moved by every completion and re-armed by every warning."""

    def __init__(self, timeout: float, live: bool) -> None:
        self.timeout, self.live = timeout, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts double")

    def _arm(self, timer_values) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(self.timeout * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        # a micro-batch's completions of one rollout may come in any order
        for ts, event in sorted((r["ts_seconds"], r["event_id"]) for r in rows):
            n = warnings_in_gap(ts - last, self.timeout) if last is not None else 0
            if n:
                yield Row(rollout_id=key[0], event_id=event, gap_seconds=ts - last, warnings=n)
            last = ts
        if last is not None:
            self.last.update((last,))
        if self.live:
            self._arm(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._arm(timerValues)
        yield Row(rollout_id=key[0], event_id=None, gap_seconds=None, warnings=1)

    def close(self) -> None:
        pass
