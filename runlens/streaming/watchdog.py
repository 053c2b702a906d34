"""Collector watchdog: warn when no group completed for ``timeout`` seconds,
then restart the timer.

Two forms:

* ``watchdog_stream`` -- stateful per rollout over a stream of completion
  events (event time): for each gap of ``g`` seconds between consecutive
  completions it reports the ``ceil(g / timeout) - 1`` warnings the
  collector loop would have logged while waiting; with ``live=True`` the
  same processor also keeps a processing-time timer per rollout.
* ``WatchdogListener`` -- live, on the driver, fed only by streaming
  progress metrics (rows per micro-batch), never by data.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from runlens.streaming.processors import WARNING, Watchdog

log = logging.getLogger(__name__)

# Fixed value of the reference: seconds without a completed group.
NO_PROGRESS_TIMEOUT = 30.0


def epoch_micros(dtype: T.DataType, ts):
    """Microseconds since the epoch; a wall-clock (NTZ) timestamp is read as
    UTC without passing through the session time zone."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def watchdog_stream(completions: DataFrame, timeout: float = NO_PROGRESS_TIMEOUT, live: bool = False) -> DataFrame:
    """``completions``: ``rollout_id, event_id, ts_seconds`` whose micro-batches
    follow each other in time per rollout.  State: one time per rollout.

    Event time: each gap between consecutive completions, within a micro-batch
    or across them, reports the warnings the collector would have logged.
    ``live=True`` also registers a processing-time timer per rollout: when no
    completion arrives for ``timeout`` seconds of wall-clock time, one
    warning row (no ``event_id``) is emitted and the timer restarts.  Live
    mode is for continuous (processing-time) triggers."""
    return completions.groupBy("rollout_id").transformWithState(
        Watchdog(timeout, live), WARNING, "Append", "ProcessingTime" if live else "None")


class WatchdogListener(StreamingQueryListener):
    """Logs a warning when a query's micro-batches brought no rows for
    ``timeout`` seconds of wall-clock time, then restarts the timer."""

    def __init__(self, timeout: float = NO_PROGRESS_TIMEOUT, clock=time.monotonic):
        self.timeout = timeout
        self.clock = clock
        self.last_progress: dict[str, float] = {}
        self.warnings: list[tuple[str, float]] = []

    def onQueryStarted(self, event):  # noqa: N802
        self.last_progress[str(event.id)] = self.clock()

    def onQueryProgress(self, event):  # noqa: N802
        qid = str(event.progress.id)
        now = self.clock()
        if event.progress.numInputRows > 0:
            self.last_progress[qid] = now
        elif now - self.last_progress.get(qid, now) > self.timeout:
            log.warning("No progress for %.0fs in query %s", self.timeout, qid)
            self.warnings.append((qid, now))
            self.last_progress[qid] = now

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.last_progress.pop(str(event.id), None)
