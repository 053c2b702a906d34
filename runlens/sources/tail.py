"""A streaming source for logs that writers append to in place.

Spark's file stream reads each file once, when it appears; lines appended later
are not seen.  This Python Data Source keeps a byte offset per file instead and
gives every complete line with its place in the log.  The files must be on a
file system that the driver and the executors mount under the same path; for
stores that only Spark reads, and for logs written as new files, use
``streams.read_progress_stream``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: bytes of one partition, and of one step back from a file's end
CHUNK, STEP = 32 << 20, 1 << 16


class Piece(InputPartition):
    """The lines of a file that start in [start, end); ``written`` in
    microseconds when the offset was taken."""

    def __init__(self, path: str, start: int, end: int, written: int) -> None:
        self.path, self.start, self.end, self.written = path, start, end, written


def complete_bytes(path: str, known: int) -> int:
    """The file's length up to its last line end, ``known`` if it has none after it."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > known:
            step = min(STEP, at - known)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return known


class LogTailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern, self.known = pattern, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for path in sorted(glob.glob(self.pattern)):
            stat = os.stat(path)
            end = complete_bytes(path, self.known.get(path, [0])[0])
            if end > self.known.get(path, [0])[0]:
                self.known[path] = [end, stat.st_mtime_ns // 1000]
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = {**end}
        out = []
        for path, (stop, written) in sorted(end.items()):
            first = start.get(path, [0])[0]
            out += [Piece(path, at, min(at + CHUNK, stop), written) for at in range(first, stop, CHUNK)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that starts before
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.written, partition.path, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, written long, path string, at long"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(self.options["path"])


def tail_lines(spark: SparkSession, pattern: str):
    """A stream of complete lines ``value`` with ``log_pos`` (when and where
    they were read); ``pattern`` is a glob of files that grow."""
    from pyspark.sql import functions as F

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", pattern).load()
    place = F.struct(F.timestamp_micros("written").alias("written"), "path", F.col("at").alias("block"), F.lit(0).cast("bigint").alias("line"))
    return lines.select("value", place.alias("log_pos"))
