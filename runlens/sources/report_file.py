"""One JSON document of any size, written from sorted rows.

``json_document`` is a data source for writing.  Spark sorts the document's
tokens; every task writes its own part file, and the commit joins the parts
that were committed, in partition order, into one file.  Bytes are copied in
pieces of fixed size, so neither a task nor the driver holds the document.

Each attempt of a task writes a file of its own, and the document appears by
one rename: a lost executor, a speculative task or a repeated job leaves no
other bytes in it.  Paths are those that ``pyarrow.fs`` opens (``/path``,
``file:``, ``hdfs:``, ``s3:``, ``gs:``) on the driver and the executors.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: kinds of tokens: a list's start, its items, its end, and a field of its own
OPEN, ITEM, CLOSE, FIELD = range(4)
#: columns of the rows, which come sorted by the first three
TOKENS = "place int, kind int, value string, name string"
COPY_BYTES = 8 << 20


def separator(before: int | None, now: int) -> str:
    """What stands between two tokens (``None``: the document's start)."""
    if now == ITEM:
        return "\n    " if before == OPEN else ",\n    "
    if now == CLOSE:
        return "" if before == OPEN else "\n  "
    return "\n  " if before is None else ",\n  "


def token(kind: int, value: str | None, name: str | None) -> str:
    """Items are JSON strings (null without a value); the value of a field is
    JSON already."""
    if kind == ITEM:
        return json.dumps(value)
    if kind == CLOSE:
        return "]"
    return f"{json.dumps(name)}: " + ("[" if kind == OPEN else value)


def location(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Part(WriterCommitMessage):
    """A written part: its place, file and outer tokens' kinds."""

    partition: int
    file: str
    first: int | None
    last: int | None


class JsonDocumentWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        file = f"{self.parts}/{uuid.uuid4().hex}"
        files, where = location(file)
        files.create_dir(where.rsplit("/", 1)[0])
        first = last = None
        with files.open_output_stream(where, buffer_size=1 << 20) as out:
            for row in iterator:
                text = token(row["kind"], row["value"], row["name"])
                if first is None:
                    first = row["kind"]  # the commit knows what stands before it
                else:
                    text = separator(last, row["kind"]) + text
                last = row["kind"]
                out.write(text.encode("ascii"))
        return Part(TaskContext.get().partitionId(), file, first, last)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, target = location(self.path)
        ready = f"{location(self.parts)[1]}/document"
        files.create_dir(ready.rsplit("/", 1)[0])
        before = None
        with files.open_output_stream(ready, buffer_size=1 << 20) as out:
            out.write(b"{")
            for part in sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.partition):
                out.write(separator(before, part.first).encode("ascii"))
                with files.open_input_stream(location(part.file)[1]) as source:
                    while piece := source.read(COPY_BYTES):
                        out.write(piece)
                before = part.last
            out.write(b"}" if before is None else b"\n}")
        files.move(ready, target)
        files.delete_dir(location(self.parts)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, where = location(self.parts)
        if files.get_file_info(where).type == fs.FileType.Directory:
            files.delete_dir(where)


class JsonDocumentSource(DataSource):
    """``df.write.format("json_document").mode("overwrite").save(file)``."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return TOKENS

    def writer(self, schema: StructType, overwrite: bool) -> JsonDocumentWriter:
        if not overwrite:
            raise ValueError("a document is written whole: use mode('overwrite')")
        return JsonDocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonDocumentSource)
