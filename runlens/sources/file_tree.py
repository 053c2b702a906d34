"""Rows as files: ``(path, content)`` written under exact names, the inverse
of the ``binaryFile`` readers of task folders.

Spark's own writers choose their file names; task folders need theirs
(``task.toml``, ``instruction.md``, ``tests/..``).  Tasks write each file under
a temporary name in its folder and rename it, so a reader never sees half a file and a retried or
speculative task leaves the same tree.  ``root`` must be mounted under one
path by all executors.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _target(root: str, path: str) -> str:
    """The file below ``root``; a path that leaves it is an error."""
    target = os.path.normpath(os.path.join(root, path.lstrip("/")))
    if not target.startswith(root + os.sep):
        raise ValueError(f"path leaves the folder: {path!r}")
    return target


def write_file_tree(files: DataFrame, root: str) -> int:
    """Write ``files(path string, content binary)`` below ``root`` and return
    the number of files.

    Of rows with one path the smallest content is written, so the tree does not
    depend on task order.  Rows without path or content are left out, empty
    contents give empty files, other columns are ignored; an empty table
    writes nothing."""
    base = os.path.normpath(root.removeprefix("file:"))
    rows = (files.select("path", F.col("content").cast("binary").alias("content"))
            .where("path IS NOT NULL AND content IS NOT NULL").groupBy("path").agg(F.min("content").alias("content")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = _target(base, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                # a leading dot: Spark's readers leave such names out
                part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return rows.mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
