"""Helpers shared by the training-data operators.

* native column helpers (``let``, ``gram_hash``) for the operators that stay
  inside DataFrame expressions;
* per-document numpy helpers (words, 64-bit word hashes, rolling grams) for the
  operators that run inside ``mapInArrow`` tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_path

# ---------------------------------------------------------------- Spark side


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    """``body(expr)`` with ``expr`` evaluated once: it is bound as a lambda
    variable, so no optimizer rule can copy it into a per-element body."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def gram_hash(arr: Column, i: Column, n: int) -> Column:
    """64-bit hash of the ``n`` array elements that start at index ``i``."""
    return F.xxhash64(*[F.get(arr, i + F.lit(j)) for j in range(n)])


def index_range(count: Column) -> Column:
    """``[0, 1, .., count - 1]``; empty for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - F.lit(1))).otherwise(F.array().cast("array<int>"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: lineage
    is cut by files that every executor can reach."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (column
    names are compared as Spark does, whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: ids up to this number are sent to every task, more are shuffled
BROADCAST_IDS = 500_000


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` joined with a table of ``doc_id`` and other columns; the table
    is broadcast only after its rows have been counted."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str, chunk: int = 256) -> DataFrame:
    """``mapInArrow`` over small lists of row tuples.

    ``make()`` runs once per task and returns ``rows -> rows``; both sides see
    at most ``chunk`` input rows at a time, so a task's memory does not grow
    with its partition.
    """
    fields = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = list(zip(*[_values(c) for c in part.columns], strict=True))
                out = work(rows)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a result of bounded size, as numpy arrays (lists as an
    array of arrays); moved as Arrow batches, not as rows."""
    table = df.toArrow().combine_chunks()
    out = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        whole = column.chunk(0) if column.num_chunks else pa.array([], type=column.type)
        if pa.types.is_list(whole.type):
            cells = np.empty(len(whole), dtype=object)
            cells[:] = [np.asarray(c) for c in _values(whole)] if len(whole) else []
            out[name] = cells
        else:
            out[name] = whole.to_numpy(zero_copy_only=False)
    return out


def _values(column: pa.Array) -> list:
    """Python values; lists of numbers as numpy arrays."""
    kind = column.type
    if pa.types.is_list(kind) and pa.types.is_integer(kind.value_type) and column.values.null_count == 0:
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[a:b] if valid else None for a, b, valid in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
    return column.to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], chunk: int = 256) -> DataFrame:
    """``mapInArrow`` over small record batches; the schema stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                yield work(batch.slice(at, chunk))

    return df.mapInArrow(run, df.schema)


# ---------------------------------------------------------------- numpy side

#: [\x20\x09-\x0D], the separators of the shingle and window operators
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 14, 1 << int(n).bit_length())
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the maximal runs of non-separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial over random byte codes, read
    off one prefix sum, then finalized."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * down[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all ``n`` consecutive word hashes (empty if fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n <= 12:
        g = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            g = (g + h[j : j + m]) * np.uint64(_BASE)
            if j & 3 == 3:
                g ^= g >> np.uint64(29)
        return mix64(g)
    up, down = _powers(len(h) + 1)
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * down[: len(h)], out=prefix[1:])
    return mix64((prefix[n:] - prefix[:m]) * up[:m])


def text_words(text: str | None, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, start bytes, end bytes) of a whole text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends), starts, ends
