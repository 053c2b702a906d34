"""Embedding whitening by a bidiagonal qd solver.

Entries are quantised to whole numbers, so counts, sums and centred rows
z = n * x - S are exact; only z / n is rounded.  The covariance is never formed:

1. every task reduces its centred rows block by block to one triangle (QR of
   the triangle so far and the next block); triangles are combined a few at a
   time until one is left;
2. that triangle of the vectors' dimension, the only thing the driver sees, is
   brought to an upper bidiagonal by Householder reflections;
3. dqds finds its singular values to high relative accuracy;
4. twisted factorisations of B'B - s*s give the bidiagonal's right vectors, and
   the reflections take them back to whitening directions.

Memory per task is one block of rows and two triangles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import shared_table

#: steps of an entry's unit, and what is added
STEPS, OFFSET = 64, 1_000_000
#: entries of this size or more count as not finite: their steps are no whole
#: numbers of double precision
LARGEST = float(1 << 40)
COMPONENTS = 32
#: rows of one block; triangles that one task combines
BLOCK, FAN_IN = 2048, 16
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------ the small solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: ``r = U B V'``; returns the diagonal and superdiagonal of B
    (made non-negative, the signs are in V) and V."""
    a, d = np.array(r, dtype=float), r.shape[1]
    v = np.eye(d)
    for k in range(d):
        x = a[k:, k].copy()
        _reflect(x, a[k:, k:])
        if k + 1 < d:
            w = a[k, k + 1 :].copy()
            h = _reflect(w, a[k:, k + 1 :].T)
            if h is not None:
                v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ h, h)
    diag, off = np.diag(a).copy(), np.diag(a, 1).copy()
    # signs: B = D1 |B| D2 with diagonal sign matrices, D2 goes into V
    left, right = 1.0, np.ones(d)
    for k in range(d):
        left = np.copysign(1.0, diag[k]) * right[k]
        if k + 1 < d:
            right[k + 1] = left * np.copysign(1.0, off[k])
    return np.abs(diag), np.abs(off), v * right


def _reflect(x: np.ndarray, block: np.ndarray) -> np.ndarray | None:
    """Apply to the rows of ``block`` the reflection that takes x to its first axis."""
    size = np.linalg.norm(x[1:])
    if size == 0:
        return None
    x = x / np.abs(x).max()
    x[0] += np.copysign(np.linalg.norm(x), x[0])
    x /= np.linalg.norm(x)
    block -= 2.0 * np.outer(x, x @ block)
    return x


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step: the transformed values and the sum of 1 / d,
    None if the shift passed the smallest value."""
    n, nq, ne = len(q), [0.0] * len(q), [0.0] * (len(q) - 1)
    d, inverse = q[0] - shift, 0.0
    for i in range(n - 1):
        if d < 0:
            return None
        inverse += 1 / d if d > 0 else math.inf
        nq[i] = d + e[i]
        if nq[i] == 0:
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / nq[i]
            ne[i] = e[i] * t
            d = d * t - shift
    if d < 0:
        return None
    nq[n - 1] = d
    return nq, ne, inverse + (1 / d if d > 0 else math.inf)


def singular_values(diag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal, falling, by dqds.

    A step without shift gives 1 / sum(1 / d), a lower bound of the smallest
    square that nears it as the last coupling fades; the next step uses it as
    its shift.  Nothing is subtracted but such shifts, so small values keep
    their relative accuracy.  Couplings that no longer matter split the rest."""
    scale = float(max(np.max(np.abs(diag), initial=0.0), np.max(np.abs(off), initial=0.0)))
    if scale == 0:
        return np.zeros(len(diag))
    found: list[float] = []
    todo = [([float(x / scale) ** 2 for x in diag], [float(x / scale) ** 2 for x in off], 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        steps = 0
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (4 * EPS) ** 2 * (shifted + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shifted))
                q, e, steps = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if q[0] < q[-1] and steps % 8 == 0:  # read from its other end: the small end is to be last
                q, e = q[::-1], e[::-1]
            steps += 1
            if steps > 500:
                raise ArithmeticError("dqds did not converge")
            q, e, inverse = _dqds_step(q, e, 0.0)
            shift = (1 - 4 * EPS) / inverse
            moved = _dqds_step(q, e, shift) if 0 < shift < math.inf else None
            if moved is not None:
                q, e, _ = moved
                shifted += shift
        found += [shifted + x for x in q]
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(diag: np.ndarray, off: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the stationary and the progressive factorisation of
    B'B - value, in their differential forms, and the pivot where both meet."""
    n, a, b = len(diag), (diag**2).tolist(), (off**2).tolist()
    tiny = EPS * EPS * max(value, max(a), 1e-300)
    down, up, s, p = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    s[0] = -value
    for i in range(n):
        down[i] = a[i] + s[i]
        if abs(down[i]) < tiny:
            down[i] = tiny
        if i + 1 < n:
            s[i + 1] = b[i] * (s[i] / down[i]) - value
    p[n - 1] = a[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = b[i] + p[i + 1]
        if abs(up[i + 1]) < tiny:
            up[i + 1] = tiny
        p[i] = a[i] * (p[i + 1] / up[i + 1] if b[i] else 1.0) - value
    side = diag[:-1] * off
    return -side / np.array(down[:-1]), -side / np.array(up[1:]), np.array(s) + np.array(p) + value


def _vector(lower: np.ndarray, upper: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(len(lower) + 1)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = lower[i] * z[i + 1]
    for i in range(twist, len(lower)):
        z[i + 1] = upper[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal, one column per given value.

    Each comes from the twisted factorisation whose middle pivot is smallest.
    Values closer than a thousandth form a cluster: its vectors are made
    orthogonal one by one, each from the twist that adds most to the others."""
    scale = float(max(np.max(np.abs(diag), initial=0.0), np.max(np.abs(off), initial=0.0))) or 1.0
    diag, off, values = diag / scale, off / scale, values / scale
    out = np.zeros((len(diag), len(values)))
    cluster = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * values[j - 1]:
            cluster = j
        lower, upper, gamma = _twisted(diag, off, float(value) ** 2)
        order = np.argsort(np.abs(gamma), kind="stable")
        if cluster == j:
            out[:, j] = _vector(lower, upper, int(order[0]))
            continue
        near, best = out[:, cluster:j], (-1.0, None)
        for twist in order:
            z = _vector(lower, upper, int(twist))
            for _ in range(2):
                z = z - near @ (near.T @ z)
            left = float(np.linalg.norm(z))
            if left > best[0]:
                best = (left, z)
            if left > 0.5:
                break
        z = best[1]
        for _ in range(2):
            z = z / np.linalg.norm(z)
            z = z - near @ (near.T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


# ------------------------------------------------------------ rows in tasks


def _usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, none of them null, non-finite or too
    large, as vec_id and the vector in double precision."""
    x = F.col(vector).cast("array<double>")
    bounded = F.forall(x, lambda c: F.coalesce(F.abs(F.nanvl(c, F.lit(math.inf))) < LARGEST, F.lit(False)))
    return embeddings.select("vec_id", x.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & bounded)


@dataclass(frozen=True)
class Model:
    """``n`` rows and their ``sums`` per dimension, exact; ``values`` are the
    falling eigenvalues of the covariance, ``directions`` its unit eigenvectors
    as columns, ``trace`` the sum of all its eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part of S / n taken off before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S) ** 2 over the dimensions of each row."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        y, r = x - np.array(whole, dtype=np.int64), np.array(rest, dtype=object)
        most = int(np.abs(y).max(initial=0))
        if len(rest) * most * max(most, self.n) < 1 << 62:  # else in whole numbers without bound
            r = r.astype(np.int64)
        else:
            y = y.astype(object)
        n, tail = self.n, sum(v * v for v in rest)
        return [n * (n * a - 2 * b) + tail for a, b in zip((y * y).sum(axis=1).tolist(), (y * r).sum(axis=1).tolist(), strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) / np.sqrt(self.values)


def _quantised(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    column = batch.column("v")
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return np.floor(STEPS * flat.reshape(-1, dimension)).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield _quantised(batch.slice(at, BLOCK), dimension)


def _sums(rows: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Rows, and exact sums per dimension: one row per task and dimension is
    shuffled, one per dimension collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, dtype=object)
        for x in _blocks(batches, dimension):
            n, sums = n + len(x), sums + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array([str(s) for s in sums])], names=["at", "n", "s"])

    total = rows.mapInArrow(add, "at int, n long, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(total.collect())
    return found[0]["n"], [int(r["s"]) for r in found]


def _triangle(rows: DataFrame, model: Model) -> np.ndarray:
    """R of the QR of all centred rows: a triangle per task, then ``FAN_IN``
    of them at a time until one is left."""
    d = len(model.sums)

    def reduced(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(model.centred(x) for x in _blocks(batches, d))

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(np.frombuffer(r, dtype=float).reshape(-1, d) for batch in batches for r in batch.column("r").to_pylist())

    table = shared_table(rows.mapInArrow(of_rows, "r binary"), "whitening-triangles")
    while (left := table.count()) > 1:
        table = shared_table(table.repartition(-(-left // FAN_IN)).mapInArrow(of_triangles, "r binary"), "whitening-triangles")
    r = np.frombuffer(bytes(table.first()["r"]), dtype=float).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _dimension(rows: DataFrame) -> int | None:
    """The most frequent length of a vector, the longest on a tie."""
    first = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else None


def fit(embeddings: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The whitening of ``embeddings(vec_id, vector)``, or None without rows.

    Components whose singular value is zero to working precision are left out."""
    rows = _usable(embeddings, vector)
    d = _dimension(rows)
    if d is None:
        return None
    rows = rows.filter(F.size("v") == d)
    n, sums = _sums(rows, d)
    model = Model(n, tuple(sums), np.zeros(0), np.zeros((d, 0)), 0.0)
    diag, off, v = bidiagonal(_triangle(rows, model) / math.sqrt(n))
    values = singular_values(diag, off)
    kept = values[: components][values[:components] > 64 * d * EPS * values[0]] if values[0] > 0 else values[:0]
    return Model(n, tuple(sums), kept**2, v @ right_vectors(diag, off, kept), float((values**2).sum()))


def identity_error(embeddings: DataFrame, model: Model, *, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows less the
    identity (0 without components); products are summed in Spark."""
    d, k = len(model.sums), len(model.values)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _blocks(batches, d):
            w = model.whitened(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    rows = _usable(embeddings, vector).filter(F.size("v") == d)
    found = sorted(rows.mapInArrow(products, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect())
    total = np.array([r["x"] for r in found]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row of ``embeddings(vec_id, vector)`` and component:
    ``vec_id, component`` (from 1 by falling eigenvalue), ``n`` (fitted rows),
    ``deviation`` (sum of (n * x - S)**2, exact; null beyond 63 bits),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error``.

    A null or empty vector, or one with a null, non-finite or too large entry
    (2**40 or more) gives no rows and is not fitted, neither is a vector whose
    length is not the most frequent one (the longest on a tie).  Repeated rows
    and null ids count like others; an empty table, or vectors that are all
    equal, give no rows; other columns are ignored.
    """
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(embeddings, vector=vector, components=components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(embeddings, model, vector=vector)
    d, k = len(model.sums), len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // 8):
                part = batch.slice(at, BLOCK // 8)
                x = _quantised(part, d)
                m = len(x)
                deviation = pa.array([v if v < 1 << 63 else None for v in model.deviations(x)], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        deviation.take(each), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return _usable(embeddings, vector).filter(F.size("v") == d).mapInArrow(rows, schema)
