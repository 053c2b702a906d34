"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: byte trigrams of the text as it
stands (they see case, symbols and markup debris), whole words, and the word
n-grams that repeat one word, whichever word that is.  Each
indicator is scaled by its class log-count ratio

    r = log((p / |p|) / (q / |q|)),  p = 1 + documents of class 1 with it, q of class 0

and a linear model with hinge loss is fitted to the scaled vectors by dual
coordinate descent.  The ratios are counted over all labelled training rows;
the linear model is fitted on at most ``SAMPLE`` rows per class (those with the
smallest id hashes), a documented bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import collected, map_rows, mix64, with_ids, word_bounds, word_hashes

DIM_BITS = 18
SAMPLE = 2000
#: lengths of the repeated-word n-grams
REPEATS = (2, 3, 4, 6)
#: weight of the fitted vector against its mean magnitude (the Naive Bayes part)
BLEND = 0.5
#: cost of a training error, and passes of the descent
COST = 0.1
PASSES = 15


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text, ascending; none for null."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    wide = data.astype(np.uint64)
    grams = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:] if len(data) >= 3 else wide[:0]
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    shift = np.uint64(64 - DIM_BITS)
    same = np.concatenate((words[1:] == words[:-1], [False]))
    change = np.flatnonzero(~same)
    longest = int(np.diff(change, prepend=-1).max(initial=0))  # longest run of one word
    repeats = np.array([n for n in REPEATS if n <= longest], dtype=np.uint64)
    return np.unique(np.concatenate([mix64(grams + np.uint64(1)) >> shift, words >> shift, mix64(repeats + np.uint64(1 << 32)) >> shift])).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the indicators, ratios included
    bias: float

    def margin(self, f: np.ndarray) -> float:
        """The signed margin of a feature set (scaled to unit length)."""
        return float(self.weights[f].sum() / np.sqrt(max(1, len(f))) + self.bias)


def class_counts(rows: DataFrame) -> np.ndarray:
    """(2, features) document counts over all rows of ``rows(label, text)``;
    the driver gets at most 2 * 2**DIM_BITS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << DIM_BITS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[label, features(text.as_py())] += 1
        label, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(total[label, feature])], names=["label", "feature", "n"])

    sums = rows.select("label", "text").mapInArrow(count, "label int, feature int, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    got = collected(sums)
    total = np.zeros((2, 1 << DIM_BITS))
    total[got["label"], got["feature"]] = got["n"]
    return total


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 1.0
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of the L2-regularized hinge-loss model; the last feature is the
    bias.  One dual variable per row, each step solves its own subproblem."""
    w = np.zeros(size)
    alpha = np.zeros(len(rows))
    norm = [float(v @ v) for v in values]
    order = np.random.default_rng(1)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i], values[i]
            gradient = y[i] * float(w[f] @ v) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def sampled(labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` ids per label, the smallest by a hash of the id."""
    part = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for k in (0, 1)]
    return part[0].unionByName(part[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, label)`` (0 or 1;
    other labels and null ids are left out).  With one class or none the model
    is neutral: it gives margin 0."""
    labels = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    counts = class_counts(with_ids(docs.select("doc_id", "text"), labels))
    size = 1 << DIM_BITS
    if not counts[0].any() or not counts[1].any():
        return Model(np.zeros(size), 0.0)
    ratios = log_count_ratios(counts)

    def make() -> Callable[[list[tuple]], list[tuple]]:
        return lambda rows: [(doc_id, label, features(text).tolist()) for doc_id, label, text in rows]

    chosen = sampled(labels, sample)  # bounded: at most 2 * sample ids
    read = map_rows(with_ids(docs.select("doc_id", "text"), chosen).select("doc_id", "label", "text"), make, "doc_id bigint, label int, f array<int>")
    table = collected(read.orderBy("doc_id"))
    y = np.where(table["label"] == 1, 1.0, -1.0)
    rows, values = [], []
    for f in table["f"]:
        f = np.asarray(f, dtype=np.int64)
        rows.append(np.append(f, size))
        values.append(np.append(ratios[f] / np.sqrt(max(1, len(f))), 1.0))
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = COST * np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    w = dual_coordinate_descent(rows, values, y, size + 1, cost)
    used = np.abs(w[:size])
    mean = used[used > 0].mean() if (used > 0).any() else 0.0
    blended = np.where(counts.any(axis=0), (1 - BLEND) * mean + BLEND * w[:size], 0.0)
    return _centred(Model(ratios * blended, 0.0), rows, y)


def _centred(model: Model, rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The bias that balances the errors of both classes on the sample."""
    margins = np.array([model.margin(f[:-1]) for f in rows])
    order = np.argsort(margins)
    m, pos = margins[order], y[order] > 0
    wrong = np.cumsum(pos) / max(1, pos.sum()) + (~pos).sum() / max(1, (~pos).sum()) - np.cumsum(~pos) / max(1, (~pos).sum())
    i = int(wrong.argmin())
    cut = (m[i] + m[min(i + 1, len(m) - 1)]) / 2
    scale = np.abs(margins - cut).mean() or 1.0
    return Model(model.weights * (3 / scale), float(-cut * 3 / scale))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id,
    held_out, text)``.  Null and empty texts have no feature and get the score
    of the bias; repeated rows and null ids are kept."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**DIM_BITS numbers

    def make() -> Callable[[list[tuple]], list[tuple]]:
        own = Model(*shared.value)

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, held, text in rows:
                s = 1.0 / (1.0 + np.exp(-np.clip(own.margin(features(text)), -30, 30)))
                out.append((doc_id, held, float(s), int(s >= 0.5)))
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "held_out", "text"), make, "doc_id bigint, held_out boolean, score double, predicted int")
