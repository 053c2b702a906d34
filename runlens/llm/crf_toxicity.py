"""Toxicity by a linear-chain conditional random field.

Tokens are runs of letters and digits.  Two states: toxic and clean.  A token's
features are its word and its first 3 to 6 bytes (A-Z folded).  The labels
table marks documents, so tokens are labelled first.  A feature's evidence is
the Chernoff exponent of its document counts (over all labelled training rows,
equal texts once): how improbable so many toxic documents would be if it had
nothing to do with toxicity.  In a toxic training document, the tokens with
strong evidence, and not far below the document's strongest, are labelled.  The field
is then trained on tagged segments of a bounded sample (``SAMPLE`` documents per
class, ``SEGMENTS`` segments with weighted features per document) by gradient
ascent on the likelihood, with forward-backward expectations; segments without
such features differ by length alone and are counted, not repeated.

Scoring runs forward-backward over each whole document.  Tokens without any
weighted feature all share one transition matrix, so runs of them are matrix
powers; the marginals are those of the full chain.  The document score is a
logistic function of the ``TOP`` largest marginals of weighted tokens, fitted on
the same sample with the classes' document counts as weights: one mention of a
word that clean documents also use weighs less than several.  A token whose
marginal is ``ALONE`` or more is enough by itself.  Offending offsets are the
tokens with a marginal of one half or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import LOWER, collected, map_batches, map_rows, mix64, shared_table, with_ids, word_bounds, word_hashes
from runlens.llm.nbsvm import sampled

DIM_BITS = 19
PREFIXES = (3, 4, 5, 6)
SAMPLE = 1000
#: evidence (in nats) a feature needs to get a weight, and to label a token;
#: a labelled token has at least this share of its document's strongest
CANDIDATE, LABELLING, SHARE = 5.0, 11.5, 0.5
SEGMENT = 128
#: training segments with weighted features of one document, evenly spaced
SEGMENTS = 16
#: marginals that make the document score, and the penalty of their weights
TOP, TOP_PENALTY = 3, 0.1
#: a single token with this marginal is enough by itself
ALONE = 0.95
PASSES = 80
PENALTY = 1e-2

#: all but ASCII letters and digits and the bytes of other characters
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers: tokens x features, start bytes, end bytes)."""
    data = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends = word_bounds(data, BETWEEN)
    columns = [word_hashes(data, starts, ends)]
    for k in PREFIXES:
        # a word no longer than k has its whole-word feature only
        cut = np.minimum(ends, starts + k)
        h = word_hashes(data, starts, cut)
        columns.append(np.where(ends - starts > k, mix64(h + np.uint64(k)), columns[0]))
    shift = np.uint64(64 - DIM_BITS)
    return (np.stack(columns, axis=1) >> shift).astype(np.int64).reshape(len(starts), 1 + len(PREFIXES)), starts, ends


def _repeated(f: np.ndarray) -> np.ndarray:
    """Where a token's feature equals one of its earlier ones (short words)."""
    out = np.zeros(f.shape, dtype=bool)
    out[:, 1:] = f[:, 1:] == f[:, :1]
    return out


@dataclass(frozen=True)
class Field:
    """Potentials in logs: ``weights`` of features for the toxic state, its
    ``bias``, ``moves[from, to]``; ``verdict``: weights of the ``TOP`` largest
    marginals and an intercept (none: the largest marginal is the score)."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    verdict: tuple[float, ...] | None = None

    def document_score(self, marginals: np.ndarray) -> float:
        if self.verdict is None or not len(marginals):
            return float(marginals.max(initial=0.0))
        together = 1.0 / (1.0 + np.exp(-(top_marginals(marginals) @ np.array(self.verdict))))
        best = float(marginals.max())
        alone = best * (1.0 - ALONE) / (best * (1.0 - ALONE) + (1.0 - best) * ALONE)
        return float(max(together, alone))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        """Toxic-state scores of tokens; a repeated feature counts once."""
        return np.where(_repeated(f), 0.0, self.weights[f]).sum(axis=1)

    @cached_property
    def powers(self) -> _Powers:
        """Of the transition matrix over a token without weighted features."""
        return _Powers(np.exp(self.moves) * np.array([1.0, np.exp(self.bias)]))

    def active_marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, toxic marginals) of the tokens with a non-zero emission, by
        forward-backward over the whole chain."""
        places = np.flatnonzero(e)
        if not len(places):
            return places, np.zeros(0)
        powers = self.powers
        boost = np.exp(np.clip(e[places], -50, 50)).tolist()
        gaps = np.diff(places).tolist()
        # two states: vectors up to a factor are one ratio, toxic to clean
        first = int(places[0])
        forward, ratio = [], float(np.exp(self.bias))
        if first:
            m00, m01, m10, m11 = powers[first]
            ratio = (m01 + ratio * m11) / (m00 + ratio * m10)
        forward.append(ratio * boost[0])
        for gap, up in zip(gaps, boost[1:], strict=True):
            m00, m01, m10, m11 = powers[gap]
            ratio = forward[-1]
            forward.append((m01 + ratio * m11) / (m00 + ratio * m10) * up)
        ratio, after = 1.0, len(e) - 1 - int(places[-1])
        if after:
            m00, m01, m10, m11 = powers[after]
            ratio = (m10 + m11) / (m00 + m01)
        backward = [ratio]
        for gap, up in zip(reversed(gaps), reversed(boost[1:]), strict=True):
            m00, m01, m10, m11 = powers[gap]
            ratio *= up
            ratio = (m10 + m11 * ratio) / (m00 + m01 * ratio)
            backward.append(ratio)
        odds = np.array(forward) * np.array(backward[::-1])
        return places, odds / (1.0 + odds)


class _Powers(dict):
    """Normalized powers of one 2 x 2 matrix, by repeated squaring, as plain
    numbers (00, 01, 10, 11); a bounded memo."""

    def __init__(self, m: np.ndarray):
        super().__init__({1: tuple((m / m.sum()).ravel().tolist())})

    def __missing__(self, n: int) -> tuple[float, float, float, float]:
        if len(self) > 20_000:
            first = self[1]
            self.clear()
            self[1] = first
        half = self[n // 2]
        m = _product(half, half)
        if n % 2:
            m = _product(m, self[1])
        self[n] = m
        return m


def _product(a: tuple, b: tuple) -> tuple[float, float, float, float]:
    m = (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])
    total = sum(m)
    return (m[0] / total, m[1] / total, m[2] / total, m[3] / total)


def top_marginals(marginals: np.ndarray) -> np.ndarray:
    """The ``TOP`` largest marginals, descending (0 where there are fewer), and 1."""
    out = np.zeros(TOP + 1)
    best = np.sort(marginals)[::-1][:TOP]
    out[: len(best)] = best
    out[TOP] = 1.0
    return out


def document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """((2, features) document counts, documents per class) over all rows of
    ``rows(label, text)``; at most 2 * 2**DIM_BITS + 2 sums reach the driver."""
    size = 1 << DIM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[label, np.unique(token_features(text.as_py())[0])] += 1
                total[label, size] += 1
        label, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(total[label, feature])], names=["label", "feature", "n"])

    sums = rows.select("label", "text").mapInArrow(count, "label int, feature int, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    got = collected(sums)
    total = np.zeros((2, size + 1))
    total[got["label"], got["feature"]] = got["n"]
    return total[:, :size], total[:, size]


def evidence(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """n * KL(share of toxic documents || their overall share), 0 where the
    share is not above the overall one."""
    n = np.maximum(counts.sum(axis=0), 1)
    base = documents[1] / documents.sum()
    share = counts[1] / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(share > 0, share * np.log(share / base), 0.0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0.0)
    return np.where(share > base, n * kl, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on ``docs(doc_id, text)`` with document ``labels(doc_id, label)``
    (0 or 1; other labels and null ids are left out).  With one class or none
    no token is ever toxic."""
    labels = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    # equal texts count once: groups of copies are no evidence
    labels = (
        with_ids(docs.select("doc_id", F.xxhash64("text").alias("row_hash")), labels)
        .groupBy("label", "row_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label").distinct()
    )
    labels = shared_table(labels, "labels")
    counts, documents = document_counts(with_ids(docs.select("doc_id", "text"), labels))
    size = 1 << DIM_BITS
    neutral = Field(np.zeros(size), -8.0, np.zeros((2, 2)))
    if not documents.all():
        return neutral
    strength = evidence(counts, documents)
    if strength.max() < LABELLING:
        return neutral
    shared = docs.sparkSession.sparkContext.broadcast(strength.astype(np.float32))  # 2**DIM_BITS numbers

    def make() -> Callable[[list[tuple]], list[tuple]]:
        known = shared.value

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, label, text in rows:
                f, _, _ = token_features(text)
                s = np.where(_repeated(f), 0, known[f])
                place, column = np.nonzero(s >= CANDIDATE)
                best = s.max(axis=1, initial=0)
                toxic = np.flatnonzero(best >= max(LABELLING, SHARE * best.max(initial=0))) if label == 1 else np.zeros(0, dtype=np.int64)
                segments = np.unique(place // SEGMENT)
                if len(segments) > SEGMENTS:
                    segments = segments[np.linspace(0, len(segments) - 1, SEGMENTS).astype(np.int64)]
                    inside = np.isin(place // SEGMENT, segments)
                    place, column, toxic = place[inside], column[inside], toxic[np.isin(toxic // SEGMENT, segments)]
                out.append((doc_id, label, len(f), place.tolist(), f[place, column].tolist(), toxic.tolist()))
            return out

        return work

    chosen = sampled(labels, sample)  # bounded: at most 2 * sample ids
    read = map_rows(with_ids(docs.select("doc_id", "text"), chosen).select("doc_id", "label", "text"), make, "doc_id bigint, label int, n int, place array<int>, feature array<int>, toxic array<int>")
    table = collected(read.orderBy("doc_id"))
    tagged = [dict(zip(table, row, strict=True)) for row in zip(*table.values(), strict=True)]
    field = train(tagged, size)
    return replace(field, verdict=fit_verdict(field, tagged, documents))


def fit_verdict(field: Field, tagged: list[dict], documents: np.ndarray) -> tuple[float, ...]:
    """Weights of the document score: penalized logistic regression (Newton) of
    the labels of tagged documents with a weighted token, every class weighted
    up to its number of ``documents``."""
    x, y = [], []
    labels = np.array([int(d["label"]) for d in tagged])
    for d in tagged:
        places, at = np.unique(np.asarray(d["place"], dtype=np.int64), return_inverse=True)
        e = np.zeros(int(d["n"]))
        e[places] = np.bincount(at, field.weights[np.asarray(d["feature"], dtype=np.int64)], len(places))
        _, marginals = field.active_marginals(e)
        if len(marginals):
            x.append(top_marginals(marginals))
            y.append(int(d["label"]))
    if len(set(y)) < 2:
        return (0.0,) * TOP + (20.0 if y and y[0] else -20.0,)
    x, y = np.array(x), np.array(y)
    weight = (documents / np.maximum(np.bincount(labels, minlength=2), 1))[y]
    ridge = TOP_PENALTY * np.diag([1.0] * TOP + [0.01])
    w = np.zeros(TOP + 1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def train(tagged: list[dict], size: int) -> Field:
    """Gradient ascent (Adam) on the penalized likelihood of tagged documents:
    n tokens, sparse (place, feature) pairs, toxic places."""
    rows, places, features, gold = [], [], [], []
    lengths: list[int] = []
    plain = np.zeros(SEGMENT + 1, dtype=np.int64)  # segments without features, by length
    for d in tagged:
        p, g = np.asarray(d["place"], dtype=np.int64), np.asarray(d["toxic"], dtype=np.int64)
        busy, at = np.unique(p // SEGMENT, return_inverse=True)
        whole, rest = divmod(int(d["n"]), SEGMENT)
        own = np.minimum(SEGMENT, int(d["n"]) - busy * SEGMENT)
        plain[SEGMENT] += whole
        plain[rest] += 1
        np.subtract.at(plain, own, 1)
        first = len(lengths)
        lengths += own.tolist()
        rows.append(first + at)
        places.append(p % SEGMENT)
        features.append(np.asarray(d["feature"], dtype=np.int64))
        gold.append(np.stack([first + np.searchsorted(busy, g // SEGMENT), g % SEGMENT], axis=1).reshape(-1, 2))
    plain[0] = 0
    lengths += np.flatnonzero(plain).tolist()
    n, length = len(lengths), np.array(lengths)
    weight = np.ones(n)
    weight[n - np.count_nonzero(plain) :] = plain[plain > 0]
    row, place, feature = np.concatenate(rows), np.concatenate(places), np.concatenate(features)
    used, slot = np.unique(feature, return_inverse=True)
    inside = np.arange(SEGMENT)[None, :] < length[:, None]
    tags = np.zeros((n, SEGMENT), dtype=np.int8)
    where = np.concatenate(gold)
    tags[where[:, 0], where[:, 1]] = 1
    both = inside[:, 1:]
    seen_moves = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen_moves[i, j] = ((tags[:, :-1] == i) & (tags[:, 1:] == j) & both).sum()
    seen_toxic = float(tags.sum())
    seen_features = np.bincount(slot, tags[row, place], len(used))
    # packed parameters: feature weights, bias, moves 01, 10, 11 (00 is fixed at 0)
    x = np.zeros(len(used) + 4)
    x[len(used)] = -3.0
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, PASSES + 1):
        w, bias = x[: len(used)], x[len(used)]
        moves = np.array([[0.0, x[-3]], [x[-2], x[-1]]])
        e = np.full((n, SEGMENT), bias, dtype=np.float32)
        np.add.at(e, (row, place), w[slot])
        marginal, expected = _expectations(e, moves, inside, weight)
        gradient = np.concatenate([
            seen_features - np.bincount(slot, marginal[row, place], len(used)),
            [seen_toxic - weight @ marginal.sum(axis=1, dtype=np.float64)],
            (seen_moves - expected).ravel()[1:],
        ]) - PENALTY * np.append(w, np.zeros(4)) * 1.0
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.999 * m2 + 0.001 * gradient**2
        x += 0.2 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = np.where(np.abs(x[: len(used)]) > 0.05, x[: len(used)], 0.0)
    return Field(weights, float(x[len(used)]), np.array([[0.0, x[-3]], [x[-2], x[-1]]]))


def _expectations(e: np.ndarray, moves: np.ndarray, inside: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginals (0 outside) and expected move counts of many segments,
    each counted ``weight`` times."""
    n, length = e.shape
    weight = np.ones(n) if weight is None else weight
    step = np.exp(moves)
    boost = np.exp(np.clip(e, -50, 50))
    forward = np.empty((length, n, 2), dtype=np.float32)
    a = np.stack([np.ones(n), boost[:, 0]], axis=1)
    a /= a.sum(axis=1, keepdims=True)
    forward[0] = a
    for t in range(1, length):
        a = a @ step
        a[:, 1] *= boost[:, t]
        a /= a.sum(axis=1, keepdims=True)
        forward[t] = a
    marginal, expected = np.zeros((n, length), dtype=np.float32), np.zeros((2, 2))
    b = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        both = forward[t] * b
        marginal[:, t] = both[:, 1] / both.sum(axis=1) * inside[:, t]
        if t:
            c = b.copy()
            c[:, 1] *= boost[:, t]
            pair = forward[t - 1][:, :, None] * step[None] * c[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += np.tensordot(weight * inside[:, t], pair, axes=1)
            b = np.where(inside[:, t : t + 1], c @ step.T, 1.0)  # padding counts for nothing
            b /= b.sum(axis=1, keepdims=True)
    return marginal, expected


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, spans string"


def tag(text: str | None, field: Field) -> tuple[float, list[tuple[int, int]]]:
    """(document score, offending (start, end) code points) of a text."""
    f, starts, ends = token_features(text)
    if not len(f):
        return 0.0, []
    places, marginals = field.active_marginals(field.emissions(f))
    if not len(places):
        return 0.0, []
    hit = places[marginals >= 0.5]
    spans: list[tuple[int, int]] = []
    if len(hit):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
        spans = list(zip(points[starts[hit]].tolist(), points[ends[hit]].tolist(), strict=True))
    return field.document_score(marginals), spans


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` per row of ``docs(doc_id,
    held_out, text)``; spans as ``start:end`` code points, comma-joined.  Null
    and empty texts and texts without a weighted token score 0; repeated rows
    and null ids are kept."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.moves, field.verdict))  # 2**DIM_BITS numbers

    def make() -> Callable[[list[tuple]], list[tuple]]:
        own = Field(*shared.value)

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, held, text in rows:
                s, spans = tag(text, own)
                out.append((doc_id, held, s, int(s >= 0.5), ",".join(f"{a}:{b}" for a, b in spans)))
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "held_out", "text"), make, SCHEMA)


def reject(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` (any columns, one of them ``text``) whose score is
    below one half."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.moves, field.verdict))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = Field(*shared.value)
        return lambda batch: batch.filter(pa.array([tag(t, own)[0] < 0.5 for t in batch.column("text").to_pylist()], type=pa.bool_()))

    return map_batches(docs, make)
