"""Language ID by hyperdimensional profiles.

Every letter has a random bipolar vector (drawn from its code point, so it is
the same in every task).  An n-gram is the product of its letters' vectors,
each permuted (rotated) by its place.  A document is the bundle (sum) of its
n-gram vectors; a language prototype is the bundle of all its training
documents.  A document gets the language whose prototype has the largest
cosine.  Text is folded to lower-case letters; each run of anything else is
one space.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import map_rows

DIMENSIONS = 1024
GRAM = 3
SEED = 7
UNDETERMINED = "und"
#: n-grams whose vectors are held in memory at a time
BLOCK = 8192


class Encoder:
    """Bundles documents; letter vectors are made when first needed."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.folds: dict[int, int] = {}

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.d, dtype=np.int8)
            v = self.letters[code] = bits * np.int8(2) - np.int8(1)
        return v

    def fold(self, code: int) -> int:
        """Lower-case letter of a code point, 32 for all that is no letter."""
        f = self.folds.get(code)
        if f is None:
            c = chr(code)
            low = c.lower()
            f = self.folds[code] = (ord(low) if len(low) == 1 else code) if c.isalpha() else 32
        return f

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams (three 21-bit codes each) and their counts; None for
        a text without letters."""
        codes = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
        if not len(codes):
            return None
        used = np.flatnonzero(np.bincount(codes)) if codes.max() < 65536 else np.unique(codes)
        table = np.array([self.fold(int(c)) for c in used], dtype=np.int64)
        if (table == 32).all():
            return None
        if codes.max() < 65536:
            lookup = np.zeros(int(used[-1]) + 1, dtype=np.int64)
            lookup[used] = table
            s = lookup[codes]
        else:
            s = table[np.searchsorted(used, codes)]
        s = np.concatenate(([32], s, [32]))
        s = s[np.concatenate(([True], (s[1:] != 32) | (s[:-1] != 32)))]
        keys = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
        return np.unique(keys, return_counts=True)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """One row per n-gram: rotated letter vectors, multiplied."""
        mask = (1 << 21) - 1
        out = None
        for place in range(GRAM):
            codes = (keys >> (21 * (GRAM - 1 - place))) & mask
            used, at = np.unique(codes, return_inverse=True)
            rolled = np.stack([np.roll(self.letter(int(c)), GRAM - 1 - place) for c in used])[at]
            out = rolled if out is None else out * rolled
        return out.astype(np.float32)

    def bundle(self, docs: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of the n-gram vectors by group: (groups, dimensions)."""
        keys = np.concatenate([k for k, _ in docs])
        counts = np.concatenate([c for _, c in docs])
        row = np.repeat(group, [len(k) for k, _ in docs])
        every, at = np.unique(keys, return_inverse=True)
        total = np.zeros((groups, self.d), dtype=np.float64)
        for first in range(0, len(every), BLOCK):
            inside = (at >= first) & (at < first + BLOCK) if len(every) > BLOCK else slice(None)
            size = min(BLOCK, len(every) - first)
            weights = np.bincount(row[inside] * size + (at[inside] - first), counts[inside], groups * size).reshape(groups, size)
            total += weights.astype(np.float32) @ self.vectors(every[first : first + size])
        return total


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype per language, bundled over all rows of ``train(lang,
    text)`` with a language and a letter.  Tasks emit partial sums, Spark adds
    them up; the driver gets ``languages x dimensions`` numbers."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        encoder = Encoder(dimensions)

        def work(rows: list[tuple]) -> list[tuple]:
            read = [(lang, encoder.grams(text)) for lang, text in rows]
            read = [(lang, g) for lang, g in read if g is not None]
            if not read:
                return []
            langs = sorted({lang for lang, _ in read})
            sums = encoder.bundle([g for _, g in read], np.array([langs.index(lang) for lang, _ in read]), len(langs))
            return [(lang, sums[i].tolist()) for i, lang in enumerate(langs)]

        return work

    parts = map_rows(train.filter("lang IS NOT NULL").select("lang", "text"), make, "lang string, v array<double>", chunk=512)
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, i, x in summed.collect():
        out.setdefault(lang, np.zeros(dimensions))[i] = x
    return {lang: v / (np.linalg.norm(v) or 1.0) for lang, v in sorted(out.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id,
    held_out, text)``; score is the cosine (negative ones count as 0).

    Texts that are null or have no letter get ``und`` with score 0, and so does
    everything if there is no prototype; of equal cosines the first language in
    string order wins.  Null ids and repeated rows are kept."""
    langs = list(profiles)
    matrix = np.stack([profiles[x] for x in langs]) if langs else np.zeros((0, dimensions))

    def make() -> Callable[[list[tuple]], list[tuple]]:
        encoder = Encoder(dimensions)

        def work(rows: list[tuple]) -> list[tuple]:
            read = [encoder.grams(text) if langs else None for _, _, text in rows]
            known = [g for g in read if g is not None]
            best: list[tuple[str, float]] = []
            if known:
                bundles = encoder.bundle(known, np.arange(len(known)), len(known))
                norms = np.linalg.norm(bundles, axis=1)
                cosines = (bundles @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                best = [(langs[i], float(min(1.0, max(0.0, c[i])))) for c in cosines for i in [int(c.argmax())]]
            found = iter(best)
            return [(doc_id, held, *((UNDETERMINED, 0.0) if g is None else next(found))) for (doc_id, held, _), g in zip(rows, read, strict=True)]

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "held_out", "text"), make, "doc_id bigint, held_out boolean, lang_pred string, score double", chunk=512)
