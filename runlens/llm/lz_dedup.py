"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus; its blocks are the documents, indexed by
their phrases of ``PHRASE`` = 35 words.  The index keeps one block per phrase,
the smallest doc_id that has it, which may be the document itself; a factor is
a run of repeated phrases with one such block.  This departs from greedy
relative Lempel-Ziv: a factor ends where the smallest holder changes, also where
one block goes on matching, and may refer to its own text.  Every factor is a
duplicate span of at least 35 words, and every repeated phrase lies in one, so
the union of the factors is exactly the words covered by a phrase that starts
anywhere else.

Indexing every phrase would be several times the corpus, so an anchor index
comes first: of each phrase's 28 grams of 8 words the smallest hash is its
anchor.  Equal phrases have the same anchor at the same place, so only phrases
whose anchor occurs twice in the corpus are indexed and looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import BROADCAST_IDS, gram_hashes, map_rows, shared_table, text_words

PHRASE = 35
GRAM = 8
#: long texts are read in slices of so many phrases
SLICE = 1 << 16


def anchor_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, gram index of every phrase's anchor) of a text's words."""
    g = gram_hashes(h, GRAM)
    n = len(h) - PHRASE + 1
    if n <= 0:
        return g, np.zeros(0, dtype=np.int64)
    width = PHRASE - GRAM + 1
    at = [
        np.lib.stride_tricks.sliding_window_view(g[i : min(n, i + SLICE) + width - 1], width).argmin(axis=1) + np.arange(i, min(n, i + SLICE))
        for i in range(0, n, SLICE)
    ]
    return g, np.concatenate(at)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _with_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text, copy_of, is_first``: ``copy_of`` is the smallest doc_id
    with the same text where several rows have it, else null."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    copies = shared_table(
        keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("copy_of")).filter("n > 1").select("h1", "h2", "copy_of"),
        "copies",
    )
    joined = keyed.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["h1", "h2"], "left")
    return joined.select("doc_id", "text", "copy_of", (F.col("copy_of").isNull() | (F.coalesce("doc_id", F.lit(-1)) == F.col("copy_of"))).alias("is_first"))


def _anchors(rows: DataFrame) -> DataFrame:
    """``doc_id, anchors``: the anchors of every distinct text, by place."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, text in rows:
                g, at = anchor_places(text_words(text, lower=False)[0])
                out.append((doc_id, _signed(g[np.unique(at)])))
            return out

        return work

    return shared_table(map_rows(rows.filter("is_first").select("doc_id", "text"), make, "doc_id bigint, anchors array<bigint>"), "anchors")


def _holders(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows with a shared anchor: kept before any text is shuffled if their
    ids are few enough to send to every task."""
    ids = shared.select(F.col("doc_id").alias("s_id"))
    return rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi") if ids.count() <= BROADCAST_IDS else rows


def _phrases(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id, phrase, weight``: one row per phrase whose anchor is shared."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, text, copy_of, is_first, anchors in rows:
                if is_first:
                    h = text_words(text, lower=False)[0]
                    g, at = anchor_places(h)
                    wanted = np.isin(g, anchors.view(np.uint64))[at]
                    out.append((doc_id, _signed(gram_hashes(h, PHRASE)[wanted]), 1 if copy_of is None else 2))
            return out

        return work

    lists = map_rows(_joined(rows, shared, ["anchors"], "inner"), make, "doc_id bigint, phrases array<bigint>, weight int")
    return lists.select("doc_id", F.explode_outer("phrases").alias("phrase"), "weight").filter("phrase IS NOT NULL")


def _joined(rows: DataFrame, lists: DataFrame, columns: list[str], how: str) -> DataFrame:
    right = lists.select(F.col("doc_id").alias("l_id"), *columns)
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("l_id")), how).select(*rows.columns, *columns)


def factors(h: np.ndarray, phrase: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int, int]]:
    """Factors (start, words, block) of a text with word hashes ``h``;
    ``phrase`` (ascending) are the phrases that occur elsewhere, ``blocks`` the
    block of each."""
    own = gram_hashes(h, PHRASE)
    if not len(own) or not len(phrase):
        return []
    slot = np.minimum(np.searchsorted(phrase, own), len(phrase) - 1)
    hit = phrase[slot] == own
    block = np.where(hit, blocks[slot], 0)
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0) | (np.diff(block, prepend=block[:1]) != 0))
    out = []
    for start, end in zip(edge, np.append(edge[1:], len(own)), strict=True):
        if hit[start]:
            out.append((int(start), int(end - start) + PHRASE - 1, int(block[start])))
    return out


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<struct<start:bigint,words:bigint,block:bigint>>, kept string"


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_words``, ``n_removed`` (words
    inside any 35-word phrase that also starts anywhere else, the same document
    included), ``kept_sha256``, the ``factors`` (start word, words, reference
    block = smallest doc_id holding the phrase) and the ``kept`` text (null
    without ``keep_text``).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged.  Null and empty texts
    have no words; texts under 35 words lose nothing; repeated rows repeat each
    other and lose their shared phrases; null ids are kept (as block: -1);
    other columns are ignored; an empty table gives no rows.
    """
    rows = _with_copies(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    anchors = _anchors(rows).select("doc_id", F.explode_outer("anchors").alias("anchor")).filter("anchor IS NOT NULL")
    # written, so that the join below shuffles both sides itself and a hot anchor can be split
    repeated = shared_table(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated")
    shared = shared_table(
        anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared"
    )
    phrases = _phrases(_holders(rows, shared), shared)
    index = shared_table(
        phrases.groupBy("phrase").agg(F.sum("weight").alias("n"), F.min("doc_id").alias("block")).filter("n > 1").select("phrase", "block"), "index"
    )
    matches = (
        phrases.filter("weight = 1").join(index, "phrase")
        .groupBy("doc_id")
        .agg(F.collect_list("phrase").alias("phrases"), F.collect_list(F.coalesce("block", F.lit(-1))).alias("blocks"))
    )

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, text, copy_of, _, phrases, blocks in rows:
                words = (text or "").encode().split()  # bytes split at [\x20\x09-\x0D] alone
                parsed, kept = [], words
                if copy_of is not None and len(words) >= PHRASE:
                    parsed, kept = [(0, len(words), copy_of)], []
                elif phrases is not None and len(words) >= PHRASE:
                    phrase, first = np.unique(phrases.view(np.uint64), return_index=True)
                    parsed = factors(text_words(text, lower=False)[0], phrase, blocks[first])
                    drop = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, n, _ in parsed:
                        drop[start] += 1
                        drop[start + n] -= 1
                    kept = list(compress(words, (np.cumsum(drop[:-1]) == 0).tolist()))
                rest = b" ".join(kept)
                spans = [{"start": s, "words": w, "block": b} for s, w, b in parsed]
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), spans, rest.decode() if keep_text else None))
            return out

        return work

    return map_rows(_joined(rows, matches, ["phrases", "blocks"], "left"), make, SCHEMA)
