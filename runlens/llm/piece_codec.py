"""SentencePiece encoding and decoding: Aho-Corasick driven Viterbi.

An Aho-Corasick automaton over the pieces reads a text once.  At every
position its output links give all pieces that end there, and each relaxes the
best score of that position: ``best[end] = max(best[start] + score)``.  A
character without a piece of its own costs the lowest score less 10 and is
written as its UTF-8 byte pieces (as ``<unk>`` if the model has none).

The best segmentation of a text splits at every place no piece can span.  Where
no piece has a word mark after another character, that is before every run of
word marks; the segments in between repeat, so their results are kept in a
bounded memo.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from dataclasses import astuple, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: the memo holds so many segments of at most so many characters
MEMO_SIZE = 400_000
MEMO_LENGTH = 64
_NONE = -float("inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Vocabulary:
    """The parts of a model that encoding needs; small, shipped to tasks."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool


def load_vocabulary(spark: SparkSession, model: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file on the driver; a path that is not local
    is read with Spark.  Only identity normalization is accepted."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if os.path.exists(model):
        with open(model, "rb") as f:
            raw = f.read()
    else:
        raw = bytes(spark.read.format("binaryFile").load(model).select("content").first()[0])
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with identity normalization can be encoded without loss")
    return Vocabulary(
        tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), tuple(p.type for p in proto.pieces), spec.add_dummy_prefix
    )


class Codec(dict):
    """Encoder and decoder; as a dict, the memo of encoded segments."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        usable = [i for i, k in enumerate(vocabulary.kinds) if k in (NORMAL, USER_DEFINED)]
        for i in usable:
            piece = vocabulary.pieces[i]
            self.automaton.add_word(piece, (len(piece), vocabulary.scores[i], i))
        self.automaton.make_automaton()
        self.unknown_score = min((vocabulary.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, k in enumerate(vocabulary.kinds) if k == UNKNOWN), 0)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if k == BYTE}
        spans = any(re.search(f"[^{MARK}]{MARK}", vocabulary.pieces[i]) for i in usable)
        self.segments = re.compile("(?s).+" if spans else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.alphabet = {vocabulary.pieces[i] for i in usable if len(vocabulary.pieces[i]) == 1}
        self.raw = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else p.encode()
            for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]

    def viterbi(self, segment: str) -> list[int]:
        """Ids of the best-scoring segmentation; the longer last piece wins a
        tie (output links come longest first)."""
        n = len(segment)
        # one entry per end position, and the start's at index -1
        best = [_NONE] * n + [0.0]
        step = [(1, -1)] * n
        if self.alphabet.issuperset(segment):
            for end, found in self.automaton.iter(segment):
                value = best[end - found[0]] + found[1]
                if value > best[end]:
                    best[end] = value
                    step[end] = found
        else:
            settled = 0  # positions below are final, unknown characters included
            for end, found in self.automaton.iter(segment):
                if settled < end:
                    self._unknown(segment, best, settled, end)
                    settled = end
                value = best[end - found[0]] + found[1]
                if value > best[end]:
                    best[end] = value
                    step[end] = found
            self._unknown(segment, best, settled, n)
        ids, at = [], n - 1
        while at >= 0:
            found = step[at]
            if found[-1] >= 0:
                ids.append(found[2])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(segment[at].encode())]
            else:
                ids.append(self.unknown_id)
            at -= found[0]
        ids.reverse()
        return ids

    def _unknown(self, segment: str, best: list[float], first: int, last: int) -> None:
        """The unknown edge of the characters without a piece of their own."""
        for at in range(first, last):
            if segment[at] not in self.alphabet and best[at - 1] + self.unknown_score > best[at]:
                best[at] = best[at - 1] + self.unknown_score

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= MEMO_SIZE:
            self.clear()
        ids = array("i", self.viterbi(segment)).tobytes()
        if len(segment) <= MEMO_LENGTH:
            self[segment] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; null and empty texts have none."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.__getitem__, self.segments.findall(marked))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").replace(MARK, " ")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, decoded string, round_trip boolean"


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``ids``, their number, the text decoded from them and whether it equals
    the source, per row of ``docs(doc_id, text)``.

    Null and empty texts have no ids and decode to the empty text (a null
    counts as empty); a text that itself holds U+2581 decodes to spaces there
    and reports ``round_trip`` false.  Null ids and repeated rows are kept,
    other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(vocabulary))  # one model: its size does not grow with the documents

    def make() -> Callable[[list[tuple]], list[tuple]]:
        codec = Codec(Vocabulary(*shared.value))

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, text in rows:
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                out.append((doc_id, ids, len(ids), decoded, decoded == (text or "")))
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)
