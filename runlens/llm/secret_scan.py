"""Secret scans by a recursive decoding worklist.

Every text is layer 0.  A layer is scanned for the three base kinds, then
unwrapped in every way that applies: percent escapes, Unicode escapes and
compatibility forms, base64 blobs, compressed data inside base64.  Each new
layer joins the worklist until nothing new appears; a layer seen before is not
opened again, so cycles end.  Every character of a layer remembers which code
points of the source text it came from, so spans found at any depth are
reported in the source text.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import map_batches, map_rows

#: The kinds in their listed order; fixed values of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
COMPAT = re.compile("[\uff01-\uff5e\U0001d400-\U0001d7ff]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: base64 over several lines (line ends may be written as escapes), and its lines
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"(?:^|(?<=\\r\\n)|(?<=\\n)|(?<=[\s]))[A-Za-z0-9+/_-]+")
#: how gzip and zlib data begin in base64, and a stretch of text in other bytes:
#: no span and no wrapped span is shorter than 16 characters
PACKED = re.compile(r"H4sI|eJ[w-z]|eA[E-H]|eF[4-7]|eN[o-r]")
STRETCH = re.compile(rb"(?:[\x20-\x7e\t\n\r]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}+")

#: A compressed layer that unpacks to more than this many bytes is not opened as
#: a whole: it is scanned in overlapping pieces, counted in ``unopened`` and
#: redacted.  The pieces of one text end at MAX_PIECES bytes in all
#: (decompression bombs inside bombs must not end a task).
MAX_UNPACKED, PIECE, OVERLAP, MAX_PIECES = 64 << 20, 1 << 20, 1 << 16, 16 << 30

#: characters that are unpacked first at a start of compressed data; all of the
#: rest is, unless the data has a fault in them
HEAD = 4096

#: source spans of a layer's characters: None is the text itself
Origin = list[tuple[int, int]] | None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches in one string."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _source(origin: Origin, start: int, end: int) -> tuple[int, int]:
    if origin is None:
        return start, end
    part = origin[start:end]
    return min(s for s, _ in part), max(e for _, e in part)


def _rewritten(layer: str, origin: Origin, edits: Iterator[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, Origin]:
    """The layer with pieces replaced; an edit lists its new characters, each
    with the range of old characters it stands for."""
    text, places, at = [], [], 0
    keep = (lambda a, b: [(i, i + 1) for i in range(a, b)]) if origin is None else (lambda a, b: origin[a:b])
    for start, end, chars in edits:
        text.append(layer[at:start])
        places += keep(at, start)
        for c, a, b in chars:
            text.append(c)
            places += [_source(origin, a, b)] * len(c)
        at = end
    text.append(layer[at:])
    places += keep(at, len(layer))
    return "".join(text), places


def _percent(layer: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    for m in PERCENT.finditer(layer):
        raw, chars, at = bytes.fromhex(m[0].replace("%", "")), [], 0
        while at < len(raw):
            lead = raw[at]
            size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
            try:
                c = raw[at : at + size].decode()
            except UnicodeDecodeError:
                c, size = raw[at : at + 1].decode("latin-1"), 1
            chars.append((c, m.start() + 3 * at, m.start() + 3 * min(at + size, len(raw))))
            at += size
        yield m.start(), m.end(), chars


def _escapes(layer: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    for m in ESCAPE.finditer(layer):
        code = int(m[6]) if m[6] else int(next(x for x in m.groups()[:5] if x), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), [(chr(code), m.start(), m.end())]


def _compat(layer: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    for m in COMPAT.finditer(layer):
        yield m.start(), m.end(), [(unicodedata.normalize("NFKC", m[0]), m.start(), m.end())]


def _unpack(raw: bytes) -> tuple[bytes | None, int]:
    """Decompressed zlib or gzip data (all members) and how many bytes they took,
    all if they end in a fault; the bytes themselves if they are neither; None if
    they would exceed MAX_UNPACKED."""
    out, size = b"", len(raw)
    while raw[:2] == b"\x1f\x8b" or raw[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):
        unpacker, more = zlib.decompressobj(47), b""
        try:
            for at in range(0, len(raw), 1 << 16):  # in pieces: what precedes a fault is kept
                more += unpacker.decompress(raw[at : at + (1 << 16)], MAX_UNPACKED + 1 - len(out) - len(more))
                if unpacker.unconsumed_tail or len(out) + len(more) > MAX_UNPACKED:
                    return None, size
                if unpacker.eof:
                    break
        except zlib.error:
            return out + more or raw, size
        out += more
        if not unpacker.eof:
            return out, size
        raw = unpacker.unused_data + raw[at + (1 << 16) :]
    return (out, size - len(raw)) if out else (raw, size)


def _breaks(raw: bytes) -> bool:
    """If the first member of compressed data has a fault in these bytes."""
    try:
        zlib.decompressobj(47).decompress(raw, MAX_UNPACKED)
    except zlib.error:
        return True
    return False


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Decompressed zlib or gzip data, all members, in pieces that overlap."""
    tail = b""
    while raw[:2] == b"\x1f\x8b" or raw[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):
        unpacker = zlib.decompressobj(47)
        try:
            while not unpacker.eof:
                more = unpacker.decompress(raw, PIECE)
                raw = unpacker.unconsumed_tail
                if not more and not raw:
                    break
                yield tail + more
                tail = (tail + more)[-OVERLAP:]
        except zlib.error:
            return
        raw = unpacker.unused_data


def _bytes(blob: str) -> bytes:
    """The bytes of a base64 run; a last character that is none of a byte is left out."""
    blob = blob[:-1] if len(blob) % 4 == 1 else blob
    return base64.b64decode(blob.replace("-", "+").replace("_", "/") + "=" * (-len(blob) % 4))


def _clean(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or all(c.isprintable() or c in "\t\n\r" for c in text) else None


SPACES = str.maketrans("\t\n\r", "   ")


def _stretches(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of the stretches of text, odd characters replaced."""
    for m in STRETCH.finditer(raw):
        text = m[0].decode(errors="replace")
        if not text.translate(SPACES).isprintable():
            text = "".join(c if c.isprintable() or c in "\t\n\r" else "\ufffd" for c in text)
        yield m.start(), m.end(), text


def _runs(layer: str) -> Iterator[tuple[str, Sequence[int], int, bool]]:
    """(run, place of each character, end with padding, wrapped) of the base64
    runs, lines joined first."""
    if "\n" in layer or "\r" in layer or "\\n" in layer:
        for m in WRAPPED.finditer(layer):
            lines = [(m.start() + x.start(), x[0]) for x in LINE.finditer(m[0])]
            if max(len(x) for _, x in lines) >= 16:
                yield "".join(x for _, x in lines), [i for at, x in lines for i in range(at, at + len(x))], m.end(), True
    for m in BASE64.finditer(layer):
        blob = m[0].rstrip("=")
        yield blob, range(m.start(), m.start() + len(blob)), m.end(), False


def _blobs(layer: str) -> Iterator[tuple[int, int, str | bytes]]:
    """(start, end, decoded text) of the base64 blobs that hold text, or the
    compressed bytes of a blob too large to open.  A run that is not text as a whole
    is opened at each start of compressed data and in all four alignments: other
    characters of the alphabet may be glued to a blob."""
    done: list[tuple[int, int]] = []
    for blob, places, end, wrapped in _runs(layer):
        while done and done[0][1] <= places[0]:
            done.pop(0)
        if not wrapped and done and done[0][0] <= places[0]:
            continue  # a line of a blob that is text as a whole

        def span(shift: int, a: int, b: int, blob: str = blob, places: Sequence[int] = places, end: int = end) -> tuple[int, int]:
            """Where bytes a to b of the run from ``shift`` on are written."""
            last = shift - (-b * 4 // 3)
            return places[shift + a * 4 // 3], end if last >= len(blob) else places[last - 1] + 1

        raw = _bytes(blob)
        plain, used = _unpack(raw)
        text = None if plain is None else _clean(plain)
        if plain is None or text is not None:
            yield *span(0, 0, used), raw if text is None else text
            if used == len(raw):
                if wrapped:
                    done.append((places[0], end))
                continue
        for m in PACKED.finditer(blob):
            at = m.start()
            head = _bytes(blob[at : at + HEAD])
            if _breaks(head):  # chance characters, or data that ends in a fault: what precedes it is all there is
                packed, used = _unpack(head)[0], (len(blob) - at) * 3 // 4
                packed = b"" if packed == head else packed
            else:
                packed, used = _unpack(head := _bytes(blob[at:]))
            for inner in [head] if packed is None else [t for _, _, t in _stretches(packed)]:
                yield *span(at, 0, used), inner
        for shift in range(4):
            for a, b, inner in _stretches(_bytes(blob[shift:])):
                yield *span(shift, a, b), inner


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, all spans, layers opened, layers unopened) of one text."""
    base, spans, layers, closed = _scan(text or "", [MAX_PIECES])
    return base, spans, layers, len(closed)


def _kinds(raw: bytes, left: list[int]) -> set[int]:
    """The kinds found in the pieces of a large compressed blob."""
    found: set[int] = set()
    for piece in _pieces(raw):
        left[0] -= len(piece)
        if left[0] < 0 or len(found) == len(KINDS):
            break
        found.update(kind for _, _, text in _stretches(piece) for _, kind, _ in _scan(text, left)[1])
    return found


def _scan(text: str, left: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, list[tuple[int, int]]]:
    """As ``scan``, with the source spans of the unopened layers; ``left``: how
    many bytes of pieces may still be unpacked."""
    base = base_spans(text)
    spans, seen, closed = set(base), {text}, []
    work: list[tuple[str, Origin]] = [(text, None)]
    while work:
        layer, origin = work.pop()
        children: list[tuple[str, Origin]] = []
        for mark, pattern, edits in (("%", PERCENT, _percent), ("\\", ESCAPE, _escapes), ("&#", ESCAPE, _escapes), ("", COMPAT, _compat)):
            if mark in layer and pattern.search(layer):
                children.append(_rewritten(layer, origin, edits(layer)))
        for start, end, inner in _blobs(layer):
            if isinstance(inner, bytes):
                first, last = _source(origin, start, end)
                closed.append((first, last))
                spans.update((first, kind, last) for kind in _kinds(inner, left))
            else:
                children.append((inner, [_source(origin, start, end)] * len(inner)))
        for child, places in children:
            if child not in seen:
                seen.add(child)
                work.append((child, places))
                spans.update((s, kind, e) for a, kind, b in base_spans(child) for s, e in [_source(places, a, b)])
    return base, sorted(spans), len(seen) - 1, closed


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, n_layers bigint, unopened bigint"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base counts, base and all
    spans as ``kind:start:end`` lists (by start, then kind, then end), opened
    and unopened layers.  Null and empty texts have no spans; null ids and
    repeated rows are kept; other columns are ignored."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, text in rows:
                base, spans, layers, unopened = scan(text)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((doc_id, *counts, spans_text(base), spans_text(spans), layers, unopened))
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret span (any layer) and every blob too large to
    open replaced by ``mark``; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    _, spans, _, closed = _scan(text, [MAX_PIECES])
    for start, end in sorted([(start, end) for start, _, end in spans] + closed):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (any columns, among them ``text`` and ``n_chars``) with every
    secret span replaced and ``n_chars`` counted again where text changed."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            old, sizes = (batch.column(names.index(c)).to_pylist() for c in ("text", "n_chars"))
            new = [redact(t, mark) for t in old]
            sizes = [n if a == b else len(b) for a, b, n in zip(old, new, sizes, strict=True)]
            changed = {"text": new, "n_chars": sizes}
            columns = [pa.array(changed[f.name], type=f.type) if f.name in changed else batch.column(i) for i, f in enumerate(batch.schema)]
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return work

    return map_batches(docs, make)
