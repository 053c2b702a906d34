"""Benchmark decontamination by winnowing (DataFrame functions only).

A text's words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
A-Z is lower-cased.  Every run of ``SPAN`` = 10 item words is a window.  Both
sides keep, per window, the smallest hash of its ``GRAM``-word grams (the last
one on a tie).  Equal windows keep the same gram at the same place, so joining
the kept grams finds every occurrence of every window: the guarantee of
winnowing.  Joined grams only give a window start; the hit is then extended to
the whole window and compared there.  Items of 1 to 9 words are one window of
their own length, looked up as whole grams.

The benchmark's fingerprints are broadcast only after their number has been
checked (``broadcast_rows``); a larger benchmark takes the shuffled join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import free_names, gram_hash, index_range, let, shared_table

#: everything between words; A-Z is inside words and folded afterwards
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = 10
GRAM = 5
#: item windows / document hits up to these numbers are sent to every task
BROADCAST_ROWS = 200_000
BROADCAST_HITS = 1_000_000
_POS_BITS = 31
_POS_MASK = (1 << _POS_BITS) - 1


def words(text: Column) -> Column:
    """The words of a text, their case unchanged; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _folded(word: Column) -> Column:
    """A-Z lower-cased.  ``lower`` does just that for words of ASCII letters;
    the slower ``translate`` is for words with others."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(_folded(w)))


def _ranked_grams(h: Column) -> Column:
    """Per gram: 32 bits of its hash, then its position counted down, so that
    the smallest value is the smallest hash, the last one on a tie."""
    return F.transform(
        index_range(F.size(h) - F.lit(GRAM - 1)),
        lambda i: F.shiftleft(F.shiftrightunsigned(gram_hash(h, i, GRAM), 32), _POS_BITS)
        .bitwiseOR(F.lit(_POS_MASK).cast("long") - i.cast("long")),
    )


def _smallest(v: Column, i: Column) -> Column:
    return F.least(*[F.get(v, i + F.lit(j)) for j in range(SPAN - GRAM + 1)])


def kept_grams(text: Column) -> Column:
    """Winnowed fingerprint of a text: the distinct kept grams, as ranked values."""
    return let(
        _word_hashes(text),
        lambda h: let(
            _ranked_grams(h),
            lambda v: F.array_distinct(F.transform(index_range(F.size(h) - F.lit(SPAN - 1)), lambda i: _smallest(v, i))),
        ),
    )


def gram_of(ranked: Column) -> Column:
    return F.shiftright(ranked, _POS_BITS)


def position_of(ranked: Column) -> Column:
    return (F.lit(_POS_MASK).cast("long") - ranked.bitwiseAND(F.lit(_POS_MASK).cast("long"))).cast("int")


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, len, window, gram, offset``: one row per window of an item;
    ``window`` hashes its words, ``gram`` is its kept gram, ``offset`` words
    into the window.  Short items have no gram."""
    h = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), _word_hashes(F.col(text)).alias("h"))
    long_windows = let(
        _ranked_grams(F.col("h")),
        lambda v: F.transform(
            index_range(F.size("h") - F.lit(SPAN - 1)),
            lambda i: F.struct(
                F.lit(SPAN).alias("len"),
                gram_hash(F.col("h"), i, SPAN).alias("window"),
                gram_of(_smallest(v, i)).alias("gram"),
                (position_of(_smallest(v, i)) - i).alias("offset"),
            ),
        ),
    )
    short = F.array(
        F.struct(
            F.size("h").alias("len"),
            F.xxhash64(F.col("h")).alias("window"),
            F.lit(None).cast("long").alias("gram"),
            F.lit(None).cast("int").alias("offset"),
        )
    )
    both = F.when(F.size("h") >= SPAN, long_windows).when(F.size("h") > 0, short)
    return h.select("item", F.explode_outer(both).alias("w")).select("item", "w.*").filter("window IS NOT NULL").distinct()


def _all_grams(n: int) -> Callable[[Column], Column]:
    """Every ``n``-word gram of a word-hash array, with its start."""
    return lambda h: F.transform(index_range(F.size(h) - F.lit(n - 1)), lambda i: F.struct(i.alias("start"), gram_hash(h, i, n).alias("window")))


def find_windows(docs: DataFrame, windows: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, row_hash, start, len, window``: every occurrence of every
    item window in ``docs(doc_id, row_hash, text)``."""
    windows = windows.cache()
    try:
        lengths = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most ten rows
    finally:
        windows.unpersist()
    small = sum(lengths.values()) <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)
    key = ["doc_id", "row_hash"]
    found = None
    if SPAN in lengths:
        wanted = windows.filter(F.col("len") == SPAN).select("gram", "offset", "window").distinct()
        kept = docs.select(*key, F.explode_outer(kept_grams(F.col("text"))).alias("ranked"))
        hits = (
            kept.select(*key, gram_of(F.col("ranked")).alias("gram"), position_of(F.col("ranked")).alias("at"))
            .join(side(wanted), "gram")
            .select(*key, (F.col("at") - F.col("offset")).alias("start"), "window")
            .filter("start >= 0")
            .groupBy(*key).agg(F.collect_set(F.struct("start", "window")).alias("hits"))
        )
        # written, so that its size is known: few hits are sent to the texts, many are shuffled with them
        hits = shared_table(hits, "hits")
        few = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_HITS
        # the hit is extended to the whole window and compared there
        extended = let(
            _word_hashes(F.col("text")),
            lambda h: F.filter(F.col("hits"), lambda x: (x["start"] + SPAN <= F.size(h)) & (gram_hash(h, x["start"], SPAN) == x["window"])),
        )
        found = (
            docs.join(F.broadcast(hits) if few else hits, key)
            .select(*key, F.explode_outer(extended).alias("x")).filter("x IS NOT NULL")
            .select(*key, "x.start", F.lit(SPAN).alias("len"), "x.window")
        )
    for n in sorted(set(lengths) - {SPAN}):
        wanted = windows.filter(F.col("len") == n).select("window").distinct()
        grams = let(_word_hashes(F.col("text")), _all_grams(n))
        part = (
            docs.select(*key, F.explode_outer(grams).alias("x")).select(*key, "x.start", F.lit(n).alias("len"), "x.window")
            .join(side(wanted), "window").select(*key, "start", "len", "window")
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(*key, F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("window")).limit(0)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_words``, ``n_hit`` (words inside
    any occurrence of a window of ``items(item_id, text)``), ``n_items`` and
    ``items_sha256`` of the items that occur, ``contaminated``, and
    ``hit_spans``, the (start, length) word windows found.

    Null and empty texts have no words and no hits; rows that repeat each get
    their own row back, rows with one doc_id and different texts are judged by
    their own text; a null doc_id is a value like others; null item ids count
    as the empty name; an empty benchmark hits nothing.  Other columns of the
    inputs are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text"))
    windows = item_windows(items, "item_id", "text")
    found = find_windows(_with_id(rows), windows, broadcast_rows=broadcast_rows).distinct()
    names = windows.select("len", "window", "item").distinct()
    per_doc = (
        found.join(names, ["len", "window"])
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
        .select(
            F.col("doc_id").alias("h_id"),
            F.col("row_hash").alias("h_hash"),
            F.array_sort("spans").alias("hit_spans"),
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long").alias("hit"),
            F.size("items").cast("long").alias("n"),
            F.concat_ws(",", "items").alias("list"),
        )
    )
    counted = _with_id(docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words")))
    return (
        counted.join(per_doc, (F.col("doc_id") == F.col("h_id")) & (F.col("row_hash") == F.col("h_hash")), "left")
        .select(
            F.col("doc_id.v").alias("doc_id"),
            "n_words",
            F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
            F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
            F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
            "hit_spans",
        )
    )


def reject(docs: DataFrame, items: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` (any columns, among them ``doc_id`` and ``text``)
    without any word of a window of ``items(item_id, text)``."""
    rows = _with_id(docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text"))
    found = find_windows(rows, item_windows(items, "item_id", "text"), broadcast_rows=broadcast_rows)
    id_name, hash_name = free_names(docs.columns, "hit_id", "hit_hash")
    found = found.select(F.col("doc_id").alias(id_name), F.col("row_hash").alias(hash_name)).distinct()
    return docs.join(found, (F.struct(docs["doc_id"].alias("v")) == F.col(id_name)) & (F.xxhash64(docs["text"]) == F.col(hash_name)), "left_anti")


def _with_id(rows: DataFrame) -> DataFrame:
    """doc_id as a one-field struct: never null itself, so joins on it keep
    rows whose id is null."""
    return rows.withColumn("doc_id", F.struct(F.col("doc_id").alias("v")))
