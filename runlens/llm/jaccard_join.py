"""Exact Jaccard join of documents on word shingles, and its components.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z is lower-cased; a document's
set holds its distinct 5-word shingles (a shorter text is one shingle, a text
without words has none).  Two documents link at similarity 4/5 or more,
decided in whole numbers.

1. Shingles get one global rare-first order: their hash bucket's rank by count
   over all documents, then the hash (a bijection, so a total order).
2. Equal sets become one class with one representative.
3. Prefix filter: sets that link share a shingle among their first
   ``n - ceil(4n/5) + 1``.  Prefix shingles of representatives are the join key.
4. Every shingle's holder with the most support (how often its prefix shingles
   are held by others: the original of a group of edited copies has the most)
   is its leader; pairs (holder, leader) are verified first.  They are linear in
   the prefixes, and tie large groups of near copies together.  Where much is
   left across components, the leaders of the largest components are tried again
   by the holders outside them.
5. What may still link is pairs of *different* components that share a prefix
   shingle.  They are found from shingles with holders in several components,
   joining only holders outside the shingle's largest component, under the
   length, positional and suffix filters.  Pairs tried before are left out, so
   a pair is verified once.  No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import collected, free_names, gram_hashes, map_rows, mix64, shared_table, text_words
from runlens.llm.components import components

SHINGLE = 5
#: size of the count table behind the rare-first order; fixed, so it is small
#: at every corpus size
BUCKET_BITS = 20
_LOW = np.uint64(64 - BUCKET_BITS)
_LOW_MASK = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
#: representatives whose texts are looked up by a broadcast of their ids
BROADCAST_IDS = 100_000
#: rounds of step 4 at most (they end when one finds no link), and the joined rows per entry under which step 5
#: takes over; neither changes the result
LEADER_ROUNDS = 4
JOIN_ROWS = 4
#: pairs of one node that are verified together on average; more are dealt over several groups
GROUP_PAIRS = 64
#: classes of the suffix filter's bound
PARTS = 16


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    h, _, _ = text_words(text, lower=True)
    if len(h) == 0:
        return np.zeros(0, dtype=np.uint64)
    if len(h) < SHINGLE:
        return gram_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(gram_hashes(h, SHINGLE))


def bucket_ranks(docs: DataFrame) -> np.ndarray:
    """Rank by document count of every hash bucket, over all documents.  Tasks
    count, Spark sums; the driver gets at most 2**BUCKET_BITS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    np.add.at(total, (shingle_set(text) >> _LOW).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    # few large tasks: each emits up to one row per bucket
    spark = docs.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 8)
    sums = docs.select("text").coalesce(tasks).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    got = collected(sums)
    total[got["bucket"]] = got["n"]
    ranks = np.empty(1 << BUCKET_BITS, dtype=np.uint32)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.uint32)
    return ranks


def ordered_set(text: str | None, ranks: np.ndarray) -> np.ndarray:
    """The set as keys whose numeric order is the global rare-first order."""
    return _ordered(shingle_set(text), ranks)


def _ordered(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return np.sort((ranks[(s >> _LOW).astype(np.int64)].astype(np.uint64) << _LOW) | (s & _LOW_MASK))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two ordered sets, with the suffix filter before the merge."""
    n, m = len(a), len(b)
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    need = -(-4 * (n + m) // 9)  # smallest overlap of a link
    if _distance_bound(a, b, 2) > n + m - 2 * need:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, m - 1)] == a).sum())
    return 5 * both >= 4 * (n + m - both)


def _distance_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """Lower bound of the symmetric difference: split both at one key."""
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    return _distance_bound(a[:i], b[:j], depth - 1) + _distance_bound(a[i:], b[j:], depth - 1)


def signature(s: np.ndarray) -> list[int]:
    """128 bits that stand for a whole set, as two numbers."""
    return _signed(np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(k))) for k in (1, 2)], dtype=np.uint64)) if len(s) else [0, 0]


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


SET_SCHEMA = "doc_id bigint, row_hash bigint, n bigint, sig1 bigint, sig2 bigint, prefix array<bigint>, parts array<int>"


def document_sets(docs: DataFrame, ranks: Broadcast) -> DataFrame:
    def make() -> Callable[[list[tuple]], list[tuple]]:
        order = ranks.value

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for doc_id, row_hash, text in rows:
                raw = shingle_set(text)
                s, sig = _ordered(raw, order), signature(raw)
                parts = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                out.append((doc_id, row_hash, len(s), *sig, _signed(s[: prefix_length(len(s))]) if len(s) else [], parts.tolist()))
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    return map_rows(rows, make, SET_SCHEMA)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, ranks: Broadcast) -> DataFrame:
    """The pairs(a, b) that link.  Texts are looked up for their nodes only."""
    pairs = shared_table(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = shared_table(reps.select("node", "doc_id", "row_hash").join(nodes, "node"), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    wanted = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("row_hash").alias("w_hash"))
    texts = (
        docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
        .join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_hash") == F.col("w_hash")))
        .select("node", "text").dropDuplicates(["node"])
    )
    # a node with many pairs is dealt over several groups; its text goes to each group once, ahead of the others
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("groups")).filter("groups > 1")
    dealt = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("groups", F.lit(1))).alias("part"))
    own = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    others = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
    grouped = own.unionByName(others).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def make() -> Callable[[list[tuple]], list[tuple]]:
        order = ranks.value
        head: list = [None]  # the set of the group's own node

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for b, a, text in rows:
                s = ordered_set(text, order)
                if a is None:
                    head[0] = s
                elif links(s, head[0]):
                    out.append((a, b))
            return out

        return work

    return shared_table(map_rows(grouped.select("b", "a", "text"), make, "a bigint, b bigint"), "links")


def _may_link(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Length and suffix filters on pairs(a, b): the sets' sizes, and the sum of
    size differences over a fixed partition of the shingles, which is a lower
    bound of the sets' symmetric difference."""
    side = reps.select("node", "n", "parts")
    named = (
        pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa")), "a")
        .join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb")), "b")
    )
    apart = F.lit(0)
    for i in range(PARTS):
        apart = apart + F.abs(F.col("pa")[i] - F.col("pb")[i])
    need = F.ceil(4 * (F.col("na") + F.col("nb")) / 9)
    return named.filter((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (apart <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b")


def _mixed(entries: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Entries with their component, and the shingles whose holders are in
    several components: the largest one (``main``), its size, its holder with
    the most support (``leader``), and the number of holders."""
    if groups is None:
        tagged = entries.withColumn("component", F.col("node"))
    else:
        tagged = shared_table(
            entries.join(groups, "node", "left").select(*entries.columns, F.coalesce("component", "node").alias("component")), "tagged"
        )
    mixed = (
        tagged.groupBy("shingle", "component").agg(F.count("*").alias("size"), F.max(F.struct("support", "node")).alias("top"))
        .groupBy("shingle")
        .agg(F.count("*").alias("groups"), F.sum("size").alias("holders"), F.max(F.struct("size", "top.support", "component", "top.node")).alias("main"))
        .filter("groups > 1")
        .select("shingle", "holders", F.col("main.component").alias("main"), F.col("main.size").alias("main_size"), F.col("main.node").alias("leader"))
    )
    return tagged, shared_table(mixed, "mixed")


def _across(tagged: DataFrame, mixed: DataFrame, first: DataFrame, tried: DataFrame) -> DataFrame:
    """All pairs(a, b) of different components that share a prefix shingle and
    pass the length and positional filters, without the tried ones.  ``first``
    has the shingles' first leaders: a leader was tried with every holder of
    its shingle, so it takes no part there."""
    rest = (
        tagged.join(mixed.select("shingle", "main"), "shingle")
        .join(first.select("shingle", F.col("leader").alias("first")), "shingle").filter("node <> first").drop("first")
    )
    x = rest.filter("component <> main").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "at", "component")])
    y = rest.select("shingle", "main", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "at", "component")])
    need = F.ceil(4 * (F.col("x_n") + F.col("y_n")) / 9)
    return (
        x.join(y, "shingle")
        .filter(
            (F.col("x_component") != F.col("y_component"))
            & ((F.col("y_component") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
            & (5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n"))
            & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= need)  # positional filter
        )
        .select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text)``,
    with ``row_hash`` (of the text) and ``group`` (one number per component,
    null for an empty set).

    Null texts and texts without words have an empty set and stay alone, even
    among themselves.  Repeated rows and rows with one id are documents of
    their own; a component's id is its smallest doc_id (null if it has none but
    null).  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(bucket_ranks(docs))  # 2**BUCKET_BITS numbers
    sets = shared_table(document_sets(docs, ranks), "sets")
    key = ["n", "sig1", "sig2"]
    reps = shared_table(
        sets.filter("n > 0")
        .groupBy(*key)
        .agg(
            F.min(F.struct("doc_id", "row_hash")).alias("of"),
            F.min("doc_id").alias("least_id"),
            F.first("prefix").alias("prefix"),
            F.first("parts").alias("parts"),
        )
        .select(F.monotonically_increasing_id().alias("node"), *key, "of.doc_id", "of.row_hash", "least_id", "prefix", "parts"),
        "classes",
    )
    # counted with a map-side part and joined back: a shingle that very many hold is never one task's
    entries = reps.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    held = entries.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    entries = shared_table(entries.join(held, "shingle"), "holders")
    support = entries.groupBy("node").agg(F.sum("holders").alias("support"))
    entries = shared_table(entries.join(support, "node").drop("holders"), "entries")
    size = entries.count()

    first = tried = found = groups = None
    for step in range(LEADER_ROUNDS + 1):
        tagged, mixed = _mixed(entries, groups)
        first = mixed if first is None else first
        left = mixed.agg(F.sum(F.col("holders") * (F.col("holders") - F.col("main_size")))).first()[0] or 0
        if step == LEADER_ROUNDS or step and left <= JOIN_ROWS * size:
            break
        pairs = (
            tagged.join(mixed, "shingle").filter("component <> main")
            .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = shared_table(_may_link(pairs, reps), "leaders")
        linked = _verified(pairs, reps, docs, ranks)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found is not None and linked.isEmpty():
            break  # components, and so the next leaders, stay as they are
        found = linked if found is None else found.unionByName(linked)
        groups = components(found)

    more = _verified(_may_link(_across(tagged, mixed, first, tried), reps), reps, docs, ranks)
    if not more.isEmpty():
        groups = components(found.unionByName(more))

    named = reps.join(groups, "node", "left").select(*key, "least_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = named.join(smallest, "component").select(*key, "component_id", F.col("component").alias("group"))
    return (
        sets.select("doc_id", "row_hash", *key).join(classes, key, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            "row_hash",
            "group",
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document per component: the one with the smallest doc_id (of rows
    with that id, the smallest text hash).  Documents with an empty set stay;
    equal rows become one.  ``docs`` has any columns, among them ``doc_id`` and
    ``text``."""
    id_name, hash_name = free_names(docs.columns, "kept_id", "kept_hash")
    found = jaccard_components(docs.select("doc_id", "text"))
    node = [F.struct(F.col("doc_id").alias("v")).alias(id_name), F.col("row_hash").alias(hash_name)]
    kept = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(*node)).alias("k")).select("k.*")
    alone = found.filter("group IS NULL").select(*node).distinct()
    keyed = docs.withColumn(id_name, F.struct(F.col("doc_id").cast("long").alias("v"))).withColumn(hash_name, F.xxhash64("text"))
    once = keyed.dropDuplicates([id_name, hash_name])
    return once.join(kept.unionByName(alone), [id_name, hash_name], "left_semi").select(*docs.columns)
