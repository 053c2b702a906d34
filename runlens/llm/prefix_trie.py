"""Trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is a *head* (the first turns of another conversation)
followed by its own turns after that many.  Its texts are never put together.
Each turn is reduced to two residues e; a sequence of n turns has the product
(n, H), H = sum of e_i * B**i modulo 2**61 - 1, in the monoid

    (n, H) * (m, G) = (n + m, H + B**n * G)

so the product of a head and an own suffix follows from stored prefix products:
with s turns missing in a short head, H' = H_head + B**-s * (H_own[d] - H_own[h]).
Equal products of one length are one node of the trie.  Nothing rests on the
hash alone: all members of a node must have the same last residues (then, B
being invertible, the same parent product), and all turns with equal residues
are compared by role and text through their references (conversation, place).
If one differs, everything is done again with other bases.

Work does not depend on the depth.  Prefix products are scanned inside range
partitions of (conversation, turn), so one conversation may span many tasks;
only one row per partition takes part in the step across them.  Subtree sums
need no walk: every node is owned by its smallest member, which owns a suffix
of its own path.  So the sum below a node is the total owned by all its members
less what its owner owns above it.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import shared_table

PRIME = (1 << 61) - 1
#: tries with other bases before giving up (a new try only follows a collision)
ATTEMPTS = 4
#: conversation ids in one piece of a node's id list
PIECE = 4096
KEY = ["depth", "h1", "h2"]


def bases(attempt: int) -> tuple[int, int]:
    rng = random.Random(7919 + attempt)
    return rng.randrange(1 << 40, PRIME), rng.randrange(1 << 40, PRIME)


# ------------------------------------------------------------ residues in tasks


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of residues in uint64, by 32-bit halves."""
    low, prime = np.uint64(0xFFFFFFFF), np.uint64(PRIME)
    ah, al, bh, bl = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    middle, least = ah * bl + al * bh, al * bl
    total = (ah * bh << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (least >> np.uint64(61)) + (least & prime)
    return total % prime


class Powers:
    """B**n of arrays of n, from two tables."""

    def __init__(self, base: int) -> None:
        self.base, self.small, self.large = base, self._table(base, 1 << 12), np.ones(1, dtype=np.uint64)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out, x = np.empty(size, dtype=np.uint64), 1
        for i in range(size):
            out[i], x = x, x * base % PRIME
        return out

    def at(self, n: np.ndarray) -> np.ndarray:
        high = n >> 12
        if len(n) and int(high.max()) >= len(self.large):
            self.large = self._table(pow(self.base, 1 << 12, PRIME), 2 * int(high.max()) + 1)
        return multiply(self.small[n & 0xFFF], self.large[high])


def running(terms: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Sums modulo the prime from the start of each row's segment to the row."""
    prime = np.uint64(PRIME)
    halves = []
    for half in (terms >> np.uint64(32), terms & np.uint64(0xFFFFFFFF)):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(half, dtype=np.uint64)])
        halves.append((sums[1:] - sums[starts][segment]) % prime)
    return (multiply(halves[0], np.full(len(terms), 1 << 32, dtype=np.uint64)) + halves[1]) % prime


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


# ------------------------------------------------------------ turns and prefixes


def _turns(conversations: DataFrame, attempt: int) -> DataFrame:
    """conv_id, the order of its turns, residues and size of each text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    residue = [F.shiftrightunsigned(F.xxhash64(F.lit(f"{attempt}{side}"), role, text), 3) for side in "ab"]
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text).alias("digest"),
        residue[0].alias("e1"), residue[1].alias("e2"), F.octet_length(text).cast("long").alias("nbytes"),
    )


def prefixes(conversations: DataFrame, attempt: int = 0) -> DataFrame:
    """``conv_id, pos, h1, h2, e1, e2, nbytes`` per turn: its place from 1 in the
    order of turn (null first), role and the text's MD5, and the product of the
    turns up to it."""
    b = bases(attempt)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("e1"), F.col("e2")]
    schema = "part int, conv_id long, pos long, h1 long, h2 long, e1 long, e2 long, nbytes long"
    names = ["part", "conv_id", "pos", "h1", "h2", "e1", "e2", "nbytes"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, powers = TaskContext.get().partitionId(), [Powers(x) for x in b]
        last, done, heads = None, 0, [0, 0]  # conversation, turns and products so far
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, e1, e2, nbytes = _columns(batch, "conv_id", "e1", "e2", "nbytes")
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
            first = (segment == 0) & (conv[0] == last)
            at = np.arange(len(conv)) - starts[segment] + np.where(first, done, 0)
            hs = []
            for k, e in enumerate((e1, e2)):
                h = running(multiply(e.astype(np.uint64) % np.uint64(PRIME), powers[k].at(at)), starts, segment)
                hs.append((h + np.where(first, np.uint64(heads[k]), np.uint64(0))) % np.uint64(PRIME))
            last, done, heads = conv[-1], int(at[-1]) + 1, [int(h[-1]) for h in hs]
            out = [np.full(len(conv), part, dtype=np.int32), conv, at + 1, hs[0].astype(np.int64), hs[1].astype(np.int64), e1, e2, nbytes]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    turns = _turns(conversations, attempt).repartitionByRange(*order).sortWithinPartitions(*order)
    table = shared_table(turns.select("conv_id", "e1", "e2", "nbytes").mapInArrow(scan, schema), "trie-prefixes")
    ends = table.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "h1", "h2")).alias("last")).orderBy("part").collect()  # one row per partition
    carried, before = {}, None
    for r in ends:
        add = before[1:] if before and before[0] == r["first"] else None
        if add:
            carried[r["part"]] = (r["first"], *add)
        conv, n, *h = r["last"]
        if add and conv == r["first"]:
            n, h = n + add[0], [(add[1 + k] + pow(b[k], add[0], PRIME) * h[k]) % PRIME for k in (0, 1)]
        before = (conv, n, *h)
    if not carried:
        return table.drop("part")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, pos, h1, h2 = (x.copy() for x in _columns(batch, "part", "conv_id", "pos", "h1", "h2"))
            for p in np.unique(part):
                if int(p) in carried:
                    who, n, *head = carried[int(p)]
                    rows = (part == p) & (conv == who)
                    for k, h in enumerate((h1, h2)):
                        moved = multiply(h[rows].astype(np.uint64), np.full(int(rows.sum()), pow(b[k], n, PRIME), dtype=np.uint64))
                        h[rows] = ((moved + np.uint64(head[k])) % np.uint64(PRIME)).astype(np.int64)
                    pos[rows] += n
            rest = [batch.column(n) for n in ("e1", "e2", "nbytes")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (part, conv, pos, h1, h2)), *rest], names=names)

    return table.mapInArrow(shift, schema).drop("part")


# ------------------------------------------------------------ rebuilt conversations


def _product(a: Column, b: Column) -> Column:
    """a * b modulo the prime of two columns of residues."""
    return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def _conversations(table: DataFrame, base: Column, head: Column, max_head: int, attempt: int) -> DataFrame:
    """Per conversation: ``length`` of the rebuilt one, ``missing`` head turns,
    ``add1``, ``add2`` to the shifted own products and its head's turns."""
    turn = F.struct("pos", "h1", "h2", "e1", "e2", "nbytes")
    known = table.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= max_head, turn))).alias("start"))
    known = known.select("conv_id", "n", "start", base.cast("long").alias("base"), head.cast("int").alias("head"))
    other = known.select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"), F.col("start").alias("b_start"))
    taken = F.least(F.col("head"), F.coalesce("b_n", F.lit(0)).cast("int"))
    joined = known.join(other, F.col("base") == F.col("b_id"), "left").withColumn("taken", taken).withColumn("missing", F.col("head") - F.col("taken"))
    add = []
    for k, b in enumerate(bases(attempt), 1):
        inverse = F.array(*[F.lit(pow(b, -s, PRIME)) for s in range(max_head + 1)])
        own = F.coalesce(F.get("start", F.col("head") - 1)[f"h{k}"], F.lit(0))
        lead = F.coalesce(F.get("b_start", F.col("taken") - 1)[f"h{k}"], F.lit(0))
        add.append(F.pmod(lead - _product(own, F.get(inverse, F.col("missing"))), F.lit(PRIME)).alias(f"add{k}"))
    return joined.select(
        "conv_id", "head", "missing", *add,
        (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"),
        F.slice(F.coalesce("b_start", F.array().cast(known.schema["start"].dataType)), 1, F.col("taken")).alias("lead"),
    )


def _members(table: DataFrame, convs: DataFrame, head: Column, max_head: int, attempt: int) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included: the
    node's key, the last turn's residues and size, and if it ends there."""
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("pos"), *[zero.alias(n) for n in ("h1", "h2", "e1", "e2", "nbytes")]))
    lead = convs.select("conv_id", "length", F.explode(F.concat(root, "lead")).alias("x")).select("conv_id", "length", F.col("x.pos").alias("depth"), "x.h1", "x.h2", "x.e1", "x.e2", "x.nbytes")
    own = table.filter(F.col("pos") > head).join(convs.select("conv_id", "length", "missing", "add1", "add2"), "conv_id")
    shifted = []
    for k, b in enumerate(bases(attempt), 1):
        inverse = F.array(*[F.lit(pow(b, -s, PRIME)) for s in range(max_head + 1)])
        moved = F.when(F.col("missing") == 0, F.col(f"h{k}")).otherwise(_product(F.col(f"h{k}"), F.get(inverse, F.col("missing"))))
        shifted.append(((F.col(f"add{k}") + moved) % F.lit(PRIME)).alias(f"h{k}"))
    own = own.select("conv_id", "length", (F.col("pos") - F.col("missing")).alias("depth"), *shifted, "e1", "e2", "nbytes")
    return lead.unionByName(own).select("conv_id", *KEY, "e1", "e2", "nbytes", (F.col("depth") == F.col("length")).alias("ends"))


def _nodes(members: DataFrame, attempt: int) -> DataFrame:
    """Per node: smallest member, members, parent's products, the weight of its
    last text and whether its members differ."""
    b = bases(attempt)
    differs = (F.min("e1") != F.max("e1")) | (F.min("e2") != F.max("e2")) | (F.min("nbytes") != F.max("nbytes"))
    grouped = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("e1").alias("e1"), F.min("e2").alias("e2"),
        F.min("nbytes").alias("nbytes"), differs.alias("differs"),
    )

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, prime = [Powers(x) for x in b], np.uint64(PRIME)
        for batch in batches:
            depth, h1, h2, conv, n, e1, e2, nbytes, differ = _columns(batch, *KEY, "conv_id", "n_convs", "e1", "e2", "nbytes", "differs")
            up = []
            for k, (h, e) in enumerate(((h1, e1), (h2, e2))):
                term = multiply(e.astype(np.uint64) % prime, powers[k].at(np.maximum(depth - 1, 0)))
                up.append(((h.astype(np.uint64) + prime - term) % prime).astype(np.int64))
            out = [depth, h1, h2, conv, n, up[0], up[1], (n - 1) * nbytes, differ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*KEY, "conv_id", "n_convs", "p1", "p2", "weight", "differs"])

    return grouped.mapInArrow(parents, "depth long, h1 long, h2 long, conv_id long, n_convs long, p1 long, p2 long, weight long, differs boolean")


def turns_differ(conversations: DataFrame, table: DataFrame, attempt: int) -> DataFrame:
    """Residues shared by turns of different role or text (none: verified).
    Only residues with more than one reference are looked up again; copies are
    compared before the shuffle."""
    shared = shared_table(table.groupBy("e1", "e2").agg(F.count("*").alias("refs")).filter("refs > 1").select("e1", "e2"), "trie-shared")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    residue = [F.shiftrightunsigned(F.xxhash64(F.lit(f"{attempt}{side}"), role, text), 3).alias(f"e{k}") for k, side in enumerate("ab", 1)]
    stored = conversations.filter("conv_id IS NOT NULL").select(role.alias("role"), text.alias("text"), *residue)
    return (
        stored.join(shared, ["e1", "e2"], "left_semi")
        # the join reads two plain tables and the groups have another key than it, so that a frequent turn's rows
        # can be split in the join and are combined before the next shuffle
        .groupBy(F.struct("e1", "e2").alias("e"))
        .agg(F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1"))
        .filter("r0 <> r1 OR t0 <> t1").select("e.e1", "e.e2")
    )


# ------------------------------------------------------------ sums over the trie


def _owned_above(nodes: DataFrame) -> DataFrame:
    """KEY, ``above``: what a shared node's owner owns above it.  The owner's
    nodes are cut into range partitions; sums run inside a part, and over the
    parts of an owner, of which there are no more than partitions."""
    cut = nodes.filter("n_convs > 1").select("conv_id", *KEY, "weight").repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id())
    cut = shared_table(cut, "trie-owned")
    inside = F.coalesce(F.sum("weight").over(Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy("conv_id", "part").agg(F.sum("weight").alias("total"))
    earlier = F.coalesce(F.sum("total").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = totals.select("conv_id", "part", earlier.alias("earlier"))
    return cut.withColumn("inside", inside).join(earlier, ["conv_id", "part"]).select(*KEY, (F.col("inside") + F.col("earlier")).alias("above"))


def _end_lists(members: DataFrame) -> DataFrame:
    """KEY, ``ends_sha256`` of the nodes where a member ends.  Ids are sorted by
    range and joined into pieces; a hash is fed piece by piece, so no list is
    ever whole and the task of a hot node reads few rows."""
    order = ["h1", "h2", "depth", "conv_id"]
    key = "depth long, h1 long, h2 long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, depth, conv = _columns(batch, *order)
            edges = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (depth[1:] != depth[:-1])]) if len(conv) else np.zeros(0, dtype=bool)
            cuts = sorted({*np.flatnonzero(edges).tolist(), *range(0, len(conv), PIECE)})
            texts = [",".join(map(str, conv[a:z].tolist())) for a, z in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x[cuts]) for x in (depth, h1, h2, conv)] + [pa.array(texts, type=pa.string())], names=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, state = [*KEY, "ends_sha256"], None, hashlib.sha256()
        types = [pa.int64()] * 3 + [pa.string()]
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
                if node == now:
                    state.update(b",")
                else:
                    if now:
                        done.append([*now, state.hexdigest()])
                    now, state = node, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip([*now, state.hexdigest()], types, strict=True)], names=names)

    ends = members.filter("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ends.mapInArrow(pieces, f"{key}, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{key}, ends_sha256 string")


def trie(conversations: DataFrame, base: Column, head: Column, max_head: int) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conversations(conv_id, turn, role, text)`` are ordered by turn (null
    first; ties by role, then the text's MD5); ``base`` and ``head`` are
    expressions of ``conv_id``: conversation c becomes the first ``head``
    (0 to ``max_head``) turns of ``base`` (all if fewer, none if absent), then
    its own turns after its first ``head``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over
    its subtree, members less one times the UTF-8 bytes of the last text) and
    ``ends_sha256`` (ids of the members that end here, ascending).

    Null role or text is empty; rows without conv_id belong to no conversation;
    repeated rows are turns of their own; turnless rebuilt conversations are
    members of the root alone; an empty table has no node; other columns are
    ignored.
    """
    for attempt in range(ATTEMPTS):
        table = prefixes(conversations, attempt)
        convs = _conversations(table, base, head, max_head, attempt)
        members = shared_table(_members(table, convs, head, max_head, attempt), "trie-members")
        nodes = shared_table(_nodes(members, attempt), "trie-nodes")
        if nodes.filter("differs").isEmpty() and turns_differ(conversations, table, attempt).isEmpty():
            break
    else:
        raise RuntimeError("fingerprints of different turns met under every base")
    nodes = nodes.drop("differs")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("long")
    owners = nodes.groupBy("conv_id").agg(F.sum("weight").alias("owned"), F.sum(leaf).alias("leaves"))
    sums = members.select("conv_id", *KEY).join(owners, "conv_id").groupBy(*KEY).agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, KEY).join(_owned_above(nodes), KEY, "left").join(_end_lists(members), KEY, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            # a node of one member saves nothing below it
            F.when(F.col("n_convs") > 1, F.col("owned") - F.col("above")).otherwise(F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
