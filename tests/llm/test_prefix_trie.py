"""Conversation trie against rebuilt texts, in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, e1 int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        b = c - int(np.fmod(c, 5))
        rebuilt[c] = tuple(own.get(b, [])[:h] + own[c][h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, m in nodes.items():
        w = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + w
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(6)
    out = trie(df)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def trie(df):
    return prefix_trie.trie(df, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8)


def conversations(seed, n=60, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue  # absent bases too
        for t in range(rng.choice([1, 1, 2, 4, 7, 9, 12, 20])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None, ""]), rng.choice(["é日", "hi", None, "x" * 9][:alphabet])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert got(spark, rows) == brute(rows)


def test_copies_one_long_conversation_repeats_and_odd_ids(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(6)]  # a large group of copies
    rows += [(200, t, "user", f"long {t % 7}") for t in range(1500)] + [(201, t, "user", f"long {t % 7}") for t in range(1500)]  # over many partitions
    rows += [(300, 1, "user", "a"), (300, 1, "user", "a"), (300, 1, "user", "b"), (None, 1, "user", "lost"), (-7, 0, "user", "neg"), (-5, 0, "user", "neg"), (-5, 1, None, None)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_a_collision_is_found_and_tried_again(spark, monkeypatch):
    rows = conversations(5)
    real = prefix_trie._turns

    def colliding(conv, attempt):
        out = real(conv, attempt)
        return out.withColumns({"e1": F.lit(5).cast("long"), "e2": F.lit(6).cast("long")}) if attempt == 0 else out

    monkeypatch.setattr(prefix_trie, "_turns", colliding)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in trie(df).collect()), key=str) == brute(rows)


def test_turns_of_equal_residues_are_compared(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    table = prefix_trie.prefixes(df)
    assert prefix_trie.turns_differ(df, table, 0).isEmpty()
    other = df.withColumn("role", F.when(F.col("conv_id") == 2, "tool").otherwise(F.col("role")))
    both = table.select("e1", "e2").union(prefix_trie.prefixes(other).select("e1", "e2"))
    assert prefix_trie.turns_differ(other, both, 0).isEmpty()  # no two texts under one residue


def test_residue_arithmetic():
    rng = random.Random(1)
    a, b = ([0, 1, prefix_trie.PRIME - 1, *(rng.randrange(prefix_trie.PRIME) for _ in range(500))] for _ in range(2))
    rng.shuffle(b)
    want = [x * y % prefix_trie.PRIME for x, y in zip(a, b, strict=True)]
    assert prefix_trie.multiply(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)).tolist() == want
    powers = prefix_trie.Powers(123456789012345)
    n = np.array([0, 1, 4095, 4096, 70000, 12345678])
    assert powers.at(n).tolist() == [pow(123456789012345, int(x), prefix_trie.PRIME) for x in n]


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op11_conversation_trie"](spark, sf).collect()), key=str) == brute(rows)
