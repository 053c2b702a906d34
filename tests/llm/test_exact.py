"""Exact operators against brute force: Jaccard join, LZ dedup, winnowing,
syncmer fingerprints, connected components."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import common, components, jaccard_join, lz_dedup, syncmers, winnowing

from .helpers import by_id, corpus, empty, frame, sentence


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("pairs", [jaccard_join.GROUP_PAIRS, 2])
def test_jaccard_large_near_copy_group_and_chain(spark, monkeypatch, pairs):
    monkeypatch.setattr(jaccard_join, "GROUP_PAIRS", pairs)  # 2: a leader's pairs are dealt over many groups
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(150):  # every copy differs from every other in one or two words
        w = list(base)
        w[rng.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w)))
    drift = list(base[::-1])
    for i in range(40):  # a chain: neighbours link, far ends do not
        drift[i * 2] = f"c{i}"
        rows.append((1000 + i, " ".join(drift)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_jaccard_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (9, text + " tail"), (5, None), (6, "")]
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 26, 5), (5, 0, 5), (5, 26, 5), (5, 26, 5), (6, 0, 6), (9, 27, 5)]
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_keep_one_keeps_a_document_of_each_group(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute_components(rows) if d == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_prefix_filter_bound():
    for n in range(1, 200):
        need = -(-4 * n // 5)
        assert jaccard_join.prefix_length(n) == n - need + 1


def brute_dedup(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows.append((100_000, " ".join(["same"] * 60)))  # overlaps itself
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in lz_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_dedup(rows))


def test_dedup_factors_cover_what_is_removed(spark):
    for r in lz_dedup.dedup(frame(spark, corpus(3))).collect():
        covered = {i for f in r["factors"] for i in range(f["start"], f["start"] + f["words"])}
        assert len(covered) == r["n_removed"] and all(f["words"] >= 35 for f in r["factors"])
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_dedup_repeated_ids(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(1, a), (1, a), (1, b), (None, b), (2, None)]
    got = [(r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in lz_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got) == [(0, 40, 40), (1, 40, 40), (1, 40, 40), (1, 40, 40), (2, 0, 0)]
    assert lz_dedup.dedup(empty(spark)).count() == 0


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_decontaminate(rows, items):
    windows = {}
    for item, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.choice([1, 4, 9, 10, 12, 30]))) for i in range(12)] + [(40, "Zwölf ÄÖ 12 q"), (41, None), (42, "..."), (43, None)]
    items.append((99, items[3][1]))
    rows = corpus(6, 30)
    for i, (_, t) in enumerate(items[:12]):
        w = (t or "").split()
        cut = " ".join(w[2:14])  # part of an item
        rows.append((5000 + i, f"{sentence(rng, 12)}, {t.upper()}! {sentence(rng, 5)} {cut}"))
    rows.append((6000, "zwölf ÄÖ 12 Q zwölf äö 12 q"))
    got = winnowing.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()]
    assert sorted(got) == sorted(brute_decontaminate(rows, items))


def test_decontamination_guarantee(spark):
    """Any ten shared words in a row are found, wherever they are."""
    rng = random.Random(9)
    item = sentence(rng, 60).split()
    rows = [(i, " ".join([sentence(rng, rng.randint(0, 20)), *item[i : i + 10], sentence(rng, 3)])) for i in range(50)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert all(r["contaminated"] for r in winnowing.decontaminate(frame(spark, rows), items).collect())
    kept = winnowing.reject(frame(spark, [*rows, (100, "clean words only"), (101, None)]), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [100, 101]


def test_decontamination_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = [(1, "a b"), (None, "a b"), (1, "a b"), (2, None)]
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in winnowing.decontaminate(frame(spark, rows), none).collect()) == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, 0)]
    one = spark.createDataFrame([(None, "A b")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in winnowing.decontaminate(frame(spark, rows), one).collect()) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 0)]
    assert winnowing.decontaminate(empty(spark), one).count() == 0


def test_edited_texts_and_likeness(spark):
    rows = sorted(corpus(2))
    got = by_id(syncmers.edited_fingerprints(frame(spark, rows)))
    texts = [t or "" for _, t in rows]
    for i, (d, _) in enumerate(rows):
        t, follow = texts[i], texts[(i + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + follow[:n]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        if len(t.split()) >= 90:
            assert got[d]["near_edited"] > 0.3 > got[d]["near_next"] or t == follow
    prints = {}
    for d, t in rows:
        prints.setdefault(t or "", set()).add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


def test_closed_syncmers_by_definition(spark):
    text = sentence(random.Random(4), 80)
    row = spark.createDataFrame([(text,)], "t string").select(syncmers.token_hashes(common.F.col("t")).alias("h"), syncmers.anchors(common.F.col("t")).alias("a")).first()
    tokens = spark.createDataFrame([(row["h"],)], "h array<bigint>")
    s = tokens.select(common.F.transform(common.index_range(common.F.size("h") - 1), lambda i: common.gram_hash(common.F.col("h"), i, 2)).alias("s")).first()["s"]
    want = [i for i in range(len(row["h"]) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    assert [x["position"] for x in row["a"]] == want


def test_fingerprint_edge_cases(spark):
    rows = [(3, "one two"), (3, "one two"), (None, None), (4, ""), (5, "日本語の文章です日本語の文章です")]
    got = syncmers.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == 5 and {r["fingerprint"] for r in got if not r["n_chars"]} == {""}
    single = syncmers.edited_fingerprints(frame(spark, [(1, "abcdefgh")])).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert syncmers.edited_fingerprints(empty(spark)).count() == 0


def test_texts_without_a_closed_syncmer_keep_a_fingerprint(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(4, 9) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", syncmers.sketch(common.F.col("t")).alias("sk"), syncmers.anchors(common.F.col("t")).alias("a")).collect()
    assert all(r["a"] and len(r["sk"]) == len({x["hash"] for x in r["a"]}) for r in rows)
    assert len({tuple(r["sk"]) for r in rows}) == len(texts)
    got = syncmers.edited_fingerprints(frame(spark, [*enumerate(texts), (10**6, "")])).collect()
    assert all(r["fingerprint"] for r in got if r["n_chars"]) and all(r["near_next"] < 1 for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_word_hashes_follow_words_only():
    a, _, _ = common.text_words("ab  cd\nab é", lower=False)
    b, _, _ = common.text_words("é\tab cd", lower=False)
    assert a[0] == a[2] == b[1] and a[1] == b[2] and a[3] == b[0] and len({*a.tolist()}) == 3
    assert np.array_equal(common.text_words("AB É", lower=True)[0], common.text_words("ab É", lower=True)[0])
    assert len(common.gram_hashes(a, 5)) == 0


def test_very_long_texts(spark):
    """Two long texts that share their second half, and an item at the very end."""
    rng = random.Random(12)
    half = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    item = " ".join(f"q{i}" for i in range(15))
    rows = [(1, " ".join(f"a{i}" for i in range(20_000)) + " " + half), (2, " ".join(f"b{i}" for i in range(20_000)) + " " + half + " " + item)]
    docs = frame(spark, rows)
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in lz_dedup.dedup(docs).collect()}
    assert removed == {1: (40_000, 20_000), 2: (40_015, 20_000)}
    hits = by_id(winnowing.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")))
    assert (hits[1]["n_hit"], hits[2]["n_hit"], hits[2]["n_items"]) == (0, 15, 1)
    sets = by_id(jaccard_join.jaccard_components(docs))
    assert sets[1]["n_shingles"] == 39_996 and sets[2]["component_id"] == 2
    prints = by_id(syncmers.edited_fingerprints(docs))
    assert prints[1]["n_chars"] == len(rows[0][1]) and 0.2 < prints[1]["near_next"] < 0.5


def test_filters_leave_columns_of_any_name(spark):
    names = ["__id", "__hash", "kept_id", "KEPT_HASH", "hit_id", "hit_hash", "group", "row_hash", "component_id"]
    docs = frame(spark, corpus(6)).drop("row_hash", "n")
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    items = spark.createDataFrame([(1, "on the ing er est ou an zu on the x1 an")], "item_id bigint, text string")
    for out in (jaccard_join.keep_one(docs), winnowing.reject(docs, items)):
        assert out.columns == docs.columns and out.schema == docs.schema
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))]
