"""Quality rules by line frequency against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runlens.llm import line_rules

from .helpers import SCHEMA, corpus, empty, sentence

WORD = r"[^\x20\x09-\x0D]+"


def norm(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line)).strip(" ")


def brute(rows, line_docs=line_rules.LINE_DOCS):
    """rows of (doc_id, text, host)"""
    texts = {(h, t or "") for _, t, h in rows}
    docs, hosts = {}, {}
    for h, t in texts:
        hosts[h] = hosts.get(h, 0) + 1
        for k in {norm(x) for x in t.split("\n") if re.search(WORD, x)}:
            docs[h, k] = docs.get((h, k), 0) + 1
    out = []
    for d, t, h in rows:
        t = t or ""
        w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
        gone = [x for x in lines if docs[h, norm(x)] > line_docs and 100 * docs[h, norm(x)] > line_rules.LINE_SHARE * hosts[h]]
        left = len(w) - sum(len(re.findall(WORD, x)) for x in gone)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        symbols = sum(t.count(c) for c in "#*$%&|<>")
        out.append((d, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(rep), failed, not failed and 100 * left >= 30 * len(w), len(gone), left))
    return out


def docs_of(spark, rows):
    full = [(d, t, "en", h, 0, "clash", 1) for d, t, h in rows]
    return spark.createDataFrame(full, SCHEMA + ", host string, line bigint").repartition(5)


def sorted_rows(rows):
    return sorted((tuple((x is not None, x) for x in r) for r in rows), key=str)


def cases(seed):
    rng = random.Random(seed)
    menu = [f"Menu {sentence(rng, 12)}" for _ in range(6)]
    rows = [(d, t, rng.choice(["a", "b"])) for d, t in corpus(seed)]
    for i in range(40):  # one host's template with digits and spacing of its own, some with an own body
        lines = [f"  {m.upper()}  {10 + i}" for m in menu] + ([sentence(rng, 60), ""] if i % 2 else ["", "tail # <b>"])
        rng.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines), "hot"))
    rows += [(2000 + i, "\n".join([*menu, sentence(rng, 8)]), "cold") for i in range(5)]  # same lines, under the limit
    rows += [(3000 + i, "exact copy " + sentence(random.Random(1), 80), "hot") for i in range(30)]
    rows += [(4000, "a b c " * 40, "a"), (4001, "one word 日本 🙂" * 30, None), (4002, None, None), (4002, None, None), (None, "x\n\nx\n \nX", "a")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_judge_equals_brute_force(spark, seed):
    rows = cases(seed)
    got = [tuple(r) for r in line_rules.judge(docs_of(spark, rows)).collect()]
    assert sorted_rows(got) == sorted_rows(brute(rows))
    by = {r[0]: r for r in got}
    assert not by[1000][7] and by[1000][8] >= 6 and by[1001][7]  # depleted; the body stays
    assert by[2000][8] == 0 and by[3000][7]  # rare on its host; copies alone are one document
    shuffled = line_rules.judge(docs_of(spark, rows), broadcast_lines=0)
    assert sorted_rows(tuple(r) for r in shuffled.collect()) == sorted_rows(got)


def test_clean_removes_the_lines_and_the_depleted(spark):
    rows = cases(3)
    docs = docs_of(spark, rows).withColumn("kept_hash", F.lit("mine"))
    out = line_rules.clean(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in brute(rows) if r[7]}
    for d, t, _ in rows:
        if d in got:
            want = "\n".join(x for x in t.split("\n") if not (1000 <= d < 1040 and norm(x).startswith("menu")))
            assert got[d]["text"] == want and got[d]["kept_hash"] == "mine"


def test_long_text_and_empty_table(spark):
    rng = random.Random(7)
    long = "\n".join(sentence(rng, 30) for _ in range(800)) + "\n" + "same words here " * 300
    rows = [(1, long, "a"), (1, "short", "a")]
    got = {r["n_words"]: r for r in line_rules.judge(docs_of(spark, rows)).collect()}
    assert set(got) == {24900, 1} and got[24900]["n_repeat_words"] >= 900
    assert line_rules.judge(empty(spark)).count() == 0 and line_rules.clean(empty(spark)).count() == 0
