"""Repo leak rules: equi-join rewrite vs the regex rules, fixed rule lists."""

import random
import re

from pyspark.sql import functions as F

from runlens.operators import leaks as L

from .conftest import rows

DJANGO_TABLE = [
    ("https://github.com/django/django/pull/42", True),
    ("https://GITHUB.COM/Django/Django/issues", True),
    ("https://gitlab.com/django/django/issues/1", True),
    ("https://github.com/django/django-extensions", False),
    ("https://docs.djangoproject.com/en/5.0/", False),
    ("https://stackoverflow.com/questions/django", False),
    ("https://raw.githubusercontent.com/x/django/main/README", True),
]


def _leak(spark, repo, urls):
    inst = spark.createDataFrame([("i", repo)], "instance_id string, repo string")
    hits = spark.createDataFrame([("i", n, u) for n, u in enumerate(urls)], "instance_id string, hit_id long, url string")
    return [r.blocked for r in sorted(L.repo_leak_join(hits, inst).collect(), key=lambda r: r.hit_id)]


def test_decision_table(spark):
    assert _leak(spark, "django/django", [u for u, _ in DJANGO_TABLE]) == [b for _, b in DJANGO_TABLE]


def test_special_characters_are_literal(spark):
    got = _leak(spark, "owner/my.repo+plus", ["https://github.com/owner/my.repo+plus/issues",
                                              "https://github.com/owner/myXrepo+plus/issues"])
    assert got == [True, False]


def test_equi_join_equals_regex_rules(spark):
    """Property check: the join rewrite agrees with the generated regexes
    (Python re.match, IGNORECASE) on random URLs and repos."""
    rnd = random.Random(7)
    parts = ["github.com", "gitlab.com", "raw.githubusercontent.com", "GitHub.com", "x.org", "github.io"]
    names = ["django", "Django", "flask", "my.repo", "dj", "django-ext", ""]
    urls = []
    for _ in range(400):
        segs = [rnd.choice(names + ["a", "b"]) for _ in range(rnd.randint(0, 4))]
        tail = rnd.choice(["", "/", "?x=1", "#f", "/pull/1"])
        urls.append("https://" + rnd.choice(parts) + "/" + "/".join(segs) + tail)
    for repo in ["django/django", "flask", "a/my.repo", "/dj"]:
        got = _leak(spark, repo, urls)
        inst = spark.createDataFrame([("i", repo)], "instance_id string, repo string")
        pats = [r.pattern for r in L.repo_rules(inst).where(F.col("kind") == "url").orderBy("ord").collect()]
        exp = [any(re.match(p, u, re.IGNORECASE) for p in pats) for u in urls]
        assert got == exp, repo


def test_multi_field_rules_and_invalid_pattern(spark):
    hits = spark.createDataFrame([("https://ok.com", "SECRET doc"), ("https://blocked.com/page", "Fine"),
                                  ("https://ok.com", "Fine")], "url string, title string")
    got = [r.blocked for r in L.filter_hits(hits, {"url": [r".*blocked\.com.*", "[invalid"],
                                                   "title": [r".*SECRET.*"]}).collect()]
    assert got == [True, True, False]


def test_commands_case_sensitive_first_line_only(spark):
    calls = spark.createDataFrame([("git log --all",), ("cd x\ngit fetch",), ("GIT PULL",), ("git status",)],
                                  "command string")
    got = [r.blocked for r in L.block_commands_fixed(calls, L.ALWAYS_BLOCKED).collect()]
    assert got == [True, False, False, False]


def test_effective_blocklist_modes(spark):
    inst = spark.createDataFrame([("a", True, "django/django"), ("b", False, "")],
                                 "instance_id string, search boolean, repo string")
    bl = L.effective_blocklist(inst, extra=[r".*git pull.*", r".*rm -rf.*"])
    by = {}
    for r in bl.orderBy("instance_id", "ord").collect():
        by.setdefault(r.instance_id, []).append(r.pattern)
    assert by["a"][:6] == L.ALWAYS_BLOCKED and r".*git clone.*" not in by["a"]
    assert by["a"][6] == r".*rm -rf.*" and len(by["a"]) == 12
    assert by["b"] == L.ALWAYS_BLOCKED + L.NON_SEARCH_BLOCKED + [r".*rm -rf.*"]


def test_merge_dedupes_left_first(spark):
    left = spark.createDataFrame([("s", "url", 0, "a")], "scope_id string, field string, ord int, pattern string")
    right = spark.createDataFrame([("s", "url", 0, "a"), ("s", "url", 1, "b"), ("s", "title", 0, "t")],
                                  "scope_id string, field string, ord int, pattern string")
    got = rows(L.merge_constraints(left, right), "field", "ord", "pattern")
    assert got == [("title", 0, "t"), ("url", 0, "a"), ("url", 1, "b")]


def test_patch_artefacts(spark):
    patch = "\n".join(f"diff --git a/{p} b/{p}" for p in
                      ["src/a.py", "build/x.o", "node_modules/m.js", "img/i.png", "target/A.class", "lib/x.js"])
    df = spark.createDataFrame([("i", patch, "TypeScript ")], "instance_id string, patch string, language string")
    got = dict(rows(L.patch_files(df), "file", "is_artefact"))
    assert got == {"src/a.py": False, "build/x.o": True, "node_modules/m.js": True, "img/i.png": True,
                   "target/A.class": False, "lib/x.js": True}


def test_search_block_formatting(spark):
    from runlens.operators import search as SR

    inst = spark.createDataFrame([("i", "django/django")], "instance_id string, repo string")
    url_rules = [r.pattern for r in L.repo_rules(inst).where(F.col("kind") == "url").collect()]
    hits = spark.createDataFrame([(1, 1, "Repo PR", "https://github.com/django/django/pull/1"),
                                  (1, 2, "SO Answer", "https://stackoverflow.com/q/123"),
                                  (2, 1, "x", "https://github.com/django/django")],
                                 "query_id long, position long, title string, url string")
    flagged = L.filter_hits(hits, {"url": url_rules})
    queries = spark.createDataFrame([(1, "django bug"), (2, "only blocked"), (3, "   ")], "query_id long, query string")
    text = {r.query_id: r.text for r in SR.format_hits(flagged, queries).collect()}
    assert set(text) == {1, 2}
    assert "SO Answer" in text[1] and "Repo PR" not in text[1] and "1 result(s) filtered" in text[1]
    assert text[1].startswith("Search results for: django bug\nWARNING") and "[1]\n  title: SO Answer" in text[1]
    assert text[2].endswith("No results found.")


def test_blocklist_modes_on_commands(spark):
    inst = spark.createDataFrame([("s", True, ""), ("n", False, ""), ("x", False, "")],
                                 "instance_id string, search boolean, repo string")
    bl = L.effective_blocklist(inst, extra=[r".*forbidden.*"]).where(
        (F.col("instance_id") != "x") | (F.col("pattern") != ".*forbidden.*"))
    calls = spark.createDataFrame([(i, c) for i in ("s", "n") for c in
                                   ("git clone https://github.com/test/repo", "git log --all", "forbidden command")],
                                  "instance_id string, command string")
    got = {(r.instance_id, r.command): r.blocked for r in L.block_commands(calls, bl).collect()}
    assert got[("s", "git clone https://github.com/test/repo")] is False
    assert got[("n", "git clone https://github.com/test/repo")] is True
    assert got[("s", "git log --all")] and got[("n", "forbidden command")]


def test_blocked_counts(spark):
    hits = spark.createDataFrame([(1, True), (1, False), (2, False)], "query_id long, blocked boolean")
    assert sorted(tuple(r) for r in L.blocked_counts(hits).collect()) == [(1, 1, 1), (2, 1, 0)]
