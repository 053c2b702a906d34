"""Constraint tables: the literal index finds what trying every rule finds."""

import io
import random
import re
from contextlib import redirect_stdout

from runlens.operators import constraints as CN

RULES = [r".*github\.com/[^/]+/django(/|$|\?).*", r"https?://m\.", "(unclosed", r".*(abcd|efgh)ijkl", "th", r".* on .*", "a{0,3}mirror", "(?:kelvin)+x?",
         r"^straße.*ende$", "", None, r".*MIRROR\.org", "[k-s]+ite", r"(?i:Foo)bars", r"x*?yes+", ".*\\", r".*ſite"]


def brute(value, pattern):
    try:
        return bool(re.match(pattern, value, re.IGNORECASE))
    except (re.error, TypeError):
        return False


def test_required_runs_are_in_every_match():
    assert CN.required_runs(r".*github\.com/[^/]+/dj(ango)+(/|$|\?).*") == ["github.com/", "/dj", "ango"]
    assert CN.required_runs("a|bcde") == [] and CN.required_runs("(ab)?cd*e{2}") == ["c", "e"]
    assert CN.rule_grams("(unclosed") is None and CN.rule_grams(None) is None and CN.rule_grams("abc") == [""]


def test_table_rules_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["https://", "http://m.", "github.com/", "GitHub.com/x/", "Django", "/?", "abcdIJKL", "efghijkl", "mirror", "Mırror.ORG", "ſite", "Kelvinx", " on ", "straße", "ende", "foobarS", "yes", "\n"]
    hits = [(i, f"s{i % 4}" if i % 9 else None, rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 4)))]), "".join(rng.choices(bits, k=2)), i) for i in range(200)]
    rules = [(rng.choice([None, "s0", "s1", "s2"]), rng.choice(["url", "title", "body", "n", None]), p) for p in RULES * 4]
    df = spark.createDataFrame(hits, "hit bigint, scope string, url string, title string, n bigint").repartition(4)
    table = spark.createDataFrame(rules, "scope_id string, field string, pattern string")
    got = {r["hit"]: r["blocked"] for r in CN.filter_hits_by_rules(df, table, ["hit"], "scope").collect()}
    want = {}
    for hit, scope, url, title, _ in hits:
        fields = {"url": url or "", "title": title or "", "body": ""}
        want[hit] = any(f in fields and (s is None or s == scope) and brute(fields[f], p) for s, f, p in rules)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_many_rules_meet_few_hits(spark):
    rules = spark.range(100_000).selectExpr("CAST(NULL AS STRING) AS scope_id", "'url' AS field", r"concat('.*example\\.com/page', id, '(/|$)') AS pattern")
    hits = spark.range(300).selectExpr("id AS hit", "concat('https://Example.com/page', id * 1000, if(id % 2 = 0, '/x', 'x')) AS url")
    out = CN.filter_hits_by_rules(hits, rules, ["hit"])
    plan = io.StringIO()
    with redirect_stdout(plan):
        out.explain()
    assert "NestedLoop" not in plan.getvalue() and "Cartesian" not in plan.getvalue()
    assert {r["hit"] for r in out.where("blocked").collect()} == {i for i in range(300) if i % 2 == 0 and i * 1000 < 100_000}
    empty = spark.createDataFrame([], "scope_id string, field string, pattern string")
    assert CN.filter_hits_by_rules(hits, empty, ["hit"]).where("blocked").count() == 0


def test_rules_without_a_gram_meet_values_in_blocks(spark):
    hits = spark.range(1500).selectExpr("id AS hit", "concat('v', id % 700, 'é', id % 13) AS url")
    rules = spark.range(300).selectExpr("CAST(NULL AS STRING) AS scope_id", "'url' AS field", "concat('.*', id, 'é7$') AS pattern")
    got = {r["hit"] for r in CN.filter_hits_by_rules(hits, rules, ["hit"]).where("blocked").collect()}
    assert got == {i for i in range(1500) if i % 13 == 7 and any(str(i % 700).endswith(str(r)) for r in range(300))}
    grams = hits.selectExpr("struct(hit) AS _hit", "'url' AS _field", "url AS _value", "'' AS _gram")
    keyed = rules.selectExpr("field AS _field", "pattern", "'' AS run", "1500L AS _n", "'' AS _gram")
    blocks = CN._blocks(grams, keyed).selectExpr("_block", "size(hits) AS v", "size(patterns) AS r").collect()
    assert sum(b["v"] * b["r"] for b in blocks) == 1500 * 300
    assert len({b["_block"] for b in blocks}) == 3 and max(b["v"] for b in blocks) < 700 and max(b["r"] for b in blocks) < 200
