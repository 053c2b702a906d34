"""Column jobs against hand-written input / output tables and properties."""

import json
import random

from pyspark.sql import functions as F

from runlens.functions.terminal_json import object_span
from runlens.operators import messages as M
from runlens.operators import search as SR
from runlens.operators import testlogs as TL

GOOD = '{"analysis": "a", "plan": "p", "commands": [{"keystrokes": "ls\\n", "duration": 0.5}]}'
PLAIN = '{"analysis": "a", "plan": "p", "commands": []}'

# text -> (is_complete, error, warning, commands)
ANSWERS = [
    (GOOD, (False, "", "", [("ls\n", 0.5)])),
    (f"  {GOOD}\n", (False, "", "", [("ls\n", 0.5)])),
    (f"Sure. {GOOD}", (False, "", "- Extra text before JSON", [("ls\n", 0.5)])),
    (f"{GOOD} done", (False, "", "- Extra text after JSON", [("ls\n", 0.5)])),
    (f"{GOOD} {{x", (False, "", "- Extra text after JSON", [("ls\n", 0.5)])),
    (f"{GOOD}] {{x}}", (False, "", "- Extra text after JSON", [("ls\n", 0.5)])),
    (f"{PLAIN},{PLAIN}", (False, "", "- Extra text after JSON", [])),
    (PLAIN[:-1] + ', "task_complete": "Yes"}', (True, "", "", [])),
    (PLAIN[:-1] + ', "task_complete": "no"}', (False, "", "", [])),
    (PLAIN[:-1] + ', "task_complete": [0]}', (True, "", "- task_complete should be boolean or string", [])),
    (PLAIN[:-1] + ', "task_complete": null}', (False, "", "", [])),
    (PLAIN[:-1], (False, "", "- AUTO-CORRECTED: Fixed incomplete JSON", [])),
    ('{"bad"; ' + PLAIN, (False, "", "- AUTO-CORRECTED: Extracted JSON from mixed content", [])),
    ('{"plan": "p", "commands": []}', (False, "Missing required fields: analysis", "", [])),
    ('{"analysis": 1, "plan": 2, "commands": {}}', (False, "Field 'commands' must be an array", "", [])),
    ('{"analysis": 1, "plan": 2, "commands": [{"keystrokes": "a"}, {"keystrokes": "b", "duration": "2"}]}',
     (False, "", "- Command 1: missing duration, using 1.0\n- Command 2: invalid duration, using 1.0", [("a", 1.0), ("b", 1.0)])),
    ('{"analysis": 1, "plan": 2, "commands": [{"keystrokes": "a"}, "b"]}',
     (False, "Command 2 must be an object", "- Command 1: missing duration, using 1.0", [])),
    ('{"analysis": 1, "plan": 2, "commands": [{"duration": 1}], "task_complete": true}',
     (True, "", "- Command 1 missing 'keystrokes'", [])),
    ('{"analysis": 1, "plan": 2, "commands": [{"keystrokes": 5}]}', (False, "Command 1 keystrokes must be string", "", [])),
    ("no json", (False, "No valid JSON found in response", "- No valid JSON object found", [])),
    ("", (False, "No valid JSON found in response", "- No valid JSON object found", [])),
    (None, (False, "No valid JSON found in response", "- No valid JSON object found", [])),
]


def answers(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, response string")
    rows = M.extract_json_commands(df, "response", ["id"]).collect()
    return [(r.is_complete, r.error, r.warning, [(c.keystrokes, c.duration) for c in r.commands]) for r in sorted(rows, key=lambda r: r.id)]


def test_json_answers_table(spark):
    got = answers(spark, [t for t, _ in ANSWERS])
    for (text, want), r in zip(ANSWERS, got, strict=True):
        assert r == want, text


def test_invalid_json_quotes_short_content(spark):
    short, long = '{"analysis": x}', '{"analysis": x, "pad": "' + "y" * 300 + '"}'
    a, b = answers(spark, [short, long])
    assert a[1].startswith("Invalid JSON: ") and a[1].endswith(f" | Content: {short!r}")
    assert b[1].startswith("Invalid JSON: ") and "Content" not in b[1]


def test_any_wrapped_object_is_found(spark):
    rnd = random.Random(2)
    texts, keys = [], []
    for _ in range(120):
        stroke = "".join(rnd.choice('ab{}"\\\n ') for _ in range(rnd.randint(0, 9)))
        body = json.dumps({"analysis": "", "plan": "", "commands": [{"keystrokes": stroke, "duration": 2}]})
        before, after = (rnd.choice(["", "note: ", "\n "]) for _ in range(2))
        texts.append(before + body + after)
        keys.append(stroke)
        start, end = object_span(texts[-1])
        assert texts[-1][start:end] == body
    assert [r[3] for r in answers(spark, texts)] == [[(k, 2.0)] for k in keys]


def test_extract_json_commands_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, GOOD)], "id long, response string").write.parquet(path)
    plan = M.extract_json_commands(spark.read.parquet(path), "response", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


ZERO = dict.fromkeys(("passed", "failed", "errors", "skipped", "warnings", "xfailed", "xpassed", "deselected"), 0)
SUMMARIES = [
    ("", {}),
    ("no tests ran", {}),
    ("=== 3 passed, 1 failed, 2 errors in 0.1s ===", {"passed": 3, "failed": 1, "errors": 2}),
    ("1 passed\n2 failed", {"failed": 2}),
    ("1 passed\r2 failed", {"failed": 2}),
    ("1 passed\f2 failed", {"failed": 2}),
    ("1 passed\x1c2 failed end", {"failed": 2}),
    ("1 passed\r\n", {"passed": 1}),
    ("5\npassed", {}),
    ("2 passed, 3 Warnings, 1 XFAIL", {"passed": 2, "warnings": 3, "xfailed": 1}),
    ("1 passed 4 passed", {"passed": 4}),
    ("3 12 passed", {}),
    ("1 skipped, 7 deselected, 1 xpass", {"skipped": 1, "deselected": 7, "xpassed": 1}),
    ("7 deselected", {}),
]


def test_pytest_counters_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SUMMARIES)] + [(99, None)], "i int, output string")
    got = {r.i: r.c.asDict() for r in TL.add_pytest_counts(df, "output", "c").collect()}
    for i, (text, want) in enumerate(SUMMARIES):
        assert got[i] == {**ZERO, **want}, repr(text)
    assert got[99] == ZERO


IDS = [
    (None, []), ("", []), ("  ", []), ("a::b", ["a::b"]), (" t.py::a ", ["t.py::a"]), ('["a", " b ", "", null, 0, 5]', ["a", "b", "5"]),
    ("[true, false]", ["True"]), ('"one"', ["one"]), ('""', ['""']), ("5", ["5"]), ("null", ["null"]), ("{bad", ["{bad"]), ("[]", []),
]


def test_test_id_lists_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(IDS)], "i int, raw string")
    got = {r.i: r.ids for r in df.select("i", TL.parse_test_ids(F.col("raw")).alias("ids")).collect()}
    for i, (text, want) in enumerate(IDS):
        assert got[i] == want, text


WIDE_LINES = [
    ("a.py:5,99999999999,7", {"a.py": [5, 99999999999, 7]}),
    ("a.py:99999999998-100000000001", {"a.py": [99999999998, 99999999999, 100000000000, 100000000001]}),
    (f"a.py:9223372036854775806-{2**63 - 1}", {"a.py": [2**63 - 2, 2**63 - 1]}),
    ("a.py:1," + "9" * 39 + ",2", {"a.py": [1]}),
]
LINES = [
    ("a.py:1,3-5", {"a.py": [1, 3, 4, 5]}),
    ("a.py: 2 , +7 \n\n b.py:9", {"a.py": [2, 7], "b.py": [9]}),
    ("a.py:4-2", {"a.py": []}),
    ("a.py:1,x,3", {"a.py": [1]}),
    ("a.py:x", {"a.py": []}),
    ("a.py:1-2-3", {}),
    ("a:b:1", {}),
    ("nothing", {}),
    ("a.py:5\na.py:1", {"a.py": [5, 1]}),
    (None, {}),
    *WIDE_LINES,
]


def lines_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    out = [{} for _ in texts]
    rows = M.answers_lines(df, "answer", "id").orderBy("id", "ord").collect()
    for r in rows:
        numbers = out[r.id].setdefault(r.file, [])
        if r.line_no is not None:
            numbers.append(r.line_no)
    return out


def test_line_answers_table(spark):
    got = lines_of(spark, [t for t, _ in LINES])
    for (text, want), r in zip(LINES, got, strict=True):
        assert r == want, text


def test_ranges_of_any_width_are_exact(spark, monkeypatch):
    texts = ["a.py:3-99999999999,5", f"b.py:{10**37}-{10**37 + 5}", "c.py:5,1-3,4,9-12,11-20,30-2", "d.py:9-7", "e.py:x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    ranges = {(r.file, int(r.lo), int(r.hi)) for r in M.answers_line_ranges(df, "answer", "id").where("lo IS NOT NULL").collect()}
    assert {("a.py", 3, 99999999999), ("b.py", 10**37, 10**37 + 5), ("d.py", 9, 7)} <= ranges
    sets = sorted((r.file, r.lo and int(r.lo), r.hi and int(r.hi)) for r in M.answers_line_sets(df, "answer", "id").collect())
    assert sets == [("a.py", 3, 99999999999), ("b.py", 10**37, 10**37 + 5), ("c.py", 1, 5), ("c.py", 9, 20), ("d.py", None, None), ("e.py", None, None)]
    beyond = [r for r in M.answers_lines(df.where("id = 1"), "answer", "id").collect() if r.unexpanded]
    assert [(r.line_no, r.unexpanded) for r in beyond] == [(None, f"{10**37}-{10**37 + 5}")]
    wide = spark.createDataFrame([(1, "a.py:7-3000006")], "id int, answer string")
    assert M.answers_lines(wide, "answer", "id").selectExpr("count(line_no)", "min(line_no)", "max(line_no)", "count(DISTINCT ord)").first()[:3] == (3_000_000, 7, 3_000_006)
    monkeypatch.setattr(M, "_SPAN", 4)  # spans of every level
    rows = M.answers_lines(spark.createDataFrame([(1, "a.py:10-60,3,5-5")], "id int, answer string"), "answer", "id").where("line_no IS NOT NULL").orderBy("ord")
    assert [r.line_no for r in rows.collect()] == [*range(10, 61), 3, 5]


INTS = [
    ('{"answer": 9007199254740993}', 9007199254740993), ('{"answer": 9223372036854775807}', 9223372036854775807),
    ('{"answer": 92233720368547758070}', None), ('{"answer": "9007199254740993"}', 9007199254740993), ('{"answer": 7.9}', 7),
    ('{"answer": -7.9}', -7), ('{"answer": 1e3}', 1000), ('{"answer": true}', 1), ('{"answer": " 5 "}', 5), ('{"answer": "x"}', None),
    ('{"answer": null}', None), ('{"answer": [1]}', None), ("{}", None), ("bad", None), (None, None),
]


def test_integer_answers_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(INTS)], "i int, p string")
    got = {r.i: r.a for r in df.select("i", M.answers_int(F.col("p")).alias("a")).collect()}
    for i, (text, want) in enumerate(INTS):
        assert got[i] == want, text


def test_secrets_below_map_values_go(spark):
    from runlens.sources import writers as W

    df = spark.createDataFrame([({"a": {"api_key": "s", "b": "1"}, "token": {"x": "y"}},)], "c map<string,map<string,string>>")
    assert W.redact_secrets(df).first().c == {"a": {"b": "1"}}


XML = [
    (None, None), ("", None), ("plain", None),
    ("<function=bash>\n<parameter=cmd> ls </parameter></function>", ("bash", {"cmd": "ls"}, False)),
    ("x <function= a ><parameter=k>v</parameter><parameter=k>w</parameter></function> y", ("a", {"k": "w"}, False)),
    ("<function=a><parameter=k>v</parameter>", ("a", {"k": "v"}, False)),
    ("<function=a><parameter=k>v</parameter></", ("a", {"k": "v"}, False)),
    ("<function=a><parameter=k>v</function>", ("a", {}, True)),
    ("<function=a></function><function=b></function>", ("a", {}, False)),
    ("<function=a><function=b>", None),
]


def test_xml_calls_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(XML)], "i int, c string")
    rows = df.select("i", M.extract_xml_calls(F.col("c")).alias("x")).collect()
    got = {r.i: None if r.x is None else (r.x.name, dict(zip(r.x.param_names, r.x.param_values, strict=True)), r.x.mismatched) for r in rows}
    for i, (text, want) in enumerate(XML):
        assert got[i] == want, text


PAGES = [
    (("", "", "", []), ""),
    (("", "d", "", [("a", "/1")]), ""),
    (("T", "", "", []), "# T\n"),
    (("T", "desc", "body", []), "# T\n\n> desc\n\nbody"),
    (("T", "bod", "body", []), "# T\n\nbody"),
    (("", "tail", "x" * 250 + "tail", []), "> tail\n\n" + "x" * 250 + "tail"),
    (("", "", "c", [("a", "/1"), ("b", "/2"), ("a", "/3")]), "c\n\n## Links\n- [a](/3)\n- [b](/2)"),
]


def test_page_markdown_table(spark):
    rows = [(i, t, d, c, [a for a, _ in links], [h for _, h in links]) for i, ((t, d, c, links), _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "i int, title string, description string, content string, link_text array<string>, link_href array<string>")
    got = {r.i: r.markdown for r in SR.page_markdown(df).collect()}
    for i, (page, want) in enumerate(PAGES):
        assert got[i] == want, page
