"""Message / call tables, answers and truncation (golden rows and brute force)."""

from pyspark.sql import functions as F

from runlens.fixtures import read_table
from runlens.operators import messages as M

from .conftest import SF_SMALL, rows


def _xml(spark, contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content string")
    out = df.select("i", M.extract_xml_calls(F.col("content")).alias("x")).orderBy("i").collect()
    return [None if r.x is None else (r.x.name, dict(zip(r.x.param_names, r.x.param_values)), r.x.mismatched)
            for r in out]


def test_xml_calls_reference_cases(spark):
    got = _xml(spark, [
        "<function=execute_bash>\n<parameter=command>ls -la</parameter>\n</function>",
        "<function=a>\n<parameter=x>1</parameter>\n</function><function=b>\n<parameter=y>2</parameter>\n</function>",
        "<function=editor>\n<parameter=text>line1\nline2</parameter>\n</function>",
        "<function=finish>\n<parameter=answer>42</parameter>",
        "<function=x>\n<parameter=a>1</parameter>\n<parameter=b>2\n</function>",
        None,
        "just text",
    ])
    assert got[0] == ("execute_bash", {"command": "ls -la"}, False)
    assert got[1] == ("a", {"x": "1"}, False)
    assert got[2] == ("editor", {"text": "line1\nline2"}, False)
    assert got[3] == ("finish", {"answer": "42"}, False)
    assert got[4] == ("x", {"a": "1"}, True)
    assert got[5] is None and got[6] is None


def test_json_commands_job(spark):
    df = spark.createDataFrame([(1, '{"analysis": "a", "plan": "p", "commands": []}'), (2, "no json")],
                               "id long, response string")
    got = {r.id: (r.error, len(r.commands)) for r in M.extract_json_commands(df, "response", ["id"]).collect()}
    assert got[1] == ("", 0) and got[2][0] == "No valid JSON found in response"


def test_answers(spark):
    df = spark.createDataFrame([('{"answer": 42}',), ('{"answer": "7"}',), ("{}",), ('{"answer": 7.9}',),
                                ('{"answer": "x"}',)], "p string")
    assert [r[0] for r in df.select(M.answers_int(F.col("p"))).collect()] == [42, 7, None, 7, None]
    files = spark.createDataFrame([("file1.py\nA/file2.py\n",)], "t string")
    assert files.select(M.answers_files(F.col("t"))).collect()[0][0] == ["file1.py", "A/file2.py"]
    lines = spark.createDataFrame([(1, "file1.py:10,12\nfile2.py:5-8\nbad\nfile3.py:1,x,3")], "k long, t string")
    got = {}
    for r in M.answers_lines(lines, "t", "k").orderBy("ord").collect():
        lst = got.setdefault(r.file, [])
        if r.line_no is not None:
            lst.append(r.line_no)
    assert got == {"file1.py": [10, 12], "file2.py": [5, 6, 7, 8], "file3.py": [1]}
    assert spark.createDataFrame([(" /tmp/result.txt ",)], "t string").select(
        M.answers_path(F.col("t"))).collect()[0][0] == "/tmp/result.txt"


def _py_chars(x, m):
    if len(x) <= m:
        return x
    h = m // 2
    return x[:h] + f"\n\n... [{len(x) - m} characters truncated] ...\n\n" + x[-h:]


def _py_bytes(x, m):
    b = x.encode("utf-8")
    if len(b) <= m:
        return x
    h = m // 2
    return (b[:h].decode("utf-8", errors="ignore") + f"\n[... {len(b) - 2 * h} bytes omitted ...]\n"
            + b[-h:].decode("utf-8", errors="ignore"))


def test_truncation_equals_python_on_whole_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    out = docs.select("text", M.truncate_middle_chars(F.col("text"), 500).alias("c"),
                      M.truncate_middle_bytes(F.col("text"), 301).alias("b"),
                      M.truncate_tokens(F.col("text"), 50).alias("t"), M.tail_chars(F.col("text"), 90).alias("tl"))
    for r in out.collect():
        assert r.c == _py_chars(r.text, 500)
        assert r.b == _py_bytes(r.text, 301)
        assert r.t == (r.text if len(r.text) <= 200 else r.text[:200] + "\n\n... [content truncated]")
        assert r.tl == r.text[-90:]


def test_tool_call_rows_shapes(spark):
    steps = spark.createDataFrame(
        [(1, 0, [("c1", "bash", '{"a": 1}', None), ("c2", None, None, ("editor", "{bad")), ("c3", "nope", "{}", None)])],
        "run_id long, step int, tool_calls array<struct<id:string,name:string,arguments:string,"
        "function:struct<name:string,arguments:string>>>")
    got = rows(M.tool_call_rows(steps, ["bash", "editor"]), "call_pos", "name", "error_obs")
    assert got == [(0, "bash", None), (1, "editor", "Error: invalid JSON arguments: {bad"),
                   (2, "nope", "Error: tool 'nope' not found.")]


def test_byte_truncation_small_budgets_and_multibyte(spark):
    vals = ["aé€😀" * 7, "😀😀😀", "€" * 5, "abc", "", "é" * 9 + "x"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    for m in (0, 1, 2, 3, 4, 5, 7, 10):
        got = [r[0] for r in df.select(M.truncate_middle_bytes(F.col("t"), m)).collect()]
        assert got == [_py_bytes(v, m) for v in vals], m


def test_line_ends_are_read_once_before_the_expansion(spark):
    df = spark.createDataFrame([(1, "a.py:3,7-9,2\nb.py:9-7\nc.py:x")], "k int, t string")
    out = M.answers_lines(df, "t", "k")
    got = [(r["file"], r["line_no"]) for r in out.orderBy("ord").collect()]
    assert [x for x in got if x[1] is not None] == [("a.py", n) for n in (3, 7, 8, 9, 2)]
    assert {f for f, n in got if n is None} >= {"b.py", "c.py"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # after the explode of the blocks nothing casts text to a number again
    assert plan[: plan.index("posexplode(transform")].count("try_cast(trim") + plan[: plan.index("posexplode(transform")].count("cast(trim") == 0
