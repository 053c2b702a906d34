"""Pytest summaries, gates, JUnit parsing/matching, test ids, rewards."""

from pyspark.sql import functions as F

from runlens.operators import testlogs as TL

from .conftest import rows


def _counts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, output string")
    return [r.c for r in sorted(TL.add_pytest_counts(df, "output", "c").collect(), key=lambda r: r.id)]


def test_summary_gate_cases(spark):
    df = spark.createDataFrame([("===== 5 passed in 1.23s =====", 5), ("===== 5 passed in 1.23s =====", 6),
                                ("===== 3 passed, 1 failed in 2.00s =====", 3), ("no tests ran", 1)],
                               "output string, n int")
    df = TL.add_pytest_counts(df)
    got = [r[0] for r in df.select(TL.suite_all_passed(F.col("counts"), F.col("n"))).collect()]
    assert got == [True, False, False, False]


def test_last_summary_line_and_labels(spark):
    c = _counts(spark, ["1 passed\nstuff\n== 2 passed, 1 failed, 3 errors, 4 skipped, 1 warning in 3s ==",
                        "5 passed 7 Passed", "nothing here", None, "10 xfailed, 2 xpass, 1 deselected"])
    assert (c[0].passed, c[0].failed, c[0].errors, c[0].skipped, c[0].warnings) == (2, 1, 3, 4, 1)
    assert c[1].passed == 7  # a repeated label keeps the last value
    assert c[2].passed == 0 and c[3].passed == 0
    assert (c[4].xfailed, c[4].xpassed, c[4].deselected) == (10, 2, 1)


def test_f2p_p2p_gate(spark):
    df = spark.createDataFrame([("1 passed", "1 passed", 1, 1), ("1 failed", "1 passed", 1, 1),
                                ("", "1 passed", 0, 1), ("", "", 0, 0)],
                               "f string, p string, nf int, np int")
    df = TL.add_pytest_counts(TL.add_pytest_counts(df, "f", "cf"), "p", "cp")
    g = [r.g for r in df.select(TL.f2p_p2p_gate(F.col("cf"), F.col("cp"), F.col("nf"), F.col("np")).alias("g"))
         .collect()]
    assert [x.accepted for x in g] == [True, False, True, False]
    assert g[3].reason == "no_test_ids"


JUNIT_EXACT = ('<testsuite><testcase name="test_one" classname="tests.test_foo" file="tests/test_foo.py"/>'
               '<testcase name="test_two" classname="tests.test_foo" file="tests/test_foo.py"/></testsuite>')
JUNIT_NORM = '<testsuite><testcase name="test_thing" classname="tests.test_bar"/></testsuite>'
JUNIT_FAIL = ('<testsuite><testcase name="test_one" classname="tests.test_foo" file="tests/test_foo.py">'
              '<failure message="assert">trace</failure></testcase></testsuite>')
JUNIT_SKIP = ('<testsuites><testsuite><testcase name="test_one" classname="tests.test_foo" file="tests/test_foo.py"/>'
              '<testcase name="test_skip" classname="tests.test_foo" file="tests/test_foo.py"><skipped/></testcase>'
              '</testsuite></testsuites>')


def _coverage(spark, docs, expected):
    d = spark.createDataFrame([(run, 0, x) for run, x in docs], "run_id long, doc_pos int, xml string")
    e = spark.createDataFrame([(run, i, t) for run, ids in expected for i, t in enumerate(ids)],
                              "run_id long, pos int, test_id string")
    cases = TL.junit_cases(d)
    return {r.run_id: r for r in TL.expected_test_coverage(cases, e).collect()}


def test_junit_reference_cases(spark):
    cov = _coverage(spark, [(1, JUNIT_EXACT), (2, JUNIT_NORM), (3, JUNIT_FAIL), (4, JUNIT_SKIP),
                            (5, "not xml at all")],
                    [(1, ["tests/test_foo.py::test_one", "tests/test_foo.py::test_two"]),
                     (2, ["tests/test_bar.py::test_thing"]), (3, ["tests/test_foo.py::test_one"]),
                     (4, ["tests/test_foo.py::test_one"]), (5, ["tests/test_foo.py::test_one"])])
    assert cov[1].all_passed and cov[1].total_matched == 2
    assert cov[2].all_passed and cov[2].total_matched == 1
    assert not cov[3].all_passed
    assert cov[4].all_passed
    assert not cov[5].all_passed and cov[5].unmatched == 1


def test_match_priorities_and_last_wins(spark):
    d = spark.createDataFrame([(1, 0, '<testsuite><testcase name="t a" classname="pkg.mod"/>'
                                      '<testcase name="t a" classname="pkg.mod"><error/></testcase></testsuite>')],
                              "run_id long, doc_pos int, xml string")
    e = spark.createDataFrame([(1, 0, "pkg/mod.py::t  a"), (1, 1, "pkg/mod.py::ta")],
                              "run_id long, pos int, test_id string")
    got = rows(TL.match_test_cases(TL.junit_cases(d), e), "expected_id", "status")
    # both spellings share one fingerprint: the later expected id owns it; the later case decides
    assert got == [("pkg/mod.py::ta", "failed")]


def test_parse_test_ids_forms(spark):
    df = spark.createDataFrame([('["a::x", "", " b "]',), ('"single"',), ("bare::id",), ("",), (None,), ("  ",)],
                               "raw string")
    got = [r[0] for r in df.select(TL.parse_test_ids(F.col("raw"))).collect()]
    assert got == [["a::x", "b"], ["single"], ["bare::id"], [], [], []]


def test_normalize_forms(spark):
    df = spark.createDataFrame([("tests/test_foo.py::TestClass::test_method",)], "t string")
    r = df.select(TL.normalize_test_id(F.col("t")), TL.match_form(F.col("t"))).collect()[0]
    assert r[0] == "tests.test_foo.py.TestClass.test_method"
    assert r[1] == "tests.test_foo.TestClass.test_method"


def test_reward_coalesce(spark):
    df = spark.createDataFrame([(" 0.5 ", None, False), ("", '{"reward": 1}', False), (None, '{"x": 1}', False),
                                ("abc", "{bad", False), ("1", None, True), (None, '{"reward": null}', False)],
                               "txt string, js string, timed_out boolean")
    got = [tuple(r.r) for r in df.select(TL.reward_coalesce(F.col("txt"), F.col("js"), F.col("timed_out"))
                                         .alias("r")).collect()]
    assert got == [(0.5, "reward.txt", True), (1.0, "reward.json", True), (0.0, "reward.json", False),
                   (0.0, "none", False), (0.0, "timeout", False), (0.0, "none", False)]


def test_malformed_documents_are_counted_by_observe(spark):
    from pyspark.sql import Observation

    d = spark.createDataFrame([(1, 0, JUNIT_EXACT), (2, 0, "not xml"), (3, 0, "<oops")],
                              "run_id long, doc_pos int, xml string")
    obs = Observation("junit")
    TL.junit_cases(d, observation=obs).collect()
    assert obs.get == {"rows": 3, "malformed": 2}


def test_parse_test_id_array_list_form(spark):
    df = spark.createDataFrame([([" a ", "", None, "b"],), ([],)], "ids array<string>")
    assert [r[0] for r in df.select(TL.parse_test_id_array(F.col("ids"))).collect()] == [["a", "b"], []]


def test_all_expected_tests_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([('["a", "b"]', '["b"]'), ("", "c"), (None, None)], "f string, p string")
    got = [r[0] for r in df.select(TL.all_expected_tests(F.col("f"), F.col("p"))).collect()]
    assert got == [["a", "b", "b"], ["c"], []]


def test_coverage_parses_each_document_once(spark):
    docs = spark.createDataFrame([(1, 0, "<testsuite/>")], "run_id long, doc_pos int, xml string")
    expected = spark.createDataFrame([(1, 0, "a::b")], "run_id long, pos int, test_id string")
    plan = TL.expected_test_coverage(TL.junit_cases(docs), expected)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") == 1


def test_a_case_is_dealt_once(spark):
    docs = spark.createDataFrame([(1, 0, JUNIT_EXACT), (1, 1, JUNIT_NORM)], "run_id long, doc_pos int, xml string")
    expected = spark.createDataFrame([(1, 0, "tests/test_foo.py::test_one"), (1, 1, "tests.test_bar.test_thing")],
                                     "run_id long, pos int, test_id string")
    seen = []

    def written(plan):
        if plan.nodeName() == "Exchange":
            seen.append(plan.metrics().apply("shuffleRecordsWritten").value())
        children = [plan.plan()] if plan.nodeName().startswith("ShuffleQueryStage") else [
            plan.children().apply(i) for i in range(plan.children().size())]
        for child in children:
            written(child)

    df = TL.match_test_cases(TL.junit_cases(docs), expected)
    assert len(df.collect()) == 2
    written(df._jdf.queryExecution().executedPlan().finalPhysicalPlan())
    # three cases, two ids, and what they become; not four spellings of each
    assert seen and max(seen) <= 3


def test_spellings_with_other_fingerprints(spark):
    xml = ('<testsuite><testcase name="pytest_x" classname="a.b" file="other/f.py"/>'
           '<testcase name="t" classname="c.d" file="e/g.py"/><testcase name="u v" classname="h.i"/></testsuite>')
    docs = spark.createDataFrame([(1, 0, xml)], "run_id long, doc_pos int, xml string")
    ids = ["a/b.py::pytest_x", "other/f.py::pytest_x", "c/d.py::t", "h.i.u v", "h/i.u  v", "h.i.uv", "h/i.uv"]
    expected = spark.createDataFrame([(1, i, t) for i, t in enumerate(ids)], "run_id long, pos int, test_id string")
    # a file spelling goes before the class as a path; the last id of a form or fingerprint owns it
    assert rows(TL.match_test_cases(TL.junit_cases(docs), expected), "expected_id") == [
        ("c/d.py::t",), ("h.i.u v",), ("other/f.py::pytest_x",)]
    cov = TL.expected_test_coverage(TL.junit_cases(docs), expected).first()
    assert (cov.total_expected, cov.total_matched, cov.unmatched, cov.all_passed) == (7, 3, 4, False)
