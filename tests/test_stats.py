"""Run statistics, windows and running totals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import runstats as RS
from runlens.operators import steps as ST

from .conftest import rows


def test_run_stats_golden(spark):
    calls = spark.createDataFrame([(1, 0, 100, 50, 1.5, 0.8), (1, 1, 200, 100, 2.0, 0.1)],
                                  "run_id long, step int, prompt_tokens long, completion_tokens long, "
                                  "llm_elapsed double, tool_elapsed double")
    r = RS.run_stats(calls).collect()[0]
    assert (r.llm_calls, r.total_prompt_tokens, r.total_completion_tokens, r.llm_time) == (2, 300, 150, 3.5)
    assert r.tool_time == 0.9


def test_tool_usage_splits_step_time(spark):
    steps = spark.createDataFrame([(1, ["bash", "editor"], 0.8), (1, ["bash"], 0.1)],
                                  "run_id long, tools array<string>, tool_elapsed double")
    got = rows(RS.tool_usage(steps, tools="tools"), "tool_name", "n", "tool_time")
    assert got == [("bash", 2, 0.5), ("editor", 1, 0.4)]


def test_condense_keeps_head_and_tail(spark):
    msgs = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(3)], "conv_id long, turn long")
    got = rows(ST.condense_messages(msgs, 5, 2))
    assert [t for c, t in got if c == 1] == [0, 1, 7, 8, 9]
    assert [t for c, t in got if c == 2] == [0, 1, 2]


def test_running_totals_block_boundaries_match_window(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("g"),
                                     (F.col("id") % 3 == 0).cast("int").alias("x"))
    got = RS.running_totals(df, "seq", {"c": F.col("x")}, ("g",), block_size=37)
    w = Window.partitionBy("g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("c", F.sum("x").over(w))
    assert rows(got, "g", "seq", "c") == rows(exp, "g", "seq", "c")
    glob = RS.running_totals(df, "seq", {"c": F.col("x")}, (), block_size=101)
    w2 = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(glob, "seq", "c") == rows(df.withColumn("c", F.sum("x").over(w2)), "seq", "c")


def test_best_attempt(spark):
    att = spark.createDataFrame(
        [("a", 1, False, "e1"), ("a", 2, True, None), ("b", 1, False, "e1"), ("b", 2, False, "e2"),
         ("b", 3, False, "e3"), ("b", 4, True, None), ("c", 5, True, None)],
        "instance_id string, seq long, returned boolean, error string")
    got = rows(RS.best_attempt(att, 3), "instance_id", "returned", "attempts_used", "last_error")
    assert got == [("a", True, 2, None), ("b", False, 3, "e3"), ("c", True, 1, None)]


def test_task_stats_doc2repo_and_others(spark):
    res = spark.createDataFrame([("Doc2Repo", 1.0, "finish"), ("doc2repo", 0.9, "error"), ("doc2repo", 0.5, "x"),
                                 ("crossrepo", 1.0, "finish"), ("crossrepo", 0.0, "error"), ("", 1.0, "finish")],
                                "task string, score double, finish_reason string")
    got = {r.task: r for r in RS.task_stats(res).collect()}
    d = got["doc2repo"]
    assert (d.total, d.avg_pass_rate, d.almost_correct_num, d.correct_num, d.error_count) == (3, 0.8, 2, 1, 1)
    assert d.correct_rate == 0.3333 and d.solved is None
    c = got["crossrepo"]
    assert (c.solved, c.solved_rate, c.error_count, c.avg_pass_rate) == (1, 0.5, 1, None)
    o = RS.overall_stats(res).collect()[0]
    assert (o.total, o.solved, o.solved_rate) == (6, 3, 0.5)


def test_run_outcome_priorities(spark):
    cols = ("run_id long, step int, prompt_tokens long, completion_tokens long, action_type string, "
            "n_tool_calls int, finish_status string, error string")
    steps = spark.createDataFrame([
        (1, 0, 10, 1, "tool_call", 1, None, None), (1, 1, 10, 1, "finish", 1, None, None),
        (2, 0, 900, 200, "tool_call", 1, None, None), (2, 1, 10, 1, "finish", 1, None, None),
        (3, 0, 10, 1, "tool_call", 1, None, "boom"),
        (4, 0, 10, 1, "tool_call", 1, "length", None),
        (5, 0, 10, 1, "tool_call", 1, None, None), (5, 1, 10, 1, "tool_call", 1, None, None),
        (6, 0, 10, 1, "tool_call", 1, None, None),
    ], cols)
    got = {r.run_id: (r.finish_reason, r.steps) for r in ST.run_outcome(steps, 2, 1000).collect()}
    assert got == {1: ("finish", 2), 2: ("context_length", 1), 3: ("error", 1), 4: ("context_length", 1),
                   5: ("max_steps", 2), 6: ("incomplete", 1)}


def test_confirm_complete_needs_two_parsed_completes(spark):
    steps = spark.createDataFrame([(1, 0, True, True), (1, 1, False, False), (1, 2, True, True),
                                   (2, 0, True, True), (2, 1, True, False), (2, 2, True, True)],
                                  "run_id long, step int, parse_ok boolean, is_complete boolean")
    assert dict(rows(ST.confirm_complete(steps))) == {1: 2, 2: None}


def test_analysis_report_one_pass_equals_separate_jobs(spark):
    res = spark.createDataFrame([("Doc2Repo", 1.0, "finish"), ("doc2repo", 0.9, "error"), ("", 1.0, "finish"),
                                 (None, 0.0, "error"), ("crossrepo", 1.0, "finish")],
                                "task string, score double, finish_reason string")
    rep = {r.task: r.asDict() for r in RS.analysis_report(res).collect()}
    sep = {r.task: r.asDict() for r in RS.task_stats(res).collect()}
    o = RS.overall_stats(res).collect()[0]
    assert {k: v for k, v in rep.items() if k != "overall"} == sep
    assert (rep["overall"]["total"], rep["overall"]["solved"], rep["overall"]["solved_rate"]) == (o.total, o.solved,
                                                                                               o.solved_rate)


def test_tool_usage_wide_pivot(spark):
    usage = spark.createDataFrame([(1, "bash", 2), (1, "editor", 1), (2, "bash", 3)],
                                  "run_id long, tool_name string, n long")
    got = {r.run_id: (r.bash, r.editor, r.finish) for r in
           RS.tool_usage_wide(usage, ["bash", "editor", "finish"]).collect()}
    assert got == {1: (2, 1, 0), 2: (3, 0, 0)}
