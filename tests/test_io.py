"""Readers and writers on real files in the shared scratch folder."""

import base64
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators import hooks as H
from runlens.sources import readers as RD
from runlens.sources import writers as W
from runlens.sources.file_tree import write_file_tree

from .conftest import rows, scratch


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_scan_instances_keeps_raw_and_skips_blank(spark):
    p = scratch(spark, "t-inst/data.jsonl")
    _write(p, [json.dumps({"instance_id": "a", "repo": "x/y", "extra": {"k": 1}}), "   ",
               json.dumps({"instance_id": "b"})])
    schema = T.StructType([T.StructField("instance_id", T.StringType()), T.StructField("repo", T.StringType())])
    df = RD.scan_instances(spark, p, schema)
    got = sorted((r.instance_id, r.repo) for r in df.collect())
    assert got == [("a", "x/y"), ("b", None)]
    assert df.where("instance_id = 'a'").select(F.variant_get("raw", "$.extra.k", "int")).collect()[0][0] == 1


def test_scan_instances_bad_json_fails(spark):
    p = scratch(spark, "t-bad/data.jsonl")
    _write(p, ['{"instance_id": "a"}', "{not json"])
    schema = T.StructType([T.StructField("instance_id", T.StringType())])
    with pytest.raises(Exception):
        RD.scan_instances(spark, p, schema).collect()


def test_prediction_schema_violations(spark):
    p = scratch(spark, "t-preds/p.jsonl")
    _write(p, [json.dumps({"instance_id": "a", "model_name_or_path": "m", "model_patch": "d"}),
               json.dumps({"instance_id": "b", "model_patch": "d"}),
               json.dumps({"instance_id": "c", "model_name_or_path": "m", "model_patch": None, "x": 1}),
               json.dumps({"instance_id": "a", "model_name_or_path": "m", "model_patch": "d"})])
    v = RD.schema_violations(RD.parse_prediction_lines(spark.read.text(p)))
    got = sorted((r.kind, r.instance_id, r.detail) for r in v.collect())
    assert got == [("duplicate_id", "a", "2"), ("missing_keys", "b", "model_name_or_path"),
                   ("unexpected_keys", "c", "x")]
    with pytest.raises(Exception, match="Prediction schema violation"):
        RD.scan_predictions(spark, p).count()
    assert RD.scan_predictions(spark, p, strict=False).count() > 0


def test_progress_missing_file_and_error_key(spark):
    assert RD.scan_progress(spark, scratch(spark, "t-none/progress.jsonl")).count() == 0
    p = scratch(spark, "t-prog/progress.jsonl")
    _write(p, [json.dumps({"instance_id": "a", "status": "passed", "error": None}),
               json.dumps({"status": "passed"}),
               json.dumps({"instance_id": "b", "details": {"error": "x"}})])
    got = sorted((r.instance_id, r.has_error_key, r.details_error) for r in RD.scan_progress(spark, p).collect())
    assert got == [("a", True, None), ("b", False, "x")]


def test_task_dirs_and_files(spark):
    root = scratch(spark, "t-tasks")
    for name, toml, instr in [("ok", '[environment]\ndocker_image = "img:1"\nmemory = "4G"\n', "do it"),
                              ("noimg", "[environment]\ncpus = 2\n", "x"), ("noinstr", '[environment]\ndocker_image = "i"\n', None)]:
        os.makedirs(f"{root}/{name}/tests", exist_ok=True)
        with open(f"{root}/{name}/task.toml", "w") as f:
            f.write(toml)
        if instr is not None:
            with open(f"{root}/{name}/instruction.md", "w") as f:
                f.write(instr)
        with open(f"{root}/{name}/tests/test_a.py", "wb") as f:
            f.write(b"assert 1")
    tasks = {r.instance_id: r for r in RD.scan_task_dirs(spark, root).collect()}
    assert set(tasks) == {"ok", "noimg"}
    assert tasks["ok"].docker_image == "img:1" and tasks["ok"].memory == "4G" and tasks["ok"].error is None
    assert tasks["noimg"].error is not None
    files = RD.collect_task_files(spark, root).collect()
    assert sorted((r.key, r.content_b64) for r in files)[0] == ("/tests/test_a.py", "YXNzZXJ0IDE=")


def test_task_files_that_spark_does_not_list(spark):
    root = scratch(spark, "t-unlisted")
    tree = {"t 1/task.toml": b'[environment]\ndocker_image = "img:1"\n', "t 1/instruction.md": b"", "t 1/tests/__init__.py": b"",
            "t 1/tests/_helpers.py": b"h", "t 1/tests/.coveragerc": b"c", "t 1/tests/_data/a.txt": b"a", "t 1/tests/b.py": b"b",
            "t 1/tests/empty.txt": b"", "t 1/_hidden.sh": b"no test", "no-task/instruction.md": b"", "no-task/tests/__init__.py": b""}
    assert write_file_tree(spark.createDataFrame(list(tree.items()), "path string, content binary"), root) == len(tree)
    got = {(r.task_dir, r.key): base64.b64decode(r.content_b64) for r in RD.collect_task_files(spark, root).collect()}
    assert got == {(f"{root}/t 1", p[3:]): c for p, c in tree.items() if p.startswith("t 1/tests/")}
    (task,) = RD.scan_task_dirs(spark, root).collect()
    assert (task.instance_id, task.instruction, task.docker_image) == ("t 1", "", "img:1")
    assert RD.collect_task_files(spark, root, unlisted=False).count() == 0  # the empty instruction is not seen


def test_file_tree_is_written_under_exact_names(spark):
    root = scratch(spark, "t-tree")
    rows = [("/a/task.toml", b"x = 1"), ("a/tests/deep/b.bin", bytes(range(256))), ("c.txt", b""), ("d.txt", b"2"), ("d.txt", b"1"),
            (None, b"no path"), ("no-content", None)]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("other", F.lit(1)).repartition(3)
    for _ in range(2):  # a second run leaves the same tree
        assert write_file_tree(files, root) == 4
        found = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}
        assert found == {"a/task.toml", "a/tests/deep/b.bin", "c.txt", "d.txt"}
    for name, want in (("a/tests/deep/b.bin", bytes(range(256))), ("c.txt", b""), ("d.txt", b"1")):
        with open(f"{root}/{name}", "rb") as f:
            assert f.read() == want
    assert write_file_tree(files.limit(0), root) == 0
    with pytest.raises(Exception, match="leaves the folder"):
        write_file_tree(spark.createDataFrame([("../x", b"")], "path string, content binary"), root)


def test_id_list(spark):
    p = scratch(spark, "t-ids/ids.json")
    _write(p, [json.dumps(["b", "a", "c"])])
    assert [r.instance_id for r in RD.scan_id_list(spark, p).orderBy("pos").collect()] == ["b", "a", "c"]
    bad = scratch(spark, "t-ids-bad/ids.json")
    _write(bad, [json.dumps({"a": 1})])
    with pytest.raises(Exception):
        RD.scan_id_list(spark, bad).collect()


def test_search_payload_shapes(spark):
    df = spark.createDataFrame([
        (1, json.dumps({"results": [{"title": "t", "url": "u", "description": "d"}]})),
        (2, json.dumps({"organic": [{"title": "t2", "link": "l2", "snippet": "s"}]})),
        (3, json.dumps({"title": "solo"})), (4, "plain text"), (5, json.dumps("just a string"))],
        "query_id long, payload string")
    got = sorted((r.query_id, r.title, r.url, r.description, tuple(r.snippets))
                 for r in RD.parse_search_payloads(df).collect())
    assert got == [(1, "t", "u", "d", ()), (2, "t2", "l2", "s", ("s",)), (3, "solo", "", "", ()),
                   (4, "", "", "plain text", ())]


def test_writers_roundtrip_and_redaction(spark):
    out = scratch(spark, "t-results")
    runs = spark.createDataFrame([("r1", "a", "d", "t", True, 1.0, None, "finish"),
                                  ("r1", "b", "d", "t", None, None, "boom", None)],
                                 "run_id string, instance_id string, dataset_id string, task string, accepted boolean, "
                                 "eval_score double, error string, finish_reason string")
    W.write_results(runs, out)
    back = sorted((r.instance_id, r.score, r.finish_reason, r.success) for r in spark.read.json(out).collect())
    assert back == [("a", 1.0, "finish", True), ("b", 0.0, "", False)]
    cfg = spark.createDataFrame([("m", "k", ("t", "u", ("p", 1)), [("tok", "n")])],
                                "model string, API_KEY string, llm struct<Token:string,url:string,"
                                "inner:struct<password:string,keep:int>>, tools array<struct<token:string,name:string>>")
    red = W.redact_secrets(cfg)
    assert red.columns == ["model", "llm", "tools"]
    assert red.schema["llm"].dataType.simpleString() == "struct<url:string,inner:struct<keep:int>>"
    assert red.collect()[0].tools[0].token == "tok"


def test_run_partition_key(spark):
    df = spark.createDataFrame([("Qwen/Qwen3.5-397B A17B@x", "2026-01-02 03:04:05")], "m string, ts string")
    got = df.select(W.run_partition_key(F.col("m"), F.to_timestamp("ts"))).collect()[0][0]
    assert got == "Qwen3.5-397B_A17B_x_20260102_030405"


def test_progress_stream_writer(spark):
    from runlens.streaming import streams as ST

    base = scratch(spark, "prog-stream")
    rows = [(i, f"I-{i % 3}", "passed", True, 1.0, None) for i in range(12)]
    spark.createDataFrame(rows, "seq bigint, instance_id string, status string, accepted boolean, duration double, details struct<error:string>").write.json(f"{base}/in")
    stream = ST.read_progress_stream(spark, f"{base}/in")
    W.write_progress_stream(stream, f"{base}/out", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    back = RD.scan_progress(spark, f"{base}/out")
    assert sorted(r.seq for r in back.collect()) == list(range(12))


def test_task_files_map(spark):
    files = spark.createDataFrame([("/t/a/tests/x.py", b"1"), ("/t/a/tests/d/y.txt", b"2"), ("/t/b/tests/z", b"3"),
                                   ("/t/a/solution.sh", b"4"), ("/t/a/task.toml", b""), ("/t/a/instruction.md", b""),
                                   ("/t/b/task.toml", b""), ("/t/b/instruction.md", b""), ("/t/a/tests/s/tests/q.py", b"5"),
                                   ("/t/c/tests/no_task.py", b"6")], "path string, content binary")
    got = {r.task_dir: r.test_files for r in RD.task_files_map(RD.task_files(files)).collect()}
    assert got == {"/t/a": {"/tests/d/y.txt": "Mg==", "/tests/s/tests/q.py": "NQ==", "/tests/x.py": "MQ=="}, "/t/b": {"/tests/z": "Mw=="}}


def test_search_log_reader(spark):
    p = scratch(spark, "search-log/log.jsonl")
    _write(p, [json.dumps({"query_id": "q1", "response": json.dumps({"organic": [{"title": "t", "link": "l"}]})}),
               json.dumps({"query_id": "q2", "response": "plain text"}), ""])
    got = sorted((r.query_id, r.title, r.url, r.description) for r in RD.scan_search_log(spark, p).collect())
    assert got == [("q1", "t", "l", ""), ("q2", "", "", "plain text")]


def test_open_documents_lose_secrets_at_any_depth(spark):
    deep = '{"a":' * 400 + '{"Token":1,"b":2}' + "}" * 400
    texts = [
        '{"llm": {"a": {"b": {"c": {"PassWord": "p", "keep": 1.50, "n": 12345678901234567890}}}}, "Secret": {"x": 1}}',
        '{"list": [{"token": "stays"}, [{"secret": 1}]], "é": "\\u00e9 \\n \\"", "t": true, "api_key": null, "e": 1e5}',
        "[1]", "7", "not json", None, deep, '{"credentials": 1}', '{"a": 1, "a": 2}', "[" * 100_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, config string")
    got = [r.config for r in W.redact_secrets(df, json_columns=("config",)).orderBy("id").collect()]
    assert got == [
        '{"llm":{"a":{"b":{"c":{"keep":1.50,"n":12345678901234567890}}}}}',
        '{"list":[{"token":"stays"},[{"secret":1}]],"é":"é \\n \\"","t":true,"e":1e5}',
        "[1]", "7", None, None, deep.replace('"Token":1,', ""), "{}", '{"a":1,"a":2}', None,
    ]
    variants = df.where("id < 2").select("id", F.struct(F.parse_json("config").alias("v"), F.lit(1).alias("token")).alias("s"))
    seen = [r.v for r in W.redact_secrets(variants).select("id", F.to_json("s.v").alias("v")).orderBy("id").collect()]
    assert "PassWord" not in seen[0] and '"keep":1.5' in seen[0] and '"token":"stays"' in seen[1] and "api_key" not in seen[1]


def test_answer_rows_from_sql(spark):
    from pyspark.sql import types as T

    from runlens.operators import hooks as H

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("half", T.DoubleType())])
    H.register_row_parser("evens", schema, lambda p: [(i, i / 2) for i in range(0, int(p), 2)])
    try:
        H.register_answer_rows(spark)
    finally:
        del H.ROW_PARSERS["evens"]
    spark.createDataFrame([(1, "5"), (2, "bad"), (3, None), (4, "0")], "id int, p string").createOrReplaceTempView("given")
    got = spark.sql("SELECT id, r.* FROM given, LATERAL answer_rows('evens', p) r ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0), (1, 2, 1.0), (1, 4, 2.0)]
    files = spark.sql("""SELECT * FROM answer_rows('file_fl', '{"files": " a.py\\\\n\\\\nb.py "}')""").collect()
    assert [tuple(r) for r in files] == [(0, "a.py"), (1, "b.py")]
    with pytest.raises(Exception, match="first argument"):
        spark.sql("SELECT * FROM answer_rows('unknown', '1')").collect()


def test_answer_rows_are_not_built_frame_by_frame(spark):
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
    H.register_row_parser("mixed", kind, lambda p: [(np.int64(3), 2, "a"), (4.0, np.float64(0.5), None)] if p == "1" else [])
    try:
        H.register_answer_rows(spark)
    finally:
        del H.ROW_PARSERS["mixed"]
    df = spark.sql("SELECT id, r.* FROM range(3) g, LATERAL answer_rows('mixed', CAST(id AS STRING)) r")
    assert sorted(map(tuple, df.collect())) == [(1, 3, 2.0, "a"), (1, 4, 0.5, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_steps_carry_columns_of_their_own_record(spark):
    lines = ['{"instance_id": "I-1", "score": %s, "trajectory": [{"step": 0}, {"step": 1}]}' % x for x in ("0.25", "0.75")]
    recs = RD.parse_trajectory_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r["score"], r["pos"]) for r in RD.trajectory_steps(recs, ("score",)).collect())
    assert got == [(0.25, 0), (0.25, 1), (0.75, 0), (0.75, 1)]


def test_task_folders_are_listed_by_tasks(spark, tmp_path):
    files = {"set/t1/task.toml": b"a", "set/t1/instruction.md": b"", "set/t1/tests/a.py": b"1", "set/t1/tests/_x/.c": b"2",
             "set/t1/tests/deep/tests/e.py": b"", "t2/task.toml": b"a", "t2/instruction.md": b"b", "t2/tests/f.py": b"3",
             ".old/t3/task.toml": b"a", ".old/t3/instruction.md": b"b", ".old/t3/tests/g.py": b"4",
             "t4/task.toml": b"", "t4/instruction.md": b"b", "t4/tests/h.py": b"5"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    df = RD.collect_task_files(spark, f"file://{tmp_path}")
    # Spark's file reader would send the status of every file to the driver
    assert "binaryFile" not in df._jdf.queryExecution().executedPlan().toString()
    by_pattern = RD.collect_task_files(spark, f"file://{tmp_path}*")
    want = [(str(tmp_path / "set/t1"), f"/tests/{k}") for k in ("_x/.c", "a.py", "deep/tests/e.py")] + [(str(tmp_path / "t2"), "/tests/f.py")]
    assert rows(df, "task_dir", "key") == rows(by_pattern, "task_dir", "key") == want
    assert rows(df, "content_b64") == rows(by_pattern, "content_b64")
