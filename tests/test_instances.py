"""Instance shaping, routing and sizes (reference golden cases)."""

from pyspark.sql import functions as F

from runlens.operators import instances as I


def test_scale_mapping_and_setup_commands(spark):
    raw = spark.createDataFrame([
        ("auth0__auth0-python-001", "auth0", "auth0-python", "abc123def456", "reg/auth0-python:latest", "/testbed",
         "cd /testbed && git checkout abc123def456\\n"),
        ("fastapi__fastapi-002", "", "fastapi", None, "reg/fastapi:latest", None, "   "),
    ], "instance_id string, user string, repo string, parent_commit string, image_url string, workdir string, "
       "pre_commands string")
    got = {r.instance_id: r for r in I.shape_instances_scale(raw).collect()}
    a = got["auth0__auth0-python-001"]
    assert (a.base_commit, a.image, a.repo, a.workdir) == ("abc123def456", "reg/auth0-python:latest",
                                                           "auth0/auth0-python", "/testbed")
    assert a.setup_commands == ["cd /testbed && git checkout abc123def456"]
    b = got["fastapi__fastapi-002"]
    assert (b.base_commit, b.repo, b.workdir, b.setup_commands) == ("", "fastapi", "/testbed", [])


def test_multi_mapping_types_and_commit_chain(spark):
    raw = spark.createDataFrame([("a", "Doc2Repo", "", "p1"), ("b", "Cross-Repo", None, "p2"),
                                 ("c", "dep_migrate", "c3", None), ("d", "refactor", None, None), ("e", None, "", "")],
                                "instance_id string, task string, base_commit string, parent_commit string")
    got = {r.instance_id: (r.task_type, r.base_commit, r.workdir) for r in I.shape_instances_multi(raw).collect()}
    assert got == {"a": ("doc2repo", "p1", "/workspace"), "b": ("crossrepo", "p2", "/workspace"),
                   "c": ("depmigrate", "c3", "/workspace"), "d": ("domainfix", "", "/workspace"),
                   "e": ("domainfix", "", "/workspace")}


def test_routes(spark):
    ctx = spark.createDataFrame([("beyond_swe", "doc2repo", False), ("beyond_swe", "domainfix", True),
                                 ("unknown_dataset", None, False), ("scale_swe", None, False),
                                 ("scale_swe", "doc2repo", True)],
                                "dataset_id string, task_type string, search boolean")
    got = [(r.system_key, r.user_key) for r in I.route_prompt(ctx).collect()]
    assert sorted(got) == sorted([("beyondswe", "doc2repo"), ("search_domainfix", "search_domainfix"),
                                  ("beyondswe", "domainfix"), ("openhands", "scaleswe"), ("beyondswe", "domainfix")])


def test_size_parsing_and_limits(spark):
    vals = ["2G", "512M", "4Gi", "512Mi", "4GB", "512MB", "2048K", "1500KB", "1.5G", "", "abc", "10", "-5K", "7.9"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(I.parse_size_mb(F.col("s"))).collect()]
    assert got == [2048, 512, 4096, 512, 4000, 512, 2, 1, 1536, 0, 0, 10, 0, 7]
    toml = spark.createDataFrame([("4G", None, None), (None, 1024, 2), (None, None, None)],
                                 "memory string, memory_mb long, cpus long")
    lim = [(r.cpu, r.memory_limit) for r in I.resource_limits(toml).collect()]
    assert lim == [("1", "4096Mi"), ("2", "1024Mi"), ("1", "2048Mi")]


def test_prompt_rendering_does_not_reexpand_values(spark):
    templates = spark.createDataFrame([("k", "Fix {problem_statement} in {workspace_dir} {{literal}}"),
                                       ("bad", "uses {unknown}")], "user_key string, template string")
    rows = spark.createDataFrame([("k", "a {workspace_dir} b", "/w"), ("bad", "x", "/w")],
                                 "user_key string, ps string, wd string")
    out = {r.user_key: (r.prompt, r.render_error) for r in I.render_prompt(
        rows, templates, {"problem_statement": F.col("ps"), "workspace_dir": F.col("wd")}).collect()}
    assert out["k"] == ("Fix a {workspace_dir} b in /w {literal}", None)
    assert out["bad"] == (None, "{unknown}")


def test_id_filters(spark):
    inst = spark.createDataFrame([("Django-1",), ("flask-2",)], "instance_id string")
    ids = spark.createDataFrame([("django-1",), ("x",)], "instance_id string")
    assert [r[0] for r in I.filter_ids_ci(inst, ids).collect()] == ["Django-1"]
    lst = spark.createDataFrame([(0, "b"), (1, "a"), (2, "B")], "pos int, instance_id string")
    want = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    assert [r.instance_id for r in I.filter_ids_ordered(lst, want).collect()] == ["b", "a"]
