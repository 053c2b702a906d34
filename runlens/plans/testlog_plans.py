"""Queries for test output parsing, gates, JUnit matching and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.operators import testlogs as TL
from runlens.plans.registry import register

_FIELDS = ("passed", "failed", "errors", "skipped", "warnings", "xfailed", "xpassed", "deselected")
_LABEL_CASE = """CASE lower(lab) WHEN 'passed' THEN 'passed' WHEN 'pass' THEN 'passed'
  WHEN 'failed' THEN 'failed' WHEN 'fail' THEN 'failed' WHEN 'failure' THEN 'failed' WHEN 'failures' THEN 'failed'
  WHEN 'error' THEN 'errors' WHEN 'errors' THEN 'errors' WHEN 'skipped' THEN 'skipped' WHEN 'skip' THEN 'skipped'
  WHEN 'warning' THEN 'warnings' WHEN 'warnings' THEN 'warnings' WHEN 'xfailed' THEN 'xfailed'
  WHEN 'xfail' THEN 'xfailed' WHEN 'xpassed' THEN 'xpassed' WHEN 'xpass' THEN 'xpassed'
  WHEN 'deselected' THEN 'deselected' END"""


def _counts_cte(name: str, source: str, key: str, text: str) -> str:
    """SQL CTEs computing the 8 counters of ``text`` per ``key`` as ``name``."""
    cols = ",\n  ".join(
        f"coalesce(arg_max(CAST(n AS BIGINT), i) FILTER (WHERE f = '{f}'), 0) AS {f}" for f in _FIELDS)
    return f"""{name}_l AS (SELECT {key} AS k, coalesce(list_filter(string_split_regex(coalesce({text}, ''), '[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
    lambda x: regexp_matches(x, '\\d+\\s+(passed|failed|errors?|skipped|xfailed|xpassed)\\b'))[-1], '') AS last
  FROM {source}),
{name}_p AS (SELECT k, unnest(regexp_extract_all(last, '(\\d+)\\s+(\\w+)', 1)) AS n,
    unnest(regexp_extract_all(last, '(\\d+)\\s+(\\w+)', 2)) AS lab,
    generate_subscripts(regexp_extract_all(last, '(\\d+)\\s+(\\w+)', 1), 1) AS i FROM {name}_l),
{name}_a AS (SELECT k, {cols}
  FROM (SELECT k, n, i, {_LABEL_CASE} AS f FROM {name}_p) GROUP BY k),
{name} AS (SELECT l.k, {", ".join(f"coalesce(a.{f}, 0) AS {f}" for f in _FIELDS)}
  FROM {name}_l l LEFT JOIN {name}_a a ON l.k = a.k)"""


def _counts_cols(c):
    return [c[f].alias(f) for f in _FIELDS]


@register(
    "pytest_counts",
    oracle_with("fx_logs") + ",\n" + _counts_cte("c", "fx_logs", "run_id", "output")
    + f"""
SELECT k AS run_id, {", ".join(_FIELDS)}, passed + failed + errors AS total_run,
  failed = 0 AND errors = 0 AND passed > 0 AS all_passed FROM c""",
)
def q_pytest_counts(spark, sf):
    logs = TL.add_pytest_counts(fixture(spark, sf, "fx_logs"), "output", "c")
    return logs.select(
        "run_id", *_counts_cols(F.col("c")), TL.total_run(F.col("c")).alias("total_run"),
        TL.all_passed(F.col("c")).alias("all_passed"))


_P2P_TEXT = "concat('===== ', CAST(run_id % 4 AS STRING), ' passed in 0.5s =====')"


@register(
    "f2p_p2p_gate",
    oracle_with("fx_logs") + f""",
src AS (SELECT run_id, output, {_P2P_TEXT} AS p2p_output, run_id % 3 AS f2p_n, test_suite_num % 4 AS p2p_n
        FROM fx_logs),
""" + _counts_cte("f", "src", "run_id", "output") + ",\n" + _counts_cte("p", "src", "run_id", "p2p_output") + """
SELECT s.run_id, CASE WHEN f2p_n > 0 THEN f.failed = 0 AND f.errors = 0 AND f.passed > 0 ELSE true END AS f2p_resolved,
  CASE WHEN p2p_n > 0 THEN p.failed = 0 AND p.errors = 0 AND p.passed > 0 ELSE true END AS p2p_held,
  NOT (f2p_n = 0 AND p2p_n = 0)
    AND (CASE WHEN f2p_n > 0 THEN f.failed = 0 AND f.errors = 0 AND f.passed > 0 ELSE true END)
    AND (CASE WHEN p2p_n > 0 THEN p.failed = 0 AND p.errors = 0 AND p.passed > 0 ELSE true END) AS accepted,
  CASE WHEN f2p_n = 0 AND p2p_n = 0 THEN 'no_test_ids' END AS reason
FROM src s JOIN f ON s.run_id = f.k JOIN p ON s.run_id = p.k""",
)
def q_f2p_p2p_gate(spark, sf):
    # stand-in: second log per run for the P2P ids, id counts from the run key
    logs = fixture(spark, sf, "fx_logs").select(
        "run_id", "output", F.expr(_P2P_TEXT).alias("p2p_output"),
        (F.col("run_id") % 3).alias("f2p_n"), (F.col("test_suite_num") % 4).alias("p2p_n"))
    logs = TL.add_pytest_counts(TL.add_pytest_counts(logs, "output", "f2p"), "p2p_output", "p2p")
    g = TL.f2p_p2p_gate(F.col("f2p"), F.col("p2p"), F.col("f2p_n"), F.col("p2p_n"))
    return logs.select("run_id", g.alias("g")).select("run_id", "g.*")


_MARKED = "concat(output, CASE WHEN run_id % 4 = 0 THEN concat(chr(10), '<pytest>true</pytest>') ELSE '' END)"


@register(
    "suite_pass_rate",
    oracle_with("fx_logs") + f""",
src AS (SELECT run_id, {_MARKED} AS output, test_suite_num FROM fx_logs),
""" + _counts_cte("c", "src", "run_id", "output") + """,
e AS (SELECT s.run_id, s.output, CASE WHEN test_suite_num > 0 THEN test_suite_num
                              ELSE c.passed + c.failed + c.errors END AS eff, c.passed
      FROM src s JOIN c ON s.run_id = c.k)
SELECT run_id, contains(output, '<pytest>true</pytest>') AS accepted,
  CASE WHEN contains(output, '<pytest>true</pytest>') THEN 1.0
       WHEN eff > 0 THEN CAST(passed AS DOUBLE) / eff ELSE 0.0 END AS score,
  CAST(eff AS BIGINT) AS effective_total,
  CASE WHEN eff > 0 THEN CAST(passed AS DOUBLE) / eff ELSE 0.0 END AS pass_rate FROM e""",
)
def q_suite_pass_rate(spark, sf):
    logs = fixture(spark, sf, "fx_logs").select("run_id", F.expr(_MARKED).alias("output"), "test_suite_num")
    logs = TL.add_pytest_counts(logs)
    r = TL.suite_pass_rate(F.col("counts"), F.col("output"), F.col("test_suite_num"))
    return logs.select("run_id", r.alias("r")).select("run_id", "r.*")


@register(
    "suite_all_passed",
    oracle_with("fx_logs") + ",\n" + _counts_cte("c", "fx_logs", "run_id", "output") + """
SELECT l.run_id, c.passed >= l.test_suite_num AND c.failed = 0 AND c.errors = 0 AS all_passed
FROM fx_logs l JOIN c ON l.run_id = c.k""",
)
def q_suite_all_passed(spark, sf):
    logs = TL.add_pytest_counts(fixture(spark, sf, "fx_logs"))
    return logs.select("run_id", TL.suite_all_passed(F.col("counts"), F.col("test_suite_num")).alias("all_passed"))


_JUNIT_VERDICT = "CASE WHEN run_id % 3 = 0 THEN NULL ELSE test_suite_num % 2 = 0 END"


@register(
    "grade_fallback",
    oracle_with("fx_logs") + f""",
src AS (SELECT run_id, {_MARKED} AS output, {_JUNIT_VERDICT} AS junit_passed FROM fx_logs),
""" + _counts_cte("c", "src", "run_id", "output") + """
SELECT s.run_id,
  CASE WHEN contains(output, '<pytest>true</pytest>') THEN true WHEN junit_passed IS NOT NULL THEN junit_passed
       ELSE c.failed = 0 AND c.errors = 0 AND c.passed > 0 END AS all_passed,
  CASE WHEN contains(output, '<pytest>true</pytest>') THEN 'marker' WHEN junit_passed IS NOT NULL THEN 'junit_xml'
       ELSE 'pytest_summary' END AS source
FROM src s JOIN c ON s.run_id = c.k""",
)
def q_grade_fallback(spark, sf):
    # stand-in: JUnit verdict is absent (no XML) for every third run
    logs = fixture(spark, sf, "fx_logs").select(
        "run_id", F.expr(_MARKED).alias("output"), F.expr(_JUNIT_VERDICT).alias("junit_passed"))
    logs = TL.add_pytest_counts(logs)
    g = TL.grade_fallback(F.col("counts"), F.col("output"), F.col("junit_passed"))
    return logs.select("run_id", g.alias("g")).select("run_id", "g.*")


_REWARD_SRC = """SELECT event_id,
  CASE event_type WHEN 'purchase' THEN CAST(value AS STRING) WHEN 'click' THEN '  '
       WHEN 'view' THEN 'abc' END AS reward_txt,
  CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN '{{bad'
       WHEN event_type = 'view' AND user_id % 3 = 1 THEN '[1, 2]'
       WHEN user_id % 2 = 0 THEN replace(props, '"k"', '"reward"') ELSE props END AS reward_json,
  event_type = 'error' AS timed_out
FROM {events}"""


@register(
    "reward_coalesce",
    "WITH src AS (" + _REWARD_SRC.format(events="events") + """),
t AS (SELECT *, CASE WHEN trim(coalesce(reward_txt, '')) <> '' THEN TRY_CAST(trim(reward_txt) AS DOUBLE) END AS tv,
        CASE WHEN json_valid(reward_json) AND json_type(reward_json) = 'OBJECT'
             THEN CASE WHEN json_exists(reward_json, '$.reward') THEN TRY_CAST(json_extract_string(reward_json, '$.reward') AS DOUBLE)
                       ELSE 0.0 END END AS jv FROM src)
SELECT event_id,
  CASE WHEN timed_out THEN 0.0 WHEN tv IS NOT NULL THEN tv WHEN jv IS NOT NULL THEN jv ELSE 0.0 END AS reward,
  CASE WHEN timed_out THEN 'timeout' WHEN tv IS NOT NULL THEN 'reward.txt' WHEN jv IS NOT NULL THEN 'reward.json'
       ELSE 'none' END AS source,
  (CASE WHEN timed_out THEN 0.0 WHEN tv IS NOT NULL THEN tv WHEN jv IS NOT NULL THEN jv ELSE 0.0 END) > 0 AS accepted
FROM t""",
)
def q_reward_coalesce(spark, sf):
    src = spark.sql(_REWARD_SRC, events=read_table(spark, sf, "events"))
    r = TL.reward_coalesce(F.col("reward_txt"), F.col("reward_json"), F.col("timed_out"))
    return src.select("event_id", r.alias("r")).select("event_id", "r.*")


_IDS_SRC = """CASE turn % 5
  WHEN 0 THEN concat('["tests/test_', role, '.py::t', CAST(turn AS STRING), '", "", null, " tests/b.py::x "]')
  WHEN 1 THEN concat('  tests/', role, '.py::t', CAST(turn AS STRING), ' ')
  WHEN 2 THEN ''
  WHEN 3 THEN concat('"', role, '::x"')
  ELSE NULL END"""
_P2P_SRC = "concat('[\"tests/test_', role, '.py::p\", \"tests/test_', role, '.py::t', CAST(turn AS STRING), '\"]')"

_IDS_SQL = """(CASE WHEN coalesce(trim({s}), '') = '' THEN []::VARCHAR[]
  WHEN json_valid(trim({s})) AND json_type(trim({s})) = 'ARRAY'
    THEN list_transform(list_filter(json_extract_string(trim({s}), '$[*]'), lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(x))
  WHEN json_valid(trim({s})) AND json_type(trim({s})) = 'VARCHAR' AND json_extract_string(trim({s}), '$') <> ''
    THEN [json_extract_string(trim({s}), '$')]
  ELSE [trim({s})] END)"""


@register(
    "parse_test_ids",
    f"""WITH src AS (SELECT conv_id, turn, {_IDS_SRC} AS raw FROM conversations),
p AS (SELECT conv_id, turn, {_IDS_SQL.format(s='raw')} AS ids FROM src)
SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, '|') AS ids FROM p""",
)
def q_parse_test_ids(spark, sf):
    conv = read_table(spark, sf, "conversations")
    ids = TL.parse_test_ids(F.expr(_IDS_SRC))
    return conv.select("conv_id", "turn", ids.alias("ids")).select(
        "conv_id", "turn", F.size("ids").alias("n_ids"), F.array_join("ids", "|").alias("ids"))


@register(
    "all_expected_tests",
    f"""WITH src AS (SELECT conv_id, turn, {_IDS_SQL.format(s=_IDS_SRC)} AS f2p,
                      {_IDS_SQL.format(s=_P2P_SRC)} AS p2p FROM conversations),
a AS (SELECT conv_id, turn, list_concat(f2p, p2p) AS ids FROM src)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, ids[i] AS test_id
FROM (SELECT conv_id, turn, ids, generate_subscripts(ids, 1) AS i FROM a)""",
)
def q_all_expected_tests(spark, sf):
    conv = read_table(spark, sf, "conversations")
    both = TL.all_expected_tests(F.expr(_IDS_SRC), F.expr(_P2P_SRC))
    return conv.select("conv_id", "turn", F.posexplode(both).alias("pos", "test_id"))


_TID = """concat('tests/', replace(lower(p_brand), '#', '_'), '/test_x.py::Test', CAST(p_size AS STRING),
  '::test_', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN ' case  a.py' ELSE '' END,
  CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END)"""


@register(
    "normalize_test_id",
    f"""WITH s AS (SELECT p_partkey, {_TID} AS test_id FROM part)
SELECT p_partkey, test_id, trim(replace(replace(test_id, '::', '.'), '/', '.'), '.') AS normalized,
  trim(replace(replace(replace(test_id, '.py', ''), '/', '.'), '::', '.'), '.') AS match_form,
  regexp_replace(trim(replace(replace(replace(test_id, '.py', ''), '/', '.'), '::', '.'), '.'), '\\s+', '', 'g')
    AS fingerprint
FROM s""",
)
def q_normalize_test_id(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", F.expr(_TID).alias("test_id"))
    t = F.col("test_id")
    return part.select("p_partkey", "test_id", TL.normalize_test_id(t).alias("normalized"),
                       TL.match_form(t).alias("match_form"), TL.fingerprint(TL.match_form(t)).alias("fingerprint"))


_CASES_SQL = """cases AS (
  SELECT run_id, doc_pos, 0 AS pos, concat('test_', CAST(ln AS VARCHAR)) AS name,
    concat('tests.test_', flag) AS classname,
    CASE WHEN ln % 2 = 0 THEN concat('tests/test_', flag, '.py') ELSE '' END AS file,
    CASE WHEN tax > 0.06 THEN 'failed' ELSE 'passed' END AS status
  FROM fx_junit WHERE NOT (run_id % 50 = 0 AND doc_pos = 0) AND NOT (tax <= 0.06 AND disc > 0.08)
  UNION ALL
  SELECT run_id, doc_pos, NULL, NULL, NULL, NULL, 'xml_error' FROM fx_junit WHERE run_id % 50 = 0 AND doc_pos = 0)"""


@register(
    "junit_cases",
    oracle_with("fx_junit") + ",\n" + _CASES_SQL + "\nSELECT run_id, CAST(doc_pos AS INTEGER) AS doc_pos, CAST(pos AS INTEGER) AS pos, name,"
    " classname, file, status FROM cases",
)
def q_junit_cases(spark, sf):
    docs = fixture(spark, sf, "fx_junit").select("run_id", "doc_pos", "xml")
    return TL.junit_cases(docs)


_MF = "trim(replace(replace(replace({x}, '.py', ''), '/', '.'), '::', '.'), '.')"
_FP = "regexp_replace(" + _MF + ", '\\s+', '', 'g')"

_MATCH_SQL = f""",
ck AS (SELECT run_id, doc_pos, pos, status,
         CASE WHEN file <> '' THEN concat(file, '::', name) END AS k1,
         {_MF.format(x="concat(classname, '.', name)")} AS k2,
         {_FP.format(x="concat(classname, '.', name)")} AS k3,
         concat(replace(classname, '.', '/'), '.py::', name) AS k4
       FROM cases WHERE status <> 'xml_error'),
ex AS (SELECT DISTINCT run_id, test_id FROM fx_expected),
en AS (SELECT run_id, {_MF.format(x='test_id')} AS k, arg_max(test_id, pos) AS test_id FROM fx_expected GROUP BY 1, 2),
ef AS (SELECT run_id, {_FP.format(x='test_id')} AS k, arg_max(test_id, pos) AS test_id FROM fx_expected GROUP BY 1, 2),
hits AS (
  SELECT c.run_id, c.doc_pos, c.pos, c.status, 1 AS pri, e.test_id FROM ck c JOIN ex e ON c.run_id = e.run_id AND c.k1 = e.test_id
  UNION ALL SELECT c.run_id, c.doc_pos, c.pos, c.status, 2, e.test_id FROM ck c JOIN en e ON c.run_id = e.run_id AND c.k2 = e.k
  UNION ALL SELECT c.run_id, c.doc_pos, c.pos, c.status, 3, e.test_id FROM ck c JOIN ef e ON c.run_id = e.run_id AND c.k3 = e.k
  UNION ALL SELECT c.run_id, c.doc_pos, c.pos, c.status, 4, e.test_id FROM ck c JOIN ex e ON c.run_id = e.run_id AND c.k4 = e.test_id),
best AS (SELECT run_id, doc_pos, pos, status, arg_min(test_id, pri) AS test_id FROM hits GROUP BY 1, 2, 3, 4),
matched AS (SELECT run_id, test_id AS expected_id, arg_max(status, doc_pos * 100000 + pos) AS status
            FROM best GROUP BY 1, 2)"""


@register(
    "match_test_cases",
    oracle_with("fx_junit", "fx_expected") + ",\n" + _CASES_SQL + _MATCH_SQL
    + "\nSELECT run_id, expected_id, status FROM matched",
)
def q_match_test_cases(spark, sf):
    cases = TL.junit_cases(fixture(spark, sf, "fx_junit").select("run_id", "doc_pos", "xml"))
    return TL.match_test_cases(cases, fixture(spark, sf, "fx_expected"))


@register(
    "expected_test_coverage",
    oracle_with("fx_junit", "fx_expected") + ",\n" + _CASES_SQL + _MATCH_SQL + """,
e AS (SELECT x.run_id, count(*) AS total_expected,
        count(*) FILTER (WHERE m.expected_id IS NULL) AS unmatched
      FROM fx_expected x LEFT JOIN matched m ON x.run_id = m.run_id AND x.test_id = m.expected_id GROUP BY 1),
mm AS (SELECT run_id, count(*) AS total_matched, bool_and(status = 'passed') AS ok FROM matched GROUP BY 1),
bad AS (SELECT run_id, bool_or(status = 'xml_error') AS xml_error FROM cases GROUP BY 1)
SELECT e.run_id, e.total_expected, coalesce(mm.total_matched, 0) AS total_matched, e.unmatched,
  coalesce(mm.total_matched, 0) > 0 AND coalesce(mm.ok, false) AND e.unmatched = 0
    AND NOT coalesce(bad.xml_error, false) AS all_passed
FROM e LEFT JOIN mm ON e.run_id = mm.run_id LEFT JOIN bad ON e.run_id = bad.run_id""",
)
def q_expected_test_coverage(spark, sf):
    cases = TL.junit_cases(fixture(spark, sf, "fx_junit").select("run_id", "doc_pos", "xml"))
    return TL.expected_test_coverage(cases, fixture(spark, sf, "fx_expected"))
