"""The ``fx_*`` stand-in tables built from the driver tables.

Each fixture only reshapes driver rows into the schema an operator expects
(instances, predictions, progress, results, messages, calls, search hits,
test logs, RL samples).  The text is plain SQL that runs unchanged on Spark
and DuckDB, so the same definition feeds both the Spark query and its
oracle.  Operators never look at how these rows were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURE_SQL: dict[str, str] = {
    "fx_instances": """
SELECT concat('I-', CAST(doc_id AS STRING)) AS instance_id,
  CASE doc_id % 6 WHEN 0 THEN 'Doc2Repo' WHEN 1 THEN 'Cross-Repo' WHEN 2 THEN 'dep_migrate'
                  WHEN 3 THEN 'Domain Fix' WHEN 4 THEN 'refactor' END AS task,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS user_name,
  concat('repo', CAST(doc_id % 7 AS STRING)) AS repo,
  concat('reg.io/', source, '/img:', lang) AS image_url,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('c', CAST(doc_id AS STRING)) END AS base_commit,
  concat('p', CAST(doc_id AS STRING)) AS parent_commit,
  text AS problem_statement, lang AS language
FROM {documents}""",
    "fx_predictions": """
SELECT concat('I-', CAST(doc_id + CASE WHEN doc_id % 17 = 0 THEN 1000000 ELSE 0 END AS STRING)) AS instance_id,
  'm1' AS model_name_or_path,
  CASE WHEN doc_id % 11 = 0 THEN '   ' WHEN doc_id % 13 = 0 THEN NULL
       ELSE concat('diff --git a/src/', lang, '.py b/src/', lang, '.py') END AS model_patch
FROM {documents} WHERE doc_id % 5 <> 0""",
    "fx_progress": """
SELECT event_id AS seq, ts, concat('I-', CAST(user_id AS STRING)) AS instance_id,
  CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'error' END AS status,
  event_type = 'signup' AS accepted,
  CASE WHEN event_type = 'view' THEN 'No such image' END AS details_error, value AS duration
FROM {events}""",
    "fx_results": """
SELECT concat('I-', CAST(d.doc_id AS STRING)) AS instance_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'Doc2Repo' WHEN 1 THEN 'crossrepo' WHEN 2 THEN 'depmigrate'
                    WHEN 3 THEN 'domainfix' ELSE '' END AS task,
  CASE WHEN d.doc_id % 5 = 0 THEN CAST(d.doc_id % 11 AS DOUBLE) / 10
       ELSE CAST(coalesce(l.quality, 0) AS DOUBLE) END AS score,
  CASE WHEN l.toxic = 1 THEN 'error' WHEN d.doc_id % 7 = 0 THEN 'max_steps' ELSE 'finish' END AS finish_reason
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_messages": """
SELECT conv_id, turn, role, text AS content FROM {conversations}""",
    "fx_calls": """
SELECT l_orderkey AS run_id,
  row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step,
  CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens, CAST(l_quantity AS BIGINT) AS completion_tokens,
  l_extendedprice / 1000 AS llm_elapsed, l_tax AS tool_elapsed,
  CASE l_returnflag WHEN 'R' THEN 'execute_bash' WHEN 'A' THEN 'str_replace_editor' ELSE 'finish' END AS tool_name
FROM {lineitem}""",
    "fx_search": """
SELECT CAST(floor(page_id / 25) AS BIGINT) AS query_id,
  row_number() OVER (PARTITION BY CAST(floor(page_id / 25) AS BIGINT) ORDER BY page_id) AS position,
  url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
FROM {pages}""",
    "fx_logs": """
SELECT o_orderkey AS run_id,
  concat('collected', chr(10), '1 passed', chr(10), '===== ', CAST(o_orderkey % 9 AS STRING), ' passed, ',
         CAST(o_custkey % 3 AS STRING), ' failed, ', CAST(o_custkey % 2 AS STRING),
         ' error in 1.25s =====',
         CASE o_orderkey % 7 WHEN 0 THEN concat(chr(13), '2 passed, 1 skipped') WHEN 1 THEN concat(chr(12), '3 failed')
                             WHEN 2 THEN concat(chr(13), chr(10), '4 errors') ELSE '' END,
         chr(10), 'bye') AS output,
  o_orderkey % 10 AS test_suite_num
FROM {orders}""",
    "fx_samples": """
SELECT conv_id % 16 AS group_id, conv_id AS sample_index,
  CASE WHEN max(turn) >= 7 THEN 'aborted' WHEN max(turn) >= 6 THEN 'truncated' ELSE 'completed' END AS status,
  CAST(sum(length(text)) AS BIGINT) AS n_tokens
FROM {conversations} GROUP BY conv_id""",
    # One JUnit XML document per agent step (some wrapped in <testsuites>, one
    # unreadable document per 50 runs) and one expected test id per step in
    # one of four spellings.  The plain columns next to the XML are what the
    # document encodes; only the oracle reads them.  Both use the same inner
    # subquery, so a plan that builds both shares its shuffle and sort.
    "fx_junit": """
SELECT run_id, step AS doc_pos, ln, flag, tax, disc,
  CASE WHEN run_id % 50 = 0 AND step = 0 THEN 'not xml at all'
       ELSE concat(CASE WHEN step % 3 = 2 THEN '<testsuites><testsuite>' ELSE '<testsuite name="s">' END,
         '<testcase name="test_', CAST(ln AS STRING), '" classname="tests.test_', flag, '"',
         CASE WHEN ln % 2 = 0 THEN concat(' file="tests/test_', flag, '.py"') ELSE '' END, '>',
         CASE WHEN tax > 0.06 THEN '<failure message="boom">trace</failure>'
              WHEN disc > 0.08 THEN '<skipped/>' ELSE '' END,
         '</testcase>', CASE WHEN step % 3 = 2 THEN '</testsuite></testsuites>' ELSE '</testsuite>' END) END AS xml
FROM (SELECT l_orderkey AS run_id,
        row_number() OVER (PARTITION BY l_orderkey
                           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step,
        l_linenumber AS ln, l_returnflag AS flag, l_tax AS tax, l_discount AS disc FROM {lineitem}) t""",
    "fx_expected": """
SELECT run_id, step AS pos, CASE step % 4
    WHEN 0 THEN concat('tests/test_', flag, '.py::test_', CAST(ln AS STRING))
    WHEN 1 THEN concat('tests.test_', flag, '.test_', CAST(ln AS STRING))
    WHEN 2 THEN concat('tests/test_', flag, '.py::test_ ', CAST(ln AS STRING))
    ELSE concat('missing/test_', CAST(step AS STRING), '.py::nothing') END AS test_id
FROM (SELECT l_orderkey AS run_id,
        row_number() OVER (PARTITION BY l_orderkey
                           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step,
        l_linenumber AS ln, l_returnflag AS flag, l_tax AS tax, l_discount AS disc FROM {lineitem}) t""",
    # Search hits of the first instances' runs: repo URLs on github, gitlab
    # and raw hosts in several spellings, next to ordinary page URLs.
    "fx_hits": """
SELECT page_id AS hit_id, concat('I-', CAST(page_id AS STRING)) AS instance_id,
  CASE page_id % 9
    WHEN 0 THEN concat('https://github.com/src', CAST(page_id % 20 AS STRING), '/repo', CAST(page_id % 7 AS STRING), '/issues/1')
    WHEN 1 THEN concat('https://GitHub.com/SRC', CAST(page_id % 20 AS STRING), '/Repo', CAST(page_id % 7 AS STRING))
    WHEN 2 THEN concat('https://gitlab.com/other/repo', CAST(page_id % 7 AS STRING), '?tab=readme')
    WHEN 3 THEN concat('https://raw.githubusercontent.com/x/repo', CAST(page_id % 7 AS STRING), '/main/setup.py')
    WHEN 4 THEN concat('https://github.com/src', CAST(page_id % 20 AS STRING), '/repo', CAST(page_id % 7 AS STRING), '-extension')
    WHEN 5 THEN concat('https://mirror.example.org/github.com/src1/repo', CAST(page_id % 7 AS STRING), '#readme')
    WHEN 6 THEN concat('https://raw.githubusercontent.com/repo', CAST(page_id % 7 AS STRING), '/x')
    ELSE url END AS url,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
FROM {pages}""",
    # Terminal captures: the scroll-back buffer grows by one message per
    # step, except every fourth step, where the screen was cleared.
    "fx_screens": """
SELECT conv_id AS run_id, turn AS step, buffer, right(buffer, 120) AS visible
FROM (SELECT conv_id, turn,
        CASE WHEN turn % 4 = 3 THEN concat('$ clear', chr(10), text)
             ELSE string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS buffer
      FROM {conversations}) t""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one ``fx_*`` table lazily from the driver parquet files."""
    text = FIXTURE_SQL[name]
    tables = {t: read_table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def oracle_with(*names: str) -> str:
    """``WITH`` prefix that defines the named fixtures for the DuckDB oracle."""
    parts = []
    for name in names:
        body = FIXTURE_SQL[name].format(**{t: t for t in BASE_TABLES})
        parts.append(f"{name} AS ({body}\n)")
    return "WITH " + ",\n".join(parts)
