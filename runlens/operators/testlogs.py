"""Test output jobs: pytest summaries, pass gates, JUnit cases and their
matching against expected test ids, rewards.

Everything is column expressions (array functions, ``from_xml``,
``try_parse_json``) plus equi-joins; no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from runlens.functions.metrics import observe_malformed

from runlens.functions.columns import once
from runlens.functions.text import PY_WS_CHARS, py_strip

# Fixed values of the reference: pytest summary labels -> counter field.
PYTEST_LABELS = {
    "passed": "passed", "pass": "passed",
    "failed": "failed", "fail": "failed", "failure": "failed", "failures": "failed",
    "error": "errors", "errors": "errors",
    "skipped": "skipped", "skip": "skipped",
    "warning": "warnings", "warnings": "warnings",
    "xfailed": "xfailed", "xfail": "xfailed",
    "xpassed": "xpassed", "xpass": "xpassed",
    "deselected": "deselected",
}
COUNTERS = ("passed", "failed", "errors", "skipped", "warnings", "xfailed", "xpassed", "deselected")
# Fixed values of the reference: a summary line has "N passed|failed|error(s)|
# skipped|xfailed|xpassed"; counts are "N label" pairs; the success marker.
SUMMARY_LINE = r"(?U)\d+\s+(?:passed|failed|errors?|skipped|xfailed|xpassed)\b"
# Line ends as ``str.splitlines`` sees them; ``\r`` comes from progress bars.
LINE_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
# The same test as one scan: whole lines whose gap between number and label
# stays on the line (the look-behind is the start of a line).
SUMMARY_LINES = (rf"(?U)(?<![^{LINE_ENDS}])[^{LINE_ENDS}]*\d+[\s&&[^{LINE_ENDS}]]+"
                 rf"(?:passed|failed|errors?|skipped|xfailed|xpassed)\b[^{LINE_ENDS}]*")
COUNT_PAIR = r"(?U)(\d+)\s+(\w+)"
SUCCESS_MARKER = "<pytest>true</pytest>"


def add_pytest_counts(df: DataFrame, output: str = "output", name: str = "counts") -> DataFrame:
    """Adds struct ``name`` with the 8 counters of the **last** summary line.

    Every ``N label`` pair of that line is mapped through the label table; a
    repeated label keeps its last value; no summary line gives all zeros.
    Lines end as for ``str.splitlines``.

    Built in stages so each array is computed once per row: the summary
    lines with one regex, then the pairs, then per counter the last matching
    pair via ``array_position`` on the reversed arrays.  The counters are one
    lambda body: their generated code for two logs in one projection would be
    too long for the JVM to compile."""
    cols = df.columns
    lines = F.regexp_extract_all(F.coalesce(F.col(output), F.lit("")), F.lit(SUMMARY_LINES), 0)
    s1 = df.withColumn("_last", F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
    labels = F.regexp_extract_all(F.col("_last"), F.lit(COUNT_PAIR), 2)
    s2 = s1.select(*cols,
                   F.reverse(F.regexp_extract_all(F.col("_last"), F.lit(COUNT_PAIR), 1)).alias("_rev_nums"),
                   F.reverse(F.split(F.lower(F.array_join(labels, "\u0000")), "\u0000")).alias("_rev_labels"))

    def counters(pairs: Column) -> Column:
        fields = []
        for counter in COUNTERS:
            hits = [F.nullif(F.array_position(pairs["labels"], F.lit(lab)), F.lit(0).cast("bigint"))
                    for lab, f in PYTEST_LABELS.items() if f == counter]
            pos = hits[0] if len(hits) == 1 else F.least(*hits)
            value = F.try_element_at(pairs["nums"], pos.cast("int")).try_cast("bigint")
            fields.append(F.coalesce(value, F.lit(0).cast("bigint")).alias(counter))
        return F.struct(*fields)

    pairs = F.array(F.struct(F.col("_rev_labels").alias("labels"), F.col("_rev_nums").alias("nums")))
    return s2.select(*cols, F.get(F.transform(pairs, counters), F.lit(0)).alias(name))


def total_run(counts: Column) -> Column:
    return counts["passed"] + counts["failed"] + counts["errors"]


def all_passed(counts: Column) -> Column:
    """At least one test ran and none failed or errored."""
    return (counts["failed"] == 0) & (counts["errors"] == 0) & (counts["passed"] > 0)


def suite_all_passed(counts: Column, expected_num: Column) -> Column:
    """Repo-level gate: ``passed >= n`` with no failures and no errors."""
    return (counts["passed"] >= expected_num) & (counts["failed"] == 0) & (counts["errors"] == 0)


def f2p_p2p_gate(f2p_counts: Column, p2p_counts: Column, f2p_n: Column, p2p_n: Column) -> Column:
    """Struct(resolved, held, accepted, reason).

    resolved = F2P all passed (or no F2P ids); held = P2P all passed (or no
    P2P ids); accepted = both.  No ids at all: rejected, reason
    ``no_test_ids``.  Counts are not compared with the number of ids.
    """
    resolved = F.when(f2p_n > 0, all_passed(f2p_counts)).otherwise(F.lit(True))
    held = F.when(p2p_n > 0, all_passed(p2p_counts)).otherwise(F.lit(True))
    none = (f2p_n == 0) & (p2p_n == 0)
    return F.struct(
        resolved.alias("f2p_resolved"),
        held.alias("p2p_held"),
        (~none & resolved & held).alias("accepted"),
        F.when(none, F.lit("no_test_ids")).alias("reason"),
    )


def suite_pass_rate(counts: Column, output: Column, test_suite_num: Column) -> Column:
    """Struct(accepted, score, effective_total, pass_rate) of a repo-level run.

    Denominator: ``test_suite_num`` if > 0 else passed+failed+errors; score
    1.0 when the success marker is in the output, else the rate (0 when the
    denominator is 0).
    """
    eff = F.when(test_suite_num > 0, test_suite_num.cast("bigint")).otherwise(total_run(counts))
    rate = F.when(eff > 0, counts["passed"].cast("double") / eff.cast("double")).otherwise(F.lit(0.0))
    marker = F.coalesce(output, F.lit("")).contains(SUCCESS_MARKER)
    return F.struct(
        marker.alias("accepted"),
        F.when(marker, F.lit(1.0)).otherwise(rate).alias("score"),
        eff.alias("effective_total"),
        rate.alias("pass_rate"),
    )


def grade_fallback(counts: Column, output: Column, junit_passed: Column) -> Column:
    """Struct(all_passed, source): marker -> JUnit verdict (NULL when no XML
    was available) -> summary verdict (``counts`` from ``add_pytest_counts``)."""
    marker = F.coalesce(output, F.lit("")).contains(SUCCESS_MARKER)
    summary = all_passed(counts)
    return F.struct(
        F.when(marker, F.lit(True)).when(junit_passed.isNotNull(), junit_passed).otherwise(summary)
        .alias("all_passed"),
        F.when(marker, F.lit("marker")).when(junit_passed.isNotNull(), F.lit("junit_xml"))
        .otherwise(F.lit("pytest_summary")).alias("source"),
    )


def reward_coalesce(reward_txt: Column, reward_json: Column, timed_out: Column) -> Column:
    """Struct(reward, source, accepted) of a terminal-task verifier.

    ``reward.txt`` as a float, else ``reward.json``'s ``reward`` key (0 when
    the key is absent; a non-object or unparsable JSON falls through), else
    0.0; a timed-out verifier reads nothing (source ``timeout``).
    """
    txt = py_strip(reward_txt)
    txt_val = F.when(F.coalesce(txt, F.lit("")) != "", txt.try_cast("double"))

    def reward_key(v: Column) -> Column:
        # an absent key defaults to 0; a JSON null or non-numeric value fails float()
        present = F.try_variant_get(v, "$.reward", "variant").isNotNull()
        return F.when(F.schema_of_variant(v).startswith("OBJECT"),
                      F.when(present, F.try_variant_get(v, "$.reward", "double")).otherwise(F.lit(0.0)))

    js = py_strip(reward_json)
    json_val = once(F.when(F.coalesce(js, F.lit("")) != "", F.try_parse_json(js)), reward_key)
    timed = F.coalesce(timed_out, F.lit(False))
    def verdict(read: Column) -> Column:
        reward = F.when(timed, F.lit(0.0)).otherwise(F.coalesce(read["txt"], read["json"], F.lit(0.0)))
        source = (
            F.when(timed, F.lit("timeout")).when(read["txt"].isNotNull(), F.lit("reward.txt"))
            .when(read["json"].isNotNull(), F.lit("reward.json")).otherwise(F.lit("none"))
        )
        return F.struct(reward.alias("reward"), source.alias("source"), (reward > 0).alias("accepted"))

    return once(F.struct(txt_val.alias("txt"), json_val.alias("json")), verdict)


def _py_str_item(x: Column) -> Column:
    """``str(item)`` of a truthy JSON array item, NULL for a falsy one
    (null, false, 0, "", [], {}).  Strings, booleans and integers render as
    Python does; other truthy values render as their JSON text."""
    kind = F.schema_of_variant(x)
    as_str = F.try_variant_get(x, "$", "string")
    is_int = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    is_num = is_int | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.when(kind == "STRING", F.when(as_str != "", as_str))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), F.lit("True")))
        .when(is_int, F.when(F.try_variant_get(x, "$", "bigint") != 0, as_str))
        .when(is_num, F.when(F.try_variant_get(x, "$", "double") != 0, as_str))
        .when(kind.startswith("ARRAY"), F.when(F.size(F.try_variant_get(x, "$", "array<variant>")) > 0,
                                               F.to_json(x)))
        .when(kind.startswith("OBJECT"), F.when(F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0,
                                                F.to_json(x)))
    )


def parse_test_ids(raw: Column) -> Column:
    """Test id field -> ``array<string>``.

    JSON array text -> ``str(item).strip()`` of its truthy items; JSON string
    text -> that string; other non-blank text -> ``[text]`` stripped;
    blank/NULL -> ``[]``."""
    s = py_strip(raw)
    v = F.try_parse_json(s)
    kind = F.schema_of_variant(v)
    items = F.transform(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), _py_str_item),
                                 lambda x: x.isNotNull()), lambda x: py_strip(x))
    as_str = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    empty = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", empty)
        .when(kind.startswith("ARRAY"), items)
        .when(as_str.isNotNull() & (as_str != ""), F.array(as_str))
        .otherwise(F.array(s))
    )


def parse_test_id_array(raw: Column) -> Column:
    """List form of the same rule: truthy items, stripped."""
    return F.transform(F.filter(raw, lambda x: x.isNotNull() & (x != "")), lambda x: py_strip(x))


def all_expected_tests(f2p: Column, p2p: Column) -> Column:
    """FAIL_TO_PASS ids then PASS_TO_PASS ids, duplicates kept (each field is
    parsed with ``parse_test_ids``)."""
    return F.concat(parse_test_ids(f2p), parse_test_ids(p2p))


def _strip_dots(c: Column) -> Column:
    """``str.strip('.')``."""
    return F.trim(c, F.lit("."))


def normalize_test_id(c: Column) -> Column:
    """``::`` and ``/`` -> ``.``, surrounding dots stripped."""
    return _strip_dots(F.replace(F.replace(c, F.lit("::"), F.lit(".")), F.lit("/"), F.lit(".")))


def match_form(c: Column) -> Column:
    """Matching form: every ``.py`` removed, then ``/`` and ``::`` -> ``.``."""
    x = F.replace(c, F.lit(".py"), F.lit(""))
    x = F.replace(F.replace(x, F.lit("/"), F.lit(".")), F.lit("::"), F.lit("."))
    return _strip_dots(x)


def fingerprint(c: Column) -> Column:
    """All whitespace removed (Python's Unicode whitespace set)."""
    return F.translate(c, PY_WS_CHARS, "")


_CASE = "array<struct<_name:string,_classname:string,_file:string,failure:string,error:string,skipped:string>>"
# One schema for both roots: a <testsuite> root fills ``testcase``, a
# <testsuites> root fills ``testsuite``; each document is parsed once.
_XML_SCHEMA = f"struct<testcase:{_CASE},testsuite:array<struct<testcase:{_CASE}>>,_corrupt_record:string>"


def junit_cases(docs: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ("run_id", "doc_pos"),
                observation: Observation | None = None) -> DataFrame:
    """JUnit XML documents -> one row per test case.

    Root ``testsuite`` or ``testsuites``.  Status is ``failed`` when a
    ``failure`` or ``error`` child exists (empty elements count), else
    ``passed``; skipped cases are dropped.  A document that is not XML gives
    one row with status ``xml_error`` and NULL case fields; with an
    ``observation`` the counts of documents and unreadable documents are
    reported by the same job."""
    # Parse once, then let one generator emit either the document's cases or
    # a single error marker.  No filter sits on a parsed column, so the
    # optimizer cannot push one below the parse and run ``from_xml`` twice.
    parsed = docs.select(*keys, F.from_xml(F.col(xml), _XML_SCHEMA).alias("_x"))
    cases = F.coalesce(F.col("_x.testcase"),
                       F.flatten(F.transform(F.col("_x.testsuite"), lambda s: s["testcase"])))
    bad = F.col("_x._corrupt_record").isNotNull()
    parsed = observe_malformed(parsed.select(*keys, "_x"), bad, observation)
    marker = F.array(F.struct(F.lit(True).alias("bad"), F.lit(None).cast(_CASE[len("array<"):-1]).alias("c")))
    items = F.when(bad, marker).otherwise(F.transform(cases, lambda c: F.struct(F.lit(False).alias("bad"),
                                                                                  c.alias("c"))))
    rows = parsed.select(*keys, F.posexplode(items).alias("pos", "it"))
    rows = rows.where(F.col("it.bad") | F.col("it.c.skipped").isNull())
    c = "it.c"
    return rows.select(
        *keys,
        F.when(~F.col("it.bad"), F.col("pos").cast("int")).alias("pos"),
        F.when(~F.col("it.bad"), F.coalesce(F.col(f"{c}._name"), F.lit(""))).alias("name"),
        F.when(~F.col("it.bad"), F.coalesce(F.col(f"{c}._classname"), F.lit(""))).alias("classname"),
        F.when(~F.col("it.bad"), F.coalesce(F.col(f"{c}._file"), F.lit(""))).alias("file"),
        F.when(F.col("it.bad"), F.lit("xml_error"))
        .when(F.col(f"{c}.failure").isNotNull() | F.col(f"{c}.error").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("passed")).alias("status"),
    )


def match_test_cases(cases: DataFrame, expected: DataFrame, run: str = "run_id",
                     order: tuple[str, ...] = ("doc_pos", "pos")) -> DataFrame:
    """Final status per matched expected id.

    Four strategies in priority order: 1 exact ``file::name``; 2 match form
    of ``classname.name``; 3 its whitespace-free fingerprint; 4 ``classname``
    as a path + ``::name``.  Texts that are equal have equal fingerprints, so
    a case meets the expected ids of its fingerprints in **one** equi-join on
    ``(run, fingerprint)``: one row per case, unless its spellings differ by
    more than dots, ``.py`` and white space.  A case takes its best-priority
    hit; when two expected ids share a match form (or fingerprint) the later
    one in the list owns it; when several cases hit one id, the last case in
    document order decides.
    """
    return _matches(cases, expected, run, order).where("expected_id IS NOT NULL").select(run, "expected_id", "status")


def _matches(cases: DataFrame, expected: DataFrame, run: str, order: tuple[str, ...]) -> DataFrame:
    """``run, expected_id, status, n`` of the matched ids (``n``: how often the
    id is expected) plus one row ``(run, NULL, xml_error, NULL)`` per run with an
    unreadable document, all in one pass over the cases."""
    unreadable = F.col("status") == "xml_error"
    spelled = cases.select(
        run, *order, "status",
        F.when(F.col("file") != "", F.concat(F.col("file"), F.lit("::"), F.col("name"))).alias("exact"),
        match_form(F.concat(F.col("classname"), F.lit("."), F.col("name"))).alias("form"),
        F.concat(F.replace(F.col("classname"), F.lit("."), F.lit("/")), F.lit(".py::"), F.col("name")).alias("as_path"))
    # mostly one fingerprint: it is made anew only for a spelling with another match form
    spelled = spelled.withColumns({"fp": fingerprint(F.col("form")), "path_form": match_form(F.col("as_path"))})
    by_path = F.when(F.col("path_form") == F.col("form"), F.col("fp")).otherwise(F.coalesce(fingerprint(F.col("path_form")), "fp"))
    spelled = spelled.withColumn("path_fp", by_path)
    by_name = (F.when(F.col("exact").isNull() | (F.col("exact") == F.col("as_path")), F.col("path_fp"))
               .otherwise(fingerprint(match_form(F.col("exact")))))
    spelled = spelled.withColumn("name_fp", by_name)
    one = (F.col("path_fp") == F.col("fp")) & (F.col("name_fp") == F.col("fp"))
    keys = F.when(one, F.array("fp")).otherwise(F.array_distinct(F.array("fp", "path_fp", "name_fp")))
    probes = spelled.withColumn("key", F.explode(keys)).drop("path_form", "path_fp", "name_fp")
    # one row per id; dealt as the join needs them, so that neither the counts
    # nor the owners (the last in the list) need another shuffle
    norm = match_form(F.col("test_id"))
    ids = expected.select(run, "pos", "test_id", norm.alias("norm")).withColumn("key", fingerprint(F.col("norm"))).repartition(run, "key")
    ids = ids.groupBy(run, "key", "norm", "test_id").agg(F.max("pos").alias("at"), F.count(F.lit(1)).alias("n"))
    last = (F.col("at").desc_nulls_last(), F.col("test_id").desc())
    entries = ids.withColumns({"owns_form": F.row_number().over(Window.partitionBy(run, "key", "norm").orderBy(*last)) == 1,
                               "owns_fp": F.row_number().over(Window.partitionBy(run, "key").orderBy(*last)) == 1}).drop("at")
    by = [F.col("test_id") == F.col("exact"), F.col("owns_form") & (F.col("norm") == F.col("form")),
          F.col("owns_fp") & (entries["key"] == F.col("fp")), F.col("test_id") == F.col("as_path")]
    same = (probes[run] == entries[run]) & (probes["key"] == entries["key"])
    hits = probes.join(entries, same & (by[0] | by[1] | by[2] | by[3]), "left").where(F.col("test_id").isNotNull() | unreadable)
    pri = F.when(by[0], 1).when(by[1], 2).when(by[2], 3).otherwise(4)
    hits = hits.select(probes[run], *order, "status", pri.alias("pri"), F.col("test_id").alias("expected_id"), "n")
    # a case keeps its best hit
    best = hits.withColumn("best", F.min("pri").over(Window.partitionBy(run, *order, "status"))).where("pri = best")
    order_key = F.struct(*[F.col(o) for o in order])
    return best.groupBy(run, "expected_id").agg(F.max_by("status", order_key).alias("status"), F.max("n").alias("n"))


def expected_test_coverage(cases: DataFrame, expected: DataFrame, run: str = "run_id",
                           order: tuple[str, ...] = ("doc_pos", "pos")) -> DataFrame:
    """Per run with expected tests: expected / matched / unmatched counts and
    the verdict ``all_passed = some matched ∧ all matched passed ∧ none
    unmatched``; a run with an unreadable XML document is not passed.

    One pass over the cases: a matched id carries how often it is expected, so
    only the runs' totals meet the match results, in one aggregation on ``run``;
    the unreadable documents travel with the match results."""
    found = _matches(cases, expected, run, order).withColumn("total", F.lit(0).cast("bigint"))
    totals = expected.groupBy(run).agg((F.count("test_id") + F.count_if(F.col("test_id").isNull())).alias("total")).select(
        run, F.lit(None).cast("string").alias("expected_id"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("bigint").alias("n"), "total")
    hit = F.col("expected_id").isNotNull()
    out = totals.unionByName(found).groupBy(run).agg(
        F.sum("total").cast("bigint").alias("total_expected"),
        F.count_if(hit).cast("bigint").alias("total_matched"),
        (F.sum("total") - F.coalesce(F.sum("n"), F.lit(0))).cast("bigint").alias("unmatched"),
        F.bool_and(F.when(hit, F.col("status") == "passed")).alias("_all_ok"),
        F.bool_or(F.coalesce(F.col("status") == "xml_error", F.lit(False))).alias("_unreadable"),
    ).where(F.col("total_expected") > 0)
    return out.select(
        run, "total_expected", "total_matched", "unmatched",
        ((F.col("total_matched") > 0) & F.coalesce("_all_ok", F.lit(False))
         & (F.col("unmatched") == 0) & ~F.col("_unreadable")).alias("all_passed"),
    )
