"""Message and tool-call tables: validity, XML / JSON call extraction, call
rows, chat export, observations, typed final answers and truncation.

All jobs are row-local column expressions; only finding the JSON object in
answers that are not one well-formed object is an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.columns import once
from runlens.functions.metrics import observe_malformed

from runlens.functions.terminal_json import candidates
from runlens.functions.text import py_rstrip, py_strip


def _count(haystack: Column, needle: str) -> Column:
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


# ── responses and XML calls ────────────────────────────────────────────────


def valid_response(content: Column, n_tool_calls: Column, finish_reason: Column) -> Column:
    """Non-empty content or at least one tool call, and not cut by length."""
    has = (F.coalesce(content, F.lit("")) != "") | (F.coalesce(n_tool_calls, F.lit(0)) > 0)
    return has & (F.coalesce(finish_reason, F.lit("")) != "length")


# Fixed values of the reference: the XML tool-call tags (as Java patterns;
# ``(?s)`` is Python's DOTALL).
_FUNCTION = r"(?s)<function=([^>]+)>\n?(.*?)</function>"
_PARAM = r"(?s)<parameter=([^>]+)>(.*?)</parameter>"


def repair_function_tag(content: Column) -> Column:
    """Close a single unterminated ``<function=`` block (output cut off):
    ``</`` is completed, otherwise ``\\n</function>`` is appended to the
    right-stripped text."""
    c = F.coalesce(content, F.lit(""))
    one_open = _count(c, "<function=") == 1
    no_close = ~c.contains("</function>")
    stripped = py_rstrip(c)
    fixed = F.when(stripped.endswith("</"), F.concat(stripped, F.lit("function>"))).otherwise(
        F.concat(stripped, F.lit("\n</function>")))
    return F.when(one_open & no_close, fixed).otherwise(c)


def extract_xml_calls(content: Column) -> Column:
    """Struct(name, param_names, param_values, mismatched) of the first
    ``<function=name>…</function>`` block; NULL when there is none.

    Parameters are trimmed; a repeated parameter keeps its first position
    and its last value (dict semantics).  ``mismatched`` flags unequal
    counts of opening and closing parameter tags."""
    c = repair_function_tag(content)
    has = c.rlike(_FUNCTION)
    name = py_strip(F.regexp_extract(c, _FUNCTION, 1))
    body = F.regexp_extract(c, _FUNCTION, 2)
    names = F.transform(F.regexp_extract_all(body, F.lit(_PARAM), 1), lambda x: py_strip(x))
    values = F.transform(F.regexp_extract_all(body, F.lit(_PARAM), 2), lambda x: py_strip(x))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    keys = F.array_distinct(names)
    last_vals = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    mismatched = _count(body, "<parameter=") != _count(body, "</parameter>")
    return F.when(
        F.coalesce(content, F.lit("")) != "",
        F.when(has, F.struct(name.alias("name"), keys.alias("param_names"), last_vals.alias("param_values"),
                             mismatched.alias("mismatched"))),
    )


# ── JSON commands (Arrow helper) ───────────────────────────────────────────

COMMANDS_SCHEMA = T.StructType([
    T.StructField("is_complete", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("warning", T.StringType()),
    T.StructField("commands", T.ArrayType(T.StructType([
        T.StructField("keystrokes", T.StringType()), T.StructField("duration", T.DoubleType())]))),
])


_NUMERIC_KINDS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN")


def _is_numeric(kind: Column) -> Column:
    return kind.isin(*_NUMERIC_KINDS) | kind.startswith("DECIMAL")


def _well_formed(text: Column) -> Column:
    """The fast path applies (the text is one checked object)."""
    return F.coalesce(_fast_parts(text)[0], F.lit(False))


def _fast_parts(text: Column):
    t = py_strip(text)
    v = F.try_parse_json(t)
    # the JSON reader stops at the end of the first value; text after it would
    # have to fit into a list and into an object alike to go unnoticed
    alone = (F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull()
             & F.try_parse_json(F.concat(F.lit('{"a":'), t, F.lit("}"))).isNotNull())
    is_obj = t.startswith("{") & F.schema_of_variant(v).startswith("OBJECT") & alone

    def present(path: str) -> Column:
        return F.try_variant_get(v, path, "variant").isNotNull()

    cmds = F.try_variant_get(v, "$.commands", "array<variant>")
    cmd_ok = F.forall(cmds, lambda c: F.schema_of_variant(c).startswith("OBJECT")
                      & (F.schema_of_variant(F.try_variant_get(c, "$.keystrokes", "variant")) == "STRING"))
    ok = (is_obj & present("$.analysis") & present("$.plan") & present("$.commands") & cmds.isNotNull()
          & F.coalesce(cmd_ok, F.lit(False)))
    return ok, v, cmds


CANDIDATE_TYPE = "array<struct<repair:string,body:string,notes:array<string>,problem:string>>"
_REQUIRED = ("analysis", "plan", "commands")


def _candidates(text: pd.Series) -> pd.Series:
    """Objects found in answers that are not one well-formed object (those
    come as NULL and stay NULL)."""
    return text.map(candidates, na_action="ignore")


def _listed(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit("- "), F.array_join(lines, "\n- "))).otherwise(F.lit(""))


def _truth(v: Column, kind: Column, path: str) -> Column:
    """Whether a value counts as true: booleans, the words true / 1 / yes,
    numbers other than 0, lists and objects that are not empty."""
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(kind == "STRING", F.lower(F.try_variant_get(v, path, "string")).isin("true", "1", "yes"))
        .when(_is_numeric(kind), F.try_variant_get(v, path, "double") != 0)
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, path, "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v, path, "map<string,variant>")) > 0),
        F.lit(False))


def _checked(c: Column) -> Column:
    """The field checks of one candidate, as column expressions: struct of
    is_complete, error, warning and commands."""
    body = c["body"]
    v = F.try_parse_json(body)
    missing = F.filter(F.array(*[F.lit(k) for k in _REQUIRED]), lambda k: ~F.array_contains(F.json_object_keys(body), k))
    items = F.try_variant_get(v, "$.commands", "array<variant>")
    flag_kind = F.schema_of_variant(F.try_variant_get(v, "$.task_complete", "variant"))
    complete = _truth(v, flag_kind, "$.task_complete")
    odd_flag = F.when(flag_kind.isNotNull() & (flag_kind != "VOID") & ~flag_kind.isin("BOOLEAN", "STRING"),
                      F.lit("task_complete should be boolean or string"))

    def numbered(i: Column, text: str) -> Column:
        return F.concat(F.lit("Command "), (i + 1).cast("string"), F.lit(text))

    def fault(x: Column, i: Column) -> Column:
        keys = F.schema_of_variant(F.try_variant_get(x, "$.keystrokes", "variant"))
        text = (F.when(~F.schema_of_variant(x).startswith("OBJECT"), numbered(i, " must be an object"))
                .when(keys.isNull(), numbered(i, " missing 'keystrokes'"))
                .when(keys != "STRING", numbered(i, " keystrokes must be string")))
        return F.when(text.isNotNull(), F.struct(i.alias("at"), text.alias("text")))

    first_fault = F.get(F.array_compact(F.transform(items, fault)), F.lit(0))

    def duration_note(x: Column, i: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(x, "$.duration", "variant"))
        note = (F.when(kind.isNull(), numbered(i, ": missing duration, using 1.0"))
                .when(~_is_numeric(kind), numbered(i, ": invalid duration, using 1.0")))
        return F.when(first_fault.isNull() | (i < first_fault["at"]), note)

    def command(x: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(x, "$.duration", "variant"))
        given = F.when(_is_numeric(kind), F.try_variant_get(x, "$.duration", "double"))
        return F.struct(F.try_variant_get(x, "$.keystrokes", "string").alias("keystrokes"),
                        F.coalesce(given, F.lit(1.0)).alias("duration"))

    structure = (F.when(body.isNull(), c["problem"])
                 .when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
                 .when(items.isNull(), F.lit("Field 'commands' must be an array")))
    error = F.coalesce(structure, F.when(~complete, first_fault["text"]), F.lit(""))
    later = F.array_compact(F.concat(F.array(odd_flag), F.transform(items, duration_note),
                                     F.array(F.when(complete, first_fault["text"]))))
    notes = F.when(structure.isNotNull(), c["notes"]).otherwise(F.concat(c["notes"], later))
    fixed = F.when(c["repair"] != "", F.concat(F.lit("- AUTO-CORRECTED: "), c["repair"],
                                                F.when(F.size(notes) > 0, "\n").otherwise(F.lit(""))))
    none = F.array().cast("array<struct<keystrokes:string,duration:double>>")
    return F.struct(
        (complete & (error == "")).alias("is_complete"),
        error.alias("error"),
        F.concat(F.coalesce(fixed, F.lit("")), _listed(notes)).alias("warning"),
        F.when((error == "") & first_fault.isNull(), F.transform(items, command)).otherwise(none).alias("commands"),
    )


def extract_json_commands(df: DataFrame, text: str, keys: list[str],
                          observation: Observation | None = None) -> DataFrame:
    """Parse terminal-agent JSON answers: ``keys`` + is_complete, error,
    warning, commands.

    One pass: answers that are one well-formed object are their own only
    candidate; for the others an Arrow UDF lists the objects found in the text
    (as it stands, then repaired).  Every candidate is checked by the same
    column expressions, and the first one without an error is taken, else the
    first.  With an ``observation`` the number of answers with a parse error is
    reported by the same job."""
    whole = F.array(F.struct(F.lit("").alias("repair"), py_strip(F.col(text)).alias("body"),
                             F.array().cast("array<string>").alias("notes"), F.lit("").alias("problem")))
    answer = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keys, text, _well_formed(F.col(text)).alias("_whole"))
    rows = rows.withColumn("_found", F.pandas_udf(_candidates, CANDIDATE_TYPE)(F.when(~F.col("_whole"), answer)))
    rows = rows.withColumn("_found", F.when(F.col("_whole"), whole.cast(CANDIDATE_TYPE)).otherwise(F.col("_found")))
    rows = rows.select(*keys, F.transform("_found", _checked).alias("_checked"))
    best = F.coalesce(F.get(F.filter("_checked", lambda r: r["error"] == ""), F.lit(0)), F.get("_checked", F.lit(0)))
    out = rows.select(*keys, best.alias("_r")).select(*keys, "_r.*")
    return observe_malformed(out, F.col("error") != "", observation)


# ── tool calls, chat rows, observations ────────────────────────────────────


def tool_call_rows(steps: DataFrame, known_tools: list[str], calls: str = "tool_calls",
                   keys: tuple[str, ...] = ("run_id", "step"), observation: Observation | None = None) -> DataFrame:
    """One row per call: name / arguments from the flat or the
    ``function``-nested shape, and the error observation the loop would
    produce (unknown tool, or arguments that are not JSON); an
    ``observation`` receives the count of erroring calls."""
    ex = steps.select(*keys, F.posexplode(calls).alias("call_pos", "c"))
    name = F.coalesce(F.col("c.name"), F.col("c.function.name"), F.lit(""))
    args = F.coalesce(F.col("c.arguments"), F.col("c.function.arguments"), F.lit("{}"))
    known = F.array(*[F.lit(t) for t in known_tools]) if known_tools else F.array().cast("array<string>")
    bad_json = F.try_parse_json(args).isNull()
    err = (F.when(~F.array_contains(known, name), F.concat(F.lit("Error: tool '"), name, F.lit("' not found.")))
           .when(bad_json, F.concat(F.lit("Error: invalid JSON arguments: "), args)))
    out = ex.select(*keys, "call_pos", F.coalesce(F.col("c.id"), F.lit("")).alias("call_id"),
                    name.alias("name"), args.alias("arguments"), err.alias("error_obs"))
    return observe_malformed(out, F.col("error_obs").isNotNull(), observation)


def format_messages(steps: DataFrame, keys: tuple[str, ...] = ("run_id", "step"), content: str = "content",
                    n_calls: str = "n_tool_calls", observations: str = "observations") -> DataFrame:
    """Trajectory -> chat rows: the assistant row (content only if non-empty)
    then one ``tool`` row per observation."""
    c = F.col(content)
    assistant = F.struct(F.lit("assistant").alias("role"),
                         F.when(F.coalesce(c, F.lit("")) != "", c).alias("content"),
                         (F.coalesce(F.col(n_calls), F.lit(0)) > 0).alias("has_tool_calls"))
    obs = F.transform(F.coalesce(F.col(observations), F.array().cast("array<string>")),
                      lambda o: F.struct(F.lit("tool").alias("role"), o.alias("content"),
                                         F.lit(False).alias("has_tool_calls")))
    rows = F.concat(F.array(assistant), obs)
    return steps.select(*keys, F.posexplode(rows).alias("pos", "m")).select(*keys, "pos", "m.*")


def format_observations(calls: DataFrame, text_mode: bool, obs: str = "observation") -> DataFrame:
    """Observation messages: text mode -> ``user`` row
    ``OBSERVATION:\\n[tool]\\nobs``; native mode -> ``tool`` row with the call
    id and tool name."""
    if text_mode:
        return calls.select("*", F.lit("user").alias("role"),
                            F.concat(F.lit("OBSERVATION:\n["), F.col("name"), F.lit("]\n"), F.col(obs)).alias("content"),
                            F.lit(None).cast("string").alias("tool_call_id"),
                            F.lit(None).cast("string").alias("tool_name"))
    return calls.select("*", F.lit("tool").alias("role"), F.col(obs).alias("content"),
                        F.col("call_id").alias("tool_call_id"), F.col("name").alias("tool_name"))


# ── typed answers ──────────────────────────────────────────────────────────


def answers_int(params_json: Column, field: str = "answer") -> Column:
    """``int(params['answer'])``: integers as they are, other numbers
    truncated, text parsed; anything else (missing key, bad text, non-scalar,
    an integer beyond 64 bits) gives NULL.  The JSON is parsed once."""
    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "STRING", py_strip(F.try_variant_get(v, "$", "string")).try_cast("bigint"))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"), F.try_variant_get(v, "$", "bigint"))
            .when(kind.startswith("DECIMAL") & kind.endswith(",0)"), F.try_variant_get(v, "$", "decimal(38,0)").try_cast("bigint"))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
        )

    return once(F.try_variant_get(F.try_parse_json(params_json), f"$.{field}", "variant"), read)


def answers_files(text: Column) -> Column:
    """Newline list -> stripped non-empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: py_strip(x)),
                    lambda x: x != "")


# A readable block: a number or ``a-b`` (``+`` allowed, ASCII digits), with
# surrounding whitespace.
_WS = r"[\s\x1c-\x1f]*"
_NUM = r"\+?0*[0-9]{1,38}"
_BLOCK = rf"(?U)^{_WS}{_NUM}{_WS}(?:-{_WS}{_NUM}{_WS})?$"
#: ends are whole numbers of up to 38 digits; a block with a longer one is unreadable
_END = "decimal(38,0)"
#: numbers of one generated array: a range is cut into spans of this many squared,
#: those into spans of this many, those into numbers
_SPAN = 1 << 20


def answers_line_ranges(df: DataFrame, text: str, key: str) -> DataFrame:
    """``file:1,3-5`` lines -> ``(key, file, lo, hi, ord)``, one row per block:
    the numbers lo..hi, exact to 38 digits and never written out.

    A line without exactly one ``:`` is skipped; within a line, blocks are
    read left to right and the first unreadable block drops itself and the
    rest of that line (earlier blocks stay).  A single number is a range of
    one, ``b < a`` an empty one (kept as written).  Order: line, block.

    A file is listed as soon as a line reaches it -- unless the line's first
    block is a malformed range (not exactly one ``-``) -- even if no number
    follows.  A reaching line that may add no number (no readable block, or
    a range, which can be empty) also contributes one row with ``lo`` and
    ``hi`` NULL."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_li", "_line"))
    lines = lines.withColumn("_line", py_strip(F.col("_line"))).where(F.col("_line") != "")
    parts = F.split(F.col("_line"), ":")
    nums_text = F.try_element_at(parts, F.lit(2))
    first = py_strip(F.try_element_at(F.split(nums_text, ","), F.lit(1)))
    created = ~(first.contains("-") & (F.size(F.split(first, "-")) != 2))
    lines = lines.where(F.size(parts) == 2).select(
        key, "_li", py_strip(F.try_element_at(parts, F.lit(1))).alias("_file"),
        F.split(nums_text, ",").alias("_blocks"), created.alias("_created"))
    bad = F.array_position(F.transform("_blocks", lambda b: b.rlike(_BLOCK)), F.lit(False)).cast("int")
    lines = lines.withColumn("_ok", F.when(bad > 0, F.slice("_blocks", 1, bad - 1)).otherwise(F.col("_blocks")))
    # the NULL marker is only needed when the line may add no number: no
    # readable block, or a range that can be empty
    marker = F.col("_created") & ((F.size("_ok") == 0) | F.array_join("_ok", ",").contains("-"))
    arr = F.concat(F.when(marker, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")), F.col("_ok"))
    # (read inside the array: after the explode both ends are plain columns, read once)
    def read(block: Column) -> Column:
        ends = F.split(block, "-")
        lo = py_strip(F.element_at(ends, 1)).try_cast(_END)
        return F.struct(lo.alias("lo"), F.when(F.size(ends) > 1, py_strip(F.try_element_at(ends, F.lit(2))).try_cast(_END)).otherwise(lo).alias("hi"))

    blocks = lines.select(key, "_li", "_file", F.posexplode(F.transform(arr, read)).alias("_bi", "_b"))
    return blocks.select(key, F.col("_file").alias("file"), F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"),
                         F.struct(F.col("_li").alias("li"), F.col("_bi").alias("bi")).alias("ord"))


def answers_line_sets(df: DataFrame, text: str, key: str) -> DataFrame:
    """``(key, file, lo, hi)``: each file's numbers as disjoint ascending
    ranges that do not touch; a listed file without numbers has one row with
    NULL ends.  Ranges are merged as intervals, whatever their width."""
    ranges = answers_line_ranges(df, text, key)
    w = Window.partitionBy(key, "file").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    real = ranges.where("lo <= hi").withColumn("_new", F.coalesce(F.col("lo") - 1 > before, F.lit(True)).cast("int"))
    islands = real.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "file", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")
    bare = ranges.groupBy(key, "file").agg(F.bool_or(F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False))).alias("_any")).where("NOT _any")
    return merged.unionByName(bare.select(key, "file", F.lit(None).cast(_END).alias("lo"), F.lit(None).cast(_END).alias("hi")))


def answers_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """The blocks of ``answers_line_ranges`` written out: ``(key, file,
    line_no, ord)`` rows, in order of line, block and place in the block, and
    rows with ``line_no`` NULL for its listed files, so a per-file
    ``collect_list`` of the non-NULL numbers gives ``[]`` for a file without
    numbers, as the reference's ``defaultdict`` does.

    A range of any width is written out, by arrays of a bounded size; one with
    an end beyond 64 bits is one row with ``line_no`` NULL and the range in
    ``unexpanded`` (``lo-hi``, else NULL)."""
    ranges = answers_line_ranges(df, text, key)
    lo, hi = F.col("lo").try_cast("bigint"), F.col("hi").try_cast("bigint")
    lost = (F.col("lo") <= F.col("hi")) & (lo.isNull() | hi.isNull() | ((F.col("hi") - F.col("lo")) >= _SPAN**3))
    none = F.lit(None).cast("bigint")
    cut = ranges.withColumn("_lost", F.coalesce(lost, F.lit(False))).withColumns({"_lo": F.when(~F.col("_lost"), lo), "_hi": F.when(~F.col("_lost"), hi)})
    out = cut.where("_lost OR _lo IS NULL OR _lo <= _hi").select(
        key, "file", "ord", "_lo", "_hi", F.when(F.col("_lost"), F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))).alias("unexpanded"))
    for step in (_SPAN**2, _SPAN, 1):
        spans = F.when(F.col("_lo").isNull(), F.array(none)).when(F.col("_lo") <= F.col("_hi"), F.sequence(F.col("_lo"), F.col("_hi"), F.lit(step)))
        out = out.select(key, "file", "ord", "unexpanded", F.coalesce("_first", "_lo").alias("_first") if "_first" in out.columns else F.col("_lo").alias("_first"),
                         F.col("_hi").alias("_end"), F.explode(spans).alias("_lo"))
        out = out.withColumn("_hi", F.col("_lo") + F.least(F.col("_end") - F.col("_lo"), F.lit(step - 1))).drop("_end")
    place = F.struct(F.col("ord.li").alias("li"), F.col("ord.bi").alias("bi"), F.coalesce(F.col("_lo") - F.col("_first"), F.lit(0)).alias("k"))
    return out.select(key, "file", F.col("_lo").alias("line_no"), "unexpanded", place.alias("ord"))


def answers_path(text: Column) -> Column:
    return py_strip(text)


# ── truncation ─────────────────────────────────────────────────────────────


def truncate_middle_chars(text: Column, max_chars: int) -> Column:
    """Over ``max``: first ``max//2`` chars, a ``[k characters truncated]``
    marker (k = len - max), last ``max//2`` chars (all of it when half is 0)."""
    half = max_chars // 2
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    tail = F.right(t, F.lit(half)) if half > 0 else t
    marker = F.concat(F.lit("\n\n... ["), (n - max_chars).cast("string"), F.lit(" characters truncated] ...\n\n"))
    return F.when(n > max_chars, F.concat(F.left(t, F.lit(half)), marker, tail)).otherwise(text)


def _is_continuation(data: Column, pos: Column) -> Column:
    """UTF-8 byte ``pos`` (1-based) of ``data`` is a continuation byte (10xxxxxx)."""
    return F.substring(F.hex(F.substring(data, pos, 1)), 1, 1).isin("8", "9", "A", "B")


def truncate_middle_bytes(text: Column, max_bytes: int) -> Column:
    """Same on UTF-8 bytes (``[... k bytes omitted ...]``); characters cut
    at the edges are dropped, as ``bytes.decode(errors='ignore')`` does.

    All in the JVM: the head is cut back to the last character boundary at
    or before ``max//2`` bytes and the tail starts at the first boundary of
    the last ``max//2`` bytes (a UTF-8 character has at most 3 continuation
    bytes, so at most 3 bytes are inspected at each edge)."""
    half = max_bytes // 2
    t = F.coalesce(text, F.lit(""))
    data = F.encode(t, "UTF-8")
    n = F.octet_length(t)
    h = F.lit(half)
    drop = (F.when(~_is_continuation(data, h + 1), F.lit(0)).when(~_is_continuation(data, h), F.lit(1))
            .when(~_is_continuation(data, h - 1), F.lit(2)).otherwise(F.lit(3)))
    head = F.decode(F.substring(data, F.lit(1), h - drop), "UTF-8") if half > 0 else F.lit("")
    start = n - half + 1
    skip = (F.when(~_is_continuation(data, start), F.lit(0)).when(~_is_continuation(data, start + 1), F.lit(1))
            .when(~_is_continuation(data, start + 2), F.lit(2)).otherwise(F.lit(3)))
    tail = F.decode(F.substring(data, start + skip, h - skip), "UTF-8") if half > 0 else t
    cut = F.concat(head, F.lit("\n[... "), (n - 2 * half).cast("string"), F.lit(" bytes omitted ...]\n"), tail)
    return F.when(n <= max_bytes, text).otherwise(cut)


def tail_chars(text: Column, n: int = 2000) -> Column:
    """The last ``n`` characters (kept test output)."""
    return F.right(text, F.lit(n))


TRUNCATION_NOTE = "\n\n... [content truncated]"


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """At most ``max_tokens`` tokens at 4 characters per token (the rule the
    reader applies when no tokenizer file is available), plus a note."""
    max_chars = max_tokens * 4
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > max_chars, F.concat(F.left(t, F.lit(max_chars)), F.lit(TRUNCATION_NOTE))).otherwise(
        text)
