"""Queries for message / call tables, answers and truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.operators import messages as M
from runlens.plans.registry import register

# ── validity and XML calls ─────────────────────────────────────────────────

_NCALLS = "CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END"
_FINISH = "CASE WHEN turn % 5 = 4 THEN 'length' ELSE 'stop' END"
_CONTENT = "CASE WHEN turn % 7 = 6 THEN '' ELSE content END"


@register(
    "valid_response",
    oracle_with("fx_messages") + f"""
SELECT conv_id, turn, (coalesce({_CONTENT}, '') <> '' OR {_NCALLS} > 0) AND {_FINISH} <> 'length' AS valid
FROM fx_messages""",
)
def q_valid_response(spark, sf):
    m = fixture(spark, sf, "fx_messages")
    return m.select("conv_id", "turn", M.valid_response(F.expr(_CONTENT), F.expr(_NCALLS), F.expr(_FINISH))
                    .alias("valid"))


# stand-in assistant messages carrying XML calls in the shapes the parser meets
_XML = """CASE turn % 7
  WHEN 0 THEN concat('Let me look.', chr(10), '<function=execute_bash>', chr(10), '<parameter=command>ls -la ', role,
                     '</parameter>', chr(10), '</function>')
  WHEN 1 THEN concat('<function=a>', chr(10), '<parameter=x> 1 </parameter>', chr(10), '</function> then ',
                     '<function=b>', chr(10), '<parameter=y>2</parameter>', chr(10), '</function>')
  WHEN 2 THEN concat('<function=str_replace_editor>', chr(10), '<parameter=command>create</parameter>', chr(10),
                     '<parameter=file_text>line1', chr(10), role, '</parameter>', chr(10),
                     '<parameter=command>view</parameter>', chr(10), '</function>')
  WHEN 3 THEN concat('<function=finish>', chr(10), '<parameter=answer> ', CAST(conv_id AS STRING), ' </parameter>  ')
  WHEN 4 THEN concat('<function=finish>', chr(10), '<parameter=answer>', role, '</parameter>', chr(10), '</')
  WHEN 5 THEN concat('<function=x>', chr(10), '<parameter=a>1</parameter>', chr(10), '<parameter=b>2', chr(10),
                     '</function>')
  ELSE content END"""

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _xml_oracle() -> str:
    return oracle_with("fx_messages") + f""",
c0 AS (SELECT conv_id, turn, {_XML} AS content FROM fx_messages),
c1 AS (SELECT conv_id, turn, content,
  CASE WHEN (length(content) - length(replace(content, '<function=', ''))) / 10 = 1
            AND NOT contains(content, '</function>')
       THEN CASE WHEN suffix(rtrim(content, {_WS}), '</') THEN concat(rtrim(content, {_WS}), 'function>')
                 ELSE concat(rtrim(content, {_WS}), chr(10), '</function>') END
       ELSE content END AS fixed FROM c0),
c2 AS (SELECT conv_id, turn, content, regexp_matches(fixed, '(?s)<function=([^>]+)>\\n?(.*?)</function>') AS has,
  trim(regexp_extract(fixed, '(?s)<function=([^>]+)>\\n?(.*?)</function>', 1), {_WS}) AS name,
  regexp_extract(fixed, '(?s)<function=([^>]+)>\\n?(.*?)</function>', 2) AS body FROM c1),
p AS (SELECT conv_id, turn, unnest(regexp_extract_all(body, '(?s)<parameter=([^>]+)>(.*?)</parameter>', 1)) AS k,
  unnest(regexp_extract_all(body, '(?s)<parameter=([^>]+)>(.*?)</parameter>', 2)) AS v,
  generate_subscripts(regexp_extract_all(body, '(?s)<parameter=([^>]+)>(.*?)</parameter>', 1), 1) AS i FROM c2),
p1 AS (SELECT conv_id, turn, trim(k, {_WS}) AS k, min(i) AS first_i, arg_max(trim(v, {_WS}), i) AS v
       FROM p GROUP BY 1, 2, 3),
pa AS (SELECT conv_id, turn, string_agg(concat(k, '=', v), '|' ORDER BY first_i) AS params, count(*) AS n
       FROM p1 GROUP BY 1, 2)
SELECT c2.conv_id, c2.turn,
  CASE WHEN coalesce(c2.content, '') <> '' AND has THEN name END AS name,
  CASE WHEN coalesce(c2.content, '') <> '' AND has THEN CAST(coalesce(pa.n, 0) AS INTEGER) END AS n_params,
  CASE WHEN coalesce(c2.content, '') <> '' AND has THEN coalesce(pa.params, '') END AS params,
  CASE WHEN coalesce(c2.content, '') <> '' AND has THEN
    (length(body) - length(replace(body, '<parameter=', ''))) / 11
      <> (length(body) - length(replace(body, '</parameter>', ''))) / 12 END AS mismatched
FROM c2 LEFT JOIN pa ON c2.conv_id = pa.conv_id AND c2.turn = pa.turn"""


@register("extract_xml_calls", _xml_oracle())
def q_extract_xml_calls(spark, sf):
    m = fixture(spark, sf, "fx_messages").select("conv_id", "turn", F.expr(_XML).alias("content"))
    x = m.select("conv_id", "turn", M.extract_xml_calls(F.col("content")).alias("x"))
    pairs = F.transform(F.arrays_zip(F.col("x.param_names").alias("k"), F.col("x.param_values").alias("v")),
                        lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return x.select("conv_id", "turn", F.col("x.name").alias("name"), F.size("x.param_names").alias("n_params"),
                    F.array_join(pairs, "|").alias("params"), F.col("x.mismatched").alias("mismatched"))


# ── JSON commands ─────────────────────────────────────────────────────────

_JSON_TEXT = """CASE turn % 6
  WHEN 0 THEN concat('{"analysis": "a", "plan": "p", "commands": [{"keystrokes": "ls ', role,
                     '\\\\n", "duration": 0.5}], "task_complete": false}')
  WHEN 1 THEN concat('Sure. {"analysis": "x", "plan": "y", "commands": [{"keystrokes": "cd /"}],',
                     ' "task_complete": "yes"} done')
  WHEN 2 THEN concat('{"analysis": "unterminated", "plan": "p", "commands": [{"keystrokes": "', role, '", "duration": 1}]')
  WHEN 3 THEN concat('{"plan": "missing fields", "commands": []}')
  WHEN 4 THEN concat('{"analysis": "a", "plan": "p", "commands": [{"duration": 2}], "task_complete": true}')
  ELSE text END"""


# the rows of every shape, written out
_JSON_ORACLE = """
SELECT conv_id, turn, turn % 6 IN (1, 4) AS is_complete,
  CASE turn % 6 WHEN 3 THEN 'Missing required fields: analysis' WHEN 5 THEN 'No valid JSON found in response' ELSE '' END AS error,
  CASE turn % 6
    WHEN 1 THEN concat('- Extra text before JSON', chr(10), '- Extra text after JSON', chr(10), '- Command 1: missing duration, using 1.0')
    WHEN 2 THEN '- AUTO-CORRECTED: Fixed incomplete JSON'
    WHEN 4 THEN '- Command 1 missing ''keystrokes'''
    WHEN 5 THEN '- No valid JSON object found' ELSE '' END AS warning,
  CASE WHEN turn % 6 IN (0, 1, 2) THEN CAST(0 AS INTEGER) END AS pos,
  CASE turn % 6 WHEN 0 THEN concat('ls ', role, chr(10)) WHEN 1 THEN 'cd /' WHEN 2 THEN role END AS keystrokes,
  CASE turn % 6 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(1 AS DOUBLE) END AS duration
FROM conversations"""


@register("extract_json_commands", _JSON_ORACLE)
def q_extract_json_commands(spark, sf):
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_JSON_TEXT).alias("response"))
    out = M.extract_json_commands(conv, "response", ["conv_id", "turn"])
    rows = out.select("conv_id", "turn", "is_complete", "error", "warning", F.posexplode_outer("commands").alias("pos", "c"))
    return rows.select("conv_id", "turn", "is_complete", "error", "warning", "pos", "c.keystrokes", "c.duration")


# ── tool calls, chat rows, observations ────────────────────────────────────

KNOWN_TOOLS = ["execute_bash", "str_replace_editor"]
_ARGS = """CASE WHEN completion_tokens % 9 = 0 THEN '{bad json' ELSE concat('{"command": "step ', CAST(step AS STRING),
  '"}') END"""


def _steps_with_calls(spark, sf):
    calls = fixture(spark, sf, "fx_calls")
    args = F.expr(_ARGS)
    flat = F.struct(F.concat(F.lit("call_"), F.col("step").cast("string")).alias("id"),
                    F.col("tool_name").alias("name"), args.alias("arguments"),
                    F.lit(None).cast("struct<name:string,arguments:string>").alias("function"))
    nested = F.struct(F.concat(F.lit("call_"), F.col("step").cast("string")).alias("id"),
                      F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
                      F.struct(F.col("tool_name").alias("name"), args.alias("arguments")).alias("function"))
    return calls.select("run_id", "step", F.array(F.when(F.col("step") % 2 == 0, flat).otherwise(nested))
                        .alias("tool_calls"))


_CALL_ERR = f"""CASE WHEN tool_name NOT IN ('execute_bash', 'str_replace_editor')
    THEN concat('Error: tool ''', tool_name, ''' not found.')
  WHEN completion_tokens % 9 = 0 THEN concat('Error: invalid JSON arguments: ', {_ARGS}) END"""


@register(
    "tool_call_rows",
    oracle_with("fx_calls") + f"""
SELECT run_id, CAST(step AS INTEGER) AS step, CAST(0 AS INTEGER) AS call_pos, concat('call_', CAST(step AS VARCHAR)) AS call_id,
  tool_name AS name, {_ARGS} AS arguments, {_CALL_ERR} AS error_obs FROM fx_calls""",
)
def q_tool_call_rows(spark, sf):
    return M.tool_call_rows(_steps_with_calls(spark, sf), KNOWN_TOOLS)


@register(
    "format_messages",
    """WITH s AS (SELECT conv_id AS run_id, turn AS step, CASE WHEN role = 'user' THEN '' ELSE text END AS content,
    CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls, string_split(text, chr(10)) AS obs FROM conversations),
rows AS (SELECT run_id, step, 0 AS pos, 'assistant' AS role, nullif(content, '') AS content, n_calls > 0 AS has_tool_calls
         FROM s
  UNION ALL SELECT run_id, step, generate_subscripts(obs, 1) AS pos, 'tool', unnest(obs), false FROM s)
SELECT run_id, step, CAST(pos AS INTEGER) AS pos, role, content, has_tool_calls FROM rows""",
)
def q_format_messages(spark, sf):
    conv = read_table(spark, sf, "conversations")
    steps = conv.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"),
                        F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("text")).alias("content"),
                        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("n_tool_calls"),
                        F.split("text", "\n").alias("observations"))
    return M.format_messages(steps)


@register(
    "format_observations",
    oracle_with("fx_calls") + f""",
c AS (SELECT run_id, step, concat('call_', CAST(step AS VARCHAR)) AS call_id, tool_name AS name,
        coalesce({_CALL_ERR}, 'ok') AS observation FROM fx_calls)
SELECT run_id, CAST(step AS INTEGER) AS step, CASE WHEN run_id % 2 = 0 THEN 'user' ELSE 'tool' END AS role,
  CASE WHEN run_id % 2 = 0 THEN concat('OBSERVATION:', chr(10), '[', name, ']', chr(10), observation)
       ELSE observation END AS content,
  CASE WHEN run_id % 2 = 0 THEN NULL ELSE call_id END AS tool_call_id,
  CASE WHEN run_id % 2 = 0 THEN NULL ELSE name END AS tool_name FROM c""",
)
def q_format_observations(spark, sf):
    # text-mode agents on even runs, native tool messages on odd runs
    rows = M.tool_call_rows(_steps_with_calls(spark, sf), KNOWN_TOOLS).withColumn(
        "observation", F.coalesce(F.col("error_obs"), F.lit("ok")))
    text = M.format_observations(rows.where(F.col("run_id") % 2 == 0), text_mode=True)
    native = M.format_observations(rows.where(F.col("run_id") % 2 == 1), text_mode=False)
    cols = ["run_id", "step", "role", "content", "tool_call_id", "tool_name"]
    return text.select(*cols).unionByName(native.select(*cols))


# ── typed answers ──────────────────────────────────────────────────────────

_ANSWER = """CASE event_type
  WHEN 'purchase' THEN replace(props, '"k"', '"answer"')
  WHEN 'click' THEN concat('{"answer": " ', regexp_extract(props, '([0-9]+)', 1), ' "}')
  WHEN 'view' THEN concat('{"answer": ', CAST(round(value, 2) AS STRING), '}')
  WHEN 'signup' THEN '{}'
  ELSE '{"answer": "x1"}' END"""


@register(
    "answers_int",
    f"""WITH a AS (SELECT event_id, event_type, {_ANSWER} AS params, value FROM events)
SELECT event_id, CASE event_type
  WHEN 'purchase' THEN TRY_CAST(json_extract_string(params, '$.answer') AS BIGINT)
  WHEN 'click' THEN TRY_CAST(trim(json_extract_string(params, '$.answer')) AS BIGINT)
  WHEN 'view' THEN CAST(trunc(round(value, 2)) AS BIGINT) END AS answer FROM a""",
)
def q_answers_int(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", M.answers_int(F.expr(_ANSWER)).alias("answer"))


_PYSTRIP_SQL = "regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+$', '', 'g')"


@register(
    "answers_files",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS f,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, {_PYSTRIP_SQL.format(x='f')} AS f FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, f AS file
FROM s WHERE f <> ''""",
)
def q_answers_files(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(M.answers_files(F.col("text"))).alias("pos", "file"))


_LINES = """concat('src/a', CAST(o_custkey % 5 AS STRING), '.py:', CAST(o_orderkey % 50 AS STRING), ',',
  CAST(o_orderkey % 7 AS STRING), chr(10), ' lib/b.py : ', CAST(o_custkey % 20 AS STRING), '-',
  CAST(o_custkey % 20 + o_orderkey % 4 - 1 AS STRING), chr(10), 'bad line', chr(10),
  'src/a', CAST(o_custkey % 5 AS STRING), '.py:3,x', CAST(o_orderkey % 3 AS STRING), ',9', chr(10),
  'c.py:1:2', chr(10), '  ', chr(10), 'lib/b.py:', CAST(o_orderkey % 11 AS STRING), chr(10),
  'empty', CAST(o_orderkey % 3 AS STRING), '.py:', CASE WHEN o_orderkey % 2 = 0 THEN '9-7' ELSE 'x,1' END, chr(10),
  'far.py:', CAST(99999999990 + o_orderkey % 9 AS STRING), ',', CAST(99999999990 + o_orderkey % 3 AS STRING), '-99999999995')"""


@register(
    "answers_lines",
    f"""WITH t AS (SELECT o_orderkey, {_LINES} AS txt FROM orders),
l AS (SELECT o_orderkey, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS li
      FROM t),
l2 AS (SELECT o_orderkey, li, string_split(trim(line), ':') AS parts FROM l WHERE trim(line) <> ''),
b AS (SELECT o_orderkey, li, trim(parts[1]) AS file, unnest(string_split(parts[2], ',')) AS blk,
        generate_subscripts(string_split(parts[2], ','), 1) AS bi FROM l2 WHERE len(parts) = 2),
b2 AS (SELECT *, trim(blk) AS s, contains(trim(blk), '-') AS is_rng, string_split(trim(blk), '-') AS rng FROM b),
b3 AS (SELECT *, CASE WHEN is_rng THEN len(rng) = 2 AND TRY_CAST(trim(rng[1]) AS BIGINT) IS NOT NULL
                          AND TRY_CAST(trim(rng[2]) AS BIGINT) IS NOT NULL
                 ELSE TRY_CAST(s AS BIGINT) IS NOT NULL END AS ok FROM b2),
ff AS (SELECT o_orderkey, li, min(bi) FILTER (WHERE NOT ok) AS fail FROM b3 GROUP BY 1, 2),
kept AS (SELECT b3.* FROM b3 JOIN ff ON b3.o_orderkey = ff.o_orderkey AND b3.li = ff.li
         WHERE ff.fail IS NULL OR b3.bi < ff.fail),
n AS (SELECT o_orderkey, file, li, bi, unnest(CASE WHEN is_rng THEN
          range(CAST(trim(rng[1]) AS BIGINT), CAST(trim(rng[2]) AS BIGINT) + 1)
          ELSE [CAST(s AS BIGINT)] END) AS line_no FROM kept),
files AS (SELECT DISTINCT o_orderkey, trim(parts[1]) AS file FROM l2
          WHERE len(parts) = 2 AND NOT (contains(trim(string_split(parts[2], ',')[1]), '-')
                                        AND len(string_split(trim(string_split(parts[2], ',')[1]), '-')) <> 2)),
agg AS (SELECT o_orderkey, file, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY li, bi, line_no) AS lines
        FROM n GROUP BY 1, 2)
SELECT f.o_orderkey, f.file, coalesce(a.lines, '') AS lines
FROM files f LEFT JOIN agg a ON f.o_orderkey = a.o_orderkey AND f.file = a.file""",
)
def q_answers_lines(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.expr(_LINES).alias("txt"))
    rows = M.answers_lines(orders, "txt", "o_orderkey")
    per_file = rows.groupBy("o_orderkey", "file").agg(
        F.sort_array(F.collect_list(F.struct("ord.*", "line_no"))).alias("_l"))
    return per_file.select("o_orderkey", "file", F.array_join(F.transform("_l", lambda x: x["line_no"].cast("string")),
                                                             ",").alias("lines"))


_PATH_TEXT = "concat(' ', url, chr(10), ' ')"


@register("answers_path", f"SELECT page_id, {_PYSTRIP_SQL.format(x=_PATH_TEXT)} AS file_path FROM pages")
def q_answers_path(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", M.answers_path(F.concat(F.lit(" "), F.col("url"), F.lit("\n "))).alias("file_path"))


# ── truncation ─────────────────────────────────────────────────────────────

MAX_CHARS, MAX_BYTES, KEEP_TAIL, MAX_TOKENS = 2000, 3000, 2000, 500


@register(
    "truncate_middle_chars",
    f"""SELECT doc_id, CASE WHEN length(text) > {MAX_CHARS} THEN concat(left(text, {MAX_CHARS // 2}), chr(10), chr(10),
  '... [', CAST(length(text) - {MAX_CHARS} AS VARCHAR), ' characters truncated] ...', chr(10), chr(10),
  right(text, {MAX_CHARS // 2})) ELSE text END AS text FROM documents""",
)
def q_truncate_middle_chars(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", M.truncate_middle_chars(F.col("text"), MAX_CHARS).alias("text"))


_BYTES_HALF = MAX_BYTES // 2
# oracle: per long document, characters with their UTF-8 byte counts; the
# head / tail are the longest runs within half the budget (a character cut
# by the byte boundary is dropped)
_BYTES_ORACLE = f"""WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS nb FROM documents),
ch AS (SELECT doc_id, nb, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i
       FROM d WHERE nb > {MAX_BYTES}),
cum AS (SELECT doc_id, nb, c, i,
          sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS fwd,
          sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS bwd
        FROM ch),
ht AS (SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE fwd <= {_BYTES_HALF}), '') AS head,
         coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE bwd <= {_BYTES_HALF}), '') AS tail FROM cum GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.nb <= {MAX_BYTES} THEN d.text
  ELSE concat(ht.head, chr(10), '[... ', CAST(d.nb - {2 * _BYTES_HALF} AS VARCHAR), ' bytes omitted ...]', chr(10), ht.tail)
  END AS text
FROM d LEFT JOIN ht ON d.doc_id = ht.doc_id"""


@register("truncate_middle_bytes", _BYTES_ORACLE)
def q_truncate_middle_bytes(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", M.truncate_middle_bytes(F.col("text"), MAX_BYTES).alias("text"))


@register("tail_chars", f"SELECT doc_id, right(text, {KEEP_TAIL}) AS output_tail FROM documents")
def q_tail_chars(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", M.tail_chars(F.col("text"), KEEP_TAIL).alias("output_tail"))


@register(
    "truncate_tokens",
    f"""SELECT doc_id, CASE WHEN length(text) > {MAX_TOKENS * 4} THEN concat(left(text, {MAX_TOKENS * 4}), chr(10),
  chr(10), '... [content truncated]') ELSE text END AS text FROM documents""",
)
def q_truncate_tokens(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", M.truncate_tokens(F.col("text"), MAX_TOKENS).alias("text"))
