"""Queries for leak rules, hit filtering, search formatting, pages, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.fixtures import fixture, oracle_with, read_table
from runlens.operators import constraints as CN
from runlens.operators import instances as I
from runlens.operators import leaks as L
from runlens.operators import search as SR
from runlens.plans.registry import register

# ── shared oracle fragments ────────────────────────────────────────────────

_ESC = "regexp_replace({x}, '([()\\[\\]{{}}?*+\\-|^$\\\\.&~# ])', '\\\\\\1', 'g')"
_FULL_REPO = ("CASE WHEN coalesce(user_name, '') <> '' AND coalesce(repo, '') <> '' "
              "THEN concat(user_name, '/', repo) ELSE coalesce(repo, '') END")
_PARTS = f"""parts AS (SELECT instance_id, {_FULL_REPO} AS full_repo, string_split(trim({_FULL_REPO}), '/') AS p,
    language IN ('en', 'de') AS search FROM fx_instances),
own AS (SELECT instance_id, full_repo, search,
    CASE WHEN len(p) >= 2 AND p[1] <> '' THEN {_ESC.format(x='p[1]')} END AS eo,
    {_ESC.format(x='CASE WHEN len(p) >= 2 THEN p[2] ELSE p[1] END')} AS en,
    CASE WHEN len(p) >= 2 THEN p[2] ELSE p[1] END AS name FROM parts)"""


def _instances_with_repo(spark, sf):
    inst = fixture(spark, sf, "fx_instances")
    return inst.select("instance_id", I.full_repo_name(F.col("user_name"), F.col("repo")).alias("repo"),
                       F.col("language").isin("en", "de").alias("search"))


# ── repo rules ─────────────────────────────────────────────────────────────

_RULES_SQL = """,
rules AS (
  SELECT instance_id, 'url' AS kind, 0 AS ord, concat('.*github\\.com/', coalesce(eo, '[^/]+'), '/', en, '(/|$|\\?).*') AS pattern FROM own WHERE full_repo <> ''
  UNION ALL SELECT instance_id, 'url', 1, concat('.*gitlab\\.com/', coalesce(eo, '[^/]+'), '/', en, '(/|$|\\?).*') FROM own WHERE full_repo <> ''
  UNION ALL SELECT instance_id, 'url', 2, concat('.*raw\\.githubusercontent\\.com/.*/', en, '/.*') FROM own WHERE full_repo <> ''
  UNION ALL SELECT instance_id, 'command', 0, concat('.*git\\s+clone\\s+.*', en, '.*') FROM own WHERE full_repo <> '' AND name <> ''
  UNION ALL SELECT instance_id, 'command', 1, concat('.*git\\s+fetch\\s+.*', en, '.*') FROM own WHERE full_repo <> '' AND name <> ''
  UNION ALL SELECT instance_id, 'command', 2, concat('.*github\\.io/', coalesce(eo, '[^/]+'), '/', en, '.*') FROM own WHERE full_repo <> '' AND name <> ''
  UNION ALL SELECT instance_id, 'command', 3, concat('.*api\\.github\\.com/repos/', coalesce(eo, '[^/]+'), '/', en, '.*') FROM own WHERE full_repo <> '' AND name <> ''
  UNION ALL SELECT instance_id, 'command', 4, concat('.*raw\\.githubusercontent\\.com/', coalesce(eo, '[^/]+'), '/', en, '.*') FROM own WHERE full_repo <> '' AND name <> '')"""


@register("repo_rules", oracle_with("fx_instances") + ",\n" + _PARTS + _RULES_SQL
          + "\nSELECT instance_id, kind, CAST(ord AS INTEGER) AS ord, pattern FROM rules")
def q_repo_rules(spark, sf):
    return L.repo_rules(_instances_with_repo(spark, sf))


@register(
    "repo_leak_join",
    oracle_with("fx_instances", "fx_hits") + ",\n" + _PARTS + _RULES_SQL + """
SELECT h.hit_id, h.instance_id, h.url,
  coalesce(bool_or(regexp_matches(h.url, concat('^(?:', r.pattern, ')'), 'i')), false) AS blocked
FROM fx_hits h LEFT JOIN rules r ON r.instance_id = h.instance_id AND r.kind = 'url'
GROUP BY h.hit_id, h.instance_id, h.url""",
)
def q_repo_leak_join(spark, sf):
    hits = fixture(spark, sf, "fx_hits").select("hit_id", "instance_id", "url")
    return L.repo_leak_join(hits, _instances_with_repo(spark, sf)).select("hit_id", "instance_id", "url", "blocked")


# ── fixed rule lists ───────────────────────────────────────────────────────

URL_RULES = [r".*\.example\.com/en/.*", r"https?://m\.", r".*[?&]ref=x", r"(unclosed", r".*EXAMPLE\.ORG/fr/\d+$"]
HIT_RULES = {"url": [r".*\.example\.net/.*"], "title": [r"th", r".* on .*"]}


def _or_rules(col: str, rules: list[str]) -> str:
    import re as _re

    ok = []
    for p in rules:
        try:
            _re.compile(p)
            ok.append(p)
        except _re.error:
            pass
    return "(" + " OR ".join(f"regexp_matches({col}, '^(?:{p})', 'i')" for p in ok) + ")"


@register("block_urls", oracle_with("fx_search") + f"\nSELECT query_id, CAST(position AS INTEGER) AS position, url, {_or_rules('url', URL_RULES)}"
          " AS blocked FROM fx_search")
def q_block_urls(spark, sf):
    hits = fixture(spark, sf, "fx_search").select("query_id", "position", "url")
    return L.block_urls(hits, URL_RULES)


_HIT_BLOCK = f"({_or_rules('url', HIT_RULES['url'])} OR {_or_rules('title', HIT_RULES['title'])})"


@register("filter_hits", oracle_with("fx_search") + f"\nSELECT query_id, CAST(position AS INTEGER) AS position, {_HIT_BLOCK} AS blocked FROM fx_search")
def q_filter_hits(spark, sf):
    hits = fixture(spark, sf, "fx_search")
    return L.filter_hits(hits, HIT_RULES).select("query_id", "position", "blocked")


# stand-in constraints: the repo rules of every instance, rules that name what the
# titles start with, for all scopes, and broken ones
_TABLE_RULES = """,
titles AS (SELECT DISTINCT substr(title, 1, 9) AS t FROM fx_hits WHERE title <> ''),
constraints AS (
  SELECT instance_id AS scope_id, 'url' AS field, pattern FROM rules WHERE kind = 'url'
  UNION ALL SELECT NULL, 'title', concat('.*', regexp_replace(t, '[^A-Za-z ]', '.', 'g'), '$') FROM titles
  UNION ALL SELECT NULL, 'url', '.*/(issues|pulls)/[0-9]+' UNION ALL SELECT 'I-3', 'url', '.*' UNION ALL SELECT 'I-5', 'body', 'x+')"""


@register(
    "filter_hits_table",
    oracle_with("fx_instances", "fx_hits") + ",\n" + _PARTS + _RULES_SQL + _TABLE_RULES + """
SELECT h.hit_id, h.instance_id, coalesce(bool_or(regexp_matches(CASE r.field WHEN 'url' THEN coalesce(h.url, '') WHEN 'title' THEN coalesce(h.title, '') ELSE '' END,
    concat('^(?:', r.pattern, ')'), 'i')), false) AS blocked
FROM fx_hits h LEFT JOIN constraints r ON r.scope_id IS NULL OR r.scope_id = h.instance_id
GROUP BY h.hit_id, h.instance_id""",
)
def q_filter_hits_table(spark, sf):
    hits = fixture(spark, sf, "fx_hits").select("hit_id", "instance_id", "url", "title")
    repo = L.repo_rules(_instances_with_repo(spark, sf)).where("kind = 'url'").select(F.col("instance_id").alias("scope_id"), F.lit("url").alias("field"), "ord", "pattern")
    titles = hits.where("title <> ''").select(F.substring("title", 1, 9).alias("t")).distinct().select(
        F.lit(None).cast("string").alias("scope_id"), F.lit("title").alias("field"), F.lit(0).alias("ord"),
        F.concat(F.lit(".*"), F.regexp_replace("t", "[^A-Za-z ]", "."), F.lit("$")).alias("pattern"))
    more = spark.createDataFrame([(None, "url", 0, ".*/(issues|pulls)/[0-9]+"), (None, "url", 1, "(unclosed"), ("I-3", "url", 0, ".*"),
                                  ("I-3", "url", 1, "[z-a]"), ("I-5", "body", 0, "x+")], "scope_id string, field string, ord int, pattern string")
    rules = L.merge_constraints(repo.unionByName(titles), more)
    return CN.filter_hits_by_rules(hits, rules, ["hit_id"], scope="instance_id").select("hit_id", "instance_id", "blocked")


_QTEXT = "CASE query_id WHEN 3 THEN '   ' ELSE concat('query ', CAST(query_id AS STRING)) END"
_START, _NUM = 5, 10
_PAGE_SQL = f""",
flagged AS (SELECT *, {_HIT_BLOCK} AS blocked FROM fx_search),
q AS (SELECT DISTINCT query_id, {_QTEXT} AS query FROM fx_search),
aq AS (SELECT * FROM q WHERE trim(query) <> ''),
page AS (SELECT f.* FROM flagged f JOIN aq ON f.query_id = aq.query_id
         WHERE position BETWEEN {_START + 1} AND {_START + _NUM}),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS BIGINT) AS rank
         FROM page WHERE NOT blocked)"""


def _search_inputs(spark, sf):
    hits = L.filter_hits(fixture(spark, sf, "fx_search"), HIT_RULES)
    queries = hits.select("query_id").distinct().select("query_id", F.expr(_QTEXT).alias("query"))
    return hits, queries


@register("page_hits", oracle_with("fx_search") + _PAGE_SQL + "\nSELECT query_id, CAST(position AS INTEGER) AS position, rank, url FROM kept")
def q_page_hits(spark, sf):
    hits, queries = _search_inputs(spark, sf)
    return SR.page_hits(hits, queries, num=_NUM, start=_START).select("query_id", "position", "rank", "url")


@register(
    "format_hits",
    oracle_with("fx_search") + _PAGE_SQL + """,
cnt AS (SELECT query_id, count(*) FILTER (WHERE blocked) AS nb FROM page GROUP BY 1),
ent AS (SELECT query_id, rank, concat('[', CAST(rank AS VARCHAR), ']', chr(10), '  title: ', title, chr(10),
               '  url: ', url, chr(10)) AS entry FROM kept),
body AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY rank) AS body, count(*) AS n FROM ent GROUP BY 1)
SELECT aq.query_id, concat('Search results for: ', aq.query,
  CASE WHEN coalesce(cnt.nb, 0) > 0 THEN concat(chr(10), 'WARNING: ', CAST(cnt.nb AS VARCHAR),
       ' result(s) filtered by security constraints.') ELSE '' END,
  CASE WHEN coalesce(body.n, 0) > 0 THEN concat(chr(10), chr(10), body.body) ELSE concat(chr(10), 'No results found.') END)
  AS text
FROM aq LEFT JOIN cnt ON aq.query_id = cnt.query_id LEFT JOIN body ON aq.query_id = body.query_id""",
)
def q_format_hits(spark, sf):
    hits, queries = _search_inputs(spark, sf)
    return SR.format_hits(hits.select("query_id", "position", "title", "url", "blocked"), queries,
                          num=_NUM, start=_START)


# ── pages ──────────────────────────────────────────────────────────────────

# stand-in reader output: title, the ad line as description, article text
# without tags as content, nav anchors as links
_READER = {
    "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "description": "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)",
    "content": "regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')",
}
_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def _reader(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select(
        "page_id", "url",
        F.expr(_READER["title"]).alias("title"),
        F.expr(_READER["description"]).alias("description"),
        F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), "<[^>]*>", "").alias("content"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), 2).alias("link_text"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), 1).alias("link_href"),
    )


_MD_SQL = f"""r AS (SELECT page_id, url, {_READER['title']} AS title, {_READER['description']} AS description,
          {_READER['content']} AS content FROM pages),
lk AS (SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS t,
          unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS h,
          generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 1), 1) AS i FROM pages),
lk1 AS (SELECT page_id, t, min(i) AS first, arg_max(h, i) AS h FROM lk GROUP BY 1, 2),
links AS (SELECT page_id, string_agg(concat('- [', t, '](', h, ')'), chr(10) ORDER BY first) AS lines
          FROM lk1 GROUP BY 1),
md AS (SELECT r.page_id, r.url, r.title,
  CASE WHEN coalesce(content, '') = '' AND coalesce(title, '') = '' THEN ''
  ELSE concat_ws(chr(10),
    CASE WHEN title <> '' THEN concat('# ', title, chr(10)) END,
    CASE WHEN description <> '' AND NOT contains(left(content, 200), description)
         THEN concat('> ', description, chr(10)) END,
    CASE WHEN content <> '' THEN content END,
    CASE WHEN links.lines IS NOT NULL THEN concat(chr(10), '## Links', chr(10), links.lines) END) END AS markdown
  FROM r LEFT JOIN links ON r.page_id = links.page_id)"""


@register("page_markdown", "WITH " + _MD_SQL + "\nSELECT page_id, markdown FROM md")
def q_page_markdown(spark, sf):
    return SR.page_markdown(_reader(spark, sf)).select("page_id", "markdown")


_GOAL = "CASE WHEN page_id % 5 = 0 THEN '  ' ELSE 'list the languages mentioned' END"
_REQ_URL = "CASE WHEN page_id % 7 = 0 THEN '' ELSE url END"


@register(
    "summary_requests",
    "WITH " + _MD_SQL + f""",
req AS (SELECT page_id, trim({_REQ_URL}) AS u, trim({_GOAL}) AS g, markdown FROM md),
st AS (SELECT *, CASE WHEN u = '' THEN 'empty_url' WHEN g = '' THEN 'empty_goal'
                      WHEN {_or_rules('u', URL_RULES)} THEN 'blocked' ELSE 'ok' END AS status FROM req)
SELECT page_id, status, CASE status WHEN 'empty_url' THEN 'Error: empty URL.'
  WHEN 'empty_goal' THEN 'Error: empty goal. Please describe what information you need.'
  WHEN 'blocked' THEN concat('ACCESS DENIED: The URL ''', u, ''' is blocked by security constraints. This URL may point '
    || 'to the target repository and accessing it is not allowed during evaluation.')
  ELSE concat('## URL', chr(10), u, chr(10), chr(10), '## Goal', chr(10), g, chr(10), chr(10), '## Page Content',
              chr(10), markdown) END AS message
FROM st""",
)
def q_summary_requests(spark, sf):
    md = SR.page_markdown(_reader(spark, sf))
    req = md.select("page_id", F.expr(_REQ_URL).alias("url"), F.expr(_GOAL).alias("goal"), "markdown")
    req = L.block_urls(req, URL_RULES)
    return SR.summary_requests(req).select("page_id", "status", "message")


# ── commands ───────────────────────────────────────────────────────────────

EXTRA_RULES = [r".*rm -rf /.*", r".*git pull.*", r".*curl .*"]


def _sql_list(items: list[str]) -> str:
    """A DuckDB list literal of string constants."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]::VARCHAR[]"


_BL_SQL = f""",
bl AS (SELECT instance_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, unnest(l) AS pattern FROM (
  SELECT instance_id, list_concat(
    {_sql_list(L.ALWAYS_BLOCKED)},
    CASE WHEN search THEN []::VARCHAR[] ELSE {_sql_list(L.NON_SEARCH_BLOCKED)} END,
    {_sql_list([p for p in EXTRA_RULES if p not in L.ALWAYS_BLOCKED])},
    CASE WHEN full_repo <> '' AND name <> '' THEN [
      concat('.*git\\s+clone\\s+.*', en, '.*'), concat('.*git\\s+fetch\\s+.*', en, '.*'),
      concat('.*github\\.io/', coalesce(eo, '[^/]+'), '/', en, '.*'),
      concat('.*api\\.github\\.com/repos/', coalesce(eo, '[^/]+'), '/', en, '.*'),
      concat('.*raw\\.githubusercontent\\.com/', coalesce(eo, '[^/]+'), '/', en, '.*')] ELSE []::VARCHAR[] END) AS l
  FROM own))"""


@register("effective_blocklist", oracle_with("fx_instances") + ",\n" + _PARTS + _BL_SQL
          + "\nSELECT instance_id, ord, pattern FROM bl")
def q_effective_blocklist(spark, sf):
    return L.effective_blocklist(_instances_with_repo(spark, sf), EXTRA_RULES)


_CMD = """CASE turn % 8
  WHEN 0 THEN 'git log --oneline --all'
  WHEN 1 THEN 'git status'
  WHEN 2 THEN concat('cd /tmp', chr(10), 'git fetch')
  WHEN 3 THEN concat('git clone https://github.com/src', CAST(conv_id % 20 AS STRING), '/repo', CAST(conv_id % 7 AS STRING))
  WHEN 4 THEN 'GIT PULL'
  WHEN 5 THEN concat('curl https://api.github.com/repos/x/repo', CAST(conv_id % 7 AS STRING))
  WHEN 6 THEN concat('echo ', role)
  ELSE 'git fetch   origin' END"""


@register(
    "block_commands",
    oracle_with("fx_instances") + ",\n" + _PARTS + _BL_SQL + f""",
calls AS (SELECT concat('I-', CAST(conv_id AS VARCHAR)) AS instance_id, conv_id, turn, {_CMD} AS command
          FROM conversations)
SELECT c.conv_id, c.turn, c.command,
  coalesce(bool_or(regexp_matches(c.command, concat('^(?:', b.pattern, ')'))), false) AS blocked
FROM calls c LEFT JOIN bl b ON b.instance_id = c.instance_id
GROUP BY c.conv_id, c.turn, c.command""",
)
def q_block_commands(spark, sf):
    conv = read_table(spark, sf, "conversations")
    calls = conv.select(F.concat(F.lit("I-"), F.col("conv_id").cast("string")).alias("instance_id"),
                        "conv_id", "turn", F.expr(_CMD).alias("command"))
    bl = L.effective_blocklist(_instances_with_repo(spark, sf), EXTRA_RULES)
    return L.block_commands(calls, bl).select("conv_id", "turn", "command", "blocked")


# ── set operations ─────────────────────────────────────────────────────────


@register(
    "merge_constraints",
    oracle_with("fx_instances") + ",\n" + _PARTS + _RULES_SQL + """,
r2 AS (SELECT instance_id, 'url' AS field, 0 AS ord, concat('.*github\\.com/[^/]+/', repo, '(/|$|\\?).*') AS pattern FROM fx_instances WHERE repo <> ''
  UNION ALL SELECT instance_id, 'url', 1, concat('.*gitlab\\.com/[^/]+/', repo, '(/|$|\\?).*') FROM fx_instances WHERE repo <> ''
  UNION ALL SELECT instance_id, 'url', 2, concat('.*raw\\.githubusercontent\\.com/.*/', repo, '/.*') FROM fx_instances WHERE repo <> ''),
u AS (SELECT instance_id AS scope_id, 'url' AS field, ord, pattern, 0 AS src FROM rules WHERE kind = 'url'
      UNION ALL SELECT instance_id, field, ord, pattern, 1 FROM r2),
f AS (SELECT scope_id, field, pattern, min(src * 1000 + ord) AS first_at FROM u GROUP BY 1, 2, 3)
SELECT scope_id, field, CAST(row_number() OVER (PARTITION BY scope_id, field ORDER BY first_at) - 1 AS INTEGER) AS ord,
  pattern FROM f""",
)
def q_merge_constraints(spark, sf):
    left = L.repo_rules(_instances_with_repo(spark, sf)).where(F.col("kind") == "url").select(
        F.col("instance_id").alias("scope_id"), F.lit("url").alias("field"), "ord", "pattern")
    right = L.repo_rules(fixture(spark, sf, "fx_instances").select("instance_id", "repo")).where(
        F.col("kind") == "url").select(F.col("instance_id").alias("scope_id"), F.lit("url").alias("field"),
                                        "ord", "pattern")
    return L.merge_constraints(left, right).select("scope_id", "field", F.col("ord").cast("int").alias("ord"),
                                                   "pattern")


# ── patches ────────────────────────────────────────────────────────────────

_PATCH = """concat('diff --git a/src/', lang, '.py b/src/', lang, '.py', chr(10), '+x', chr(10),
  'diff --git a/build/out.o b/build/out.o', chr(10),
  'diff --git a/', source, '/node_modules/m.js b/', source, '/node_modules/m.js', chr(10),
  'diff --git a/img/', source, '.png b/img/', source, '.png', chr(10),
  'diff --git a/target/classes/A.class b/target/classes/A.class', chr(10),
  'diff --git a/lib/x.ts b/lib/x.ts', chr(10),
  'diff --git a/project/target/q b/project/target/q', chr(10),
  'diff --git a/docs/Build/notes.md b/docs/Build/notes.md')"""
_PLANG = """CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'Java' WHEN 2 THEN ' JavaScript ' WHEN 3 THEN 'typescript'
  WHEN 4 THEN 'scala' ELSE 'cobol' END"""


def _patch_oracle() -> str:
    cases = []
    for canon, aliases in L.LANGUAGE_ALIAS.items():
        rx = L.gitignore_regex(L.DEFAULT_GITIGNORE + L.LANGUAGE_GITIGNORES[canon]).replace("'", "''")
        cases.append(f"WHEN lang IN ({', '.join(repr(a) for a in aliases)}) THEN regexp_matches(file, '{rx}')")
    default = L.gitignore_regex(L.DEFAULT_GITIGNORE).replace("'", "''")
    return f"""WITH p AS (SELECT concat('I-', CAST(doc_id AS VARCHAR)) AS instance_id, {_PATCH} AS patch,
    lower(trim({_PLANG})) AS lang FROM documents),
f AS (SELECT instance_id, lang, unnest(regexp_extract_all(patch, '(?m)^diff --git a/(\\S+) b/', 1)) AS file,
    CAST(generate_subscripts(regexp_extract_all(patch, '(?m)^diff --git a/(\\S+) b/', 1), 1) - 1 AS INTEGER) AS file_pos
    FROM p)
SELECT instance_id, file_pos, file, CASE {' '.join(cases)} ELSE regexp_matches(file, '{default}') END AS is_artefact
FROM f"""


@register("patch_files", _patch_oracle())
def q_patch_files(spark, sf):
    docs = read_table(spark, sf, "documents")
    patches = docs.select(F.concat(F.lit("I-"), F.col("doc_id").cast("string")).alias("instance_id"),
                          F.expr(_PATCH).alias("patch"), F.expr(_PLANG).alias("language"))
    return L.patch_files(patches).select("instance_id", F.col("file_pos").cast("int").alias("file_pos"), "file",
                                         "is_artefact")
