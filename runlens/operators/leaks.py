"""Answer-leak controls: repo rules, URL / hit / command blocking, blocklist
assembly, constraint merging and build-artefact filtering of patches.

The per-instance repo rules are regexes in the reference, checked in a
nested loop.  Here the URL rules become an **equi-join**: candidate
``(host, owner, name)`` triples are extracted from each URL and joined with
the instance's ``(owner, name)`` on ``(instance_id, name)``, so the work is
one shuffle instead of URLs x rules regex evaluations.  Fixed rule lists are
compiled into one regex literal; per-instance command rules are one
alternation per instance, joined on ``instance_id``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.regex import matches_any, py_escape
from runlens.functions.text import py_strip

# Fixed values of the reference: bash blocklists of the search agent.
ALWAYS_BLOCKED = [
    r".*git log.*--all.*",
    r".*git verify-pack.*",
    r".*git fsck.*",
    r".*git cat-file.*",
    r".*git fetch.*",
    r".*git pull.*",
]
NON_SEARCH_BLOCKED = [
    r".*git clone.*",
    r".*api\.github\.com.*",
    r".*github\.io.*",
    r".*githubusercontent.*",
]

# Fixed values of the reference: ignore rules added before a patch is taken.
DEFAULT_GITIGNORE = ["*.jpg", "*.png", "*.jpeg", "*.o", "*.out", "*.obj", "*.so", "build", "Build"]
LANGUAGE_GITIGNORES: dict[str, list[str]] = {
    "c": ["bin/", "lib/", "*.dylib"],
    "cpp": ["bin/", "lib/", "*.dylib"],
    "java": ["target/", "out/", "*.class", "*.jar", ".gradle/"],
    "js": ["node_modules/", "dist/", ".next/", "coverage/", ".env",
           "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*"],
    "ts": ["node_modules/", "build/", "dist/", ".next/", "coverage/", ".env",
           "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*",
           "*.js", "*.js.map", "*.d.ts", ".tsbuildinfo"],
    "go": ["pkg/", "vendor/", "bin/", "*.test"],
    "rust": ["target/", "Cargo.lock", "*.rs.bk"],
    "python": [],
    "csharp": ["bin/", "obj/", "*.suo", "*.user", "*.userosscache",
               "*.sln.docstates", "*.vs/", "*.cache/", "*.pdb", "*.dll", "*.exe"],
    "kotlin": ["build/", "out/", "*.class", "*.jar", ".gradle/", "buildSrc/build/", "*.kt.bak"],
    "php": ["vendor/", "composer.lock", "composer.phar", "*.log", "*.cache", "*.tmp", "*.swp", ".env",
            "phpunit.xml"],
    "ruby": ["*.gem", "Gemfile.lock", "vendor/", "log/", "tmp/", "*.bundle", "*.so", "*.o", "*.a", "mkmf.log"],
    "scala": ["target/", "project/target/", "project/project/", "*.class", "*.jar", ".sbt/", ".scala/", "*.log"],
    "swift": [".build/", "Packages/", "*.xcworkspace/", "*.xcuserstate", "*.xcprofdata", "DerivedData/", "*.swp",
              "*.swo", "*.log", "Pods/", "Podfile.lock"],
}
LANGUAGE_ALIAS: dict[str, list[str]] = {
    "java": ["java"], "cpp": ["cpp", "c++"], "c": ["c"],
    "js": ["js", "javascript"], "ts": ["ts", "typescript"],
    "go": ["go", "golang"], "rust": ["rust"], "python": ["python"],
    "csharp": ["csharp", "c#", "cs"], "kotlin": ["kotlin"],
    "php": ["php"], "ruby": ["ruby"], "scala": ["scala"], "swift": ["swift"],
}


# ── repo rules ─────────────────────────────────────────────────────────────


def repo_parts(repo: Column) -> tuple[Column, Column]:
    """(owner or NULL, name) of ``owner/repo`` or ``repo`` (stripped)."""
    parts = F.split(py_strip(repo), "/")
    owner = F.when((F.size(parts) >= 2) & (F.element_at(parts, 1) != ""), F.element_at(parts, 1))
    name = F.when(F.size(parts) >= 2, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))
    return owner, name


def repo_rules(instances: DataFrame, repo: str = "repo", key: str = "instance_id") -> DataFrame:
    """Long rule table ``(instance_id, kind, ord, pattern)``: 3 URL rules and
    5 command rules per instance with a non-empty repo, names escaped."""
    owner, name = repo_parts(F.col(repo))
    eo, en = py_escape(owner), py_escape(name)
    seg = lambda o: F.coalesce(o, F.lit("[^/]+"))
    own = F.when(owner.isNotNull(), eo)
    url = F.array(
        F.concat(F.lit(r".*github\.com/"), seg(own), F.lit("/"), en, F.lit(r"(/|$|\?).*")),
        F.concat(F.lit(r".*gitlab\.com/"), seg(own), F.lit("/"), en, F.lit(r"(/|$|\?).*")),
        F.concat(F.lit(r".*raw\.githubusercontent\.com/.*/"), en, F.lit("/.*")),
    )
    # (``length > 0`` also drops NULL repos; this shape avoids a Spark codegen
    # bug hit by ``coalesce(repo, '') != ''`` once pushed into a CASE)
    base = instances.where(F.length(F.col(repo)) > 0).select(
        key, url.alias("_url"), repo_command_rules(F.col(repo)).alias("_cmd"))
    urls = base.select(key, F.lit("url").alias("kind"), F.posexplode("_url").alias("ord", "pattern"))
    cmds = base.select(key, F.lit("command").alias("kind"), F.posexplode("_cmd").alias("ord", "pattern"))
    return urls.unionByName(cmds)


def repo_command_rules(repo: Column) -> Column:
    """The 5 command rules of a repo as an array column (empty without repo)."""
    owner, name = repo_parts(repo)
    eo, en = py_escape(owner), py_escape(name)
    seg = F.coalesce(F.when(owner.isNotNull(), eo), F.lit("[^/]+"))
    rules = F.array(
        F.concat(F.lit(r".*git\s+clone\s+.*"), en, F.lit(".*")),
        F.concat(F.lit(r".*git\s+fetch\s+.*"), en, F.lit(".*")),
        F.concat(F.lit(r".*github\.io/"), seg, F.lit("/"), en, F.lit(".*")),
        F.concat(F.lit(r".*api\.github\.com/repos/"), seg, F.lit("/"), en, F.lit(".*")),
        F.concat(F.lit(r".*raw\.githubusercontent\.com/"), seg, F.lit("/"), en, F.lit(".*")),
    )
    has = (F.coalesce(repo, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    return F.when(has, rules).otherwise(F.array().cast("array<string>"))


# ── URL blocking ───────────────────────────────────────────────────────────


def block_urls(df: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    """Adds ``blocked``: some rule ``re.match``-es the URL, ignoring case.
    Invalid rules are skipped; all rules run as one compiled regex."""
    return df.withColumn("blocked", matches_any(F.coalesce(F.col(url), F.lit("")), patterns, ignore_case=True))


def filter_hits(hits: DataFrame, blocked_patterns: dict[str, list[str]]) -> DataFrame:
    """Adds ``blocked``: any field x any of its rules matches (ignoring case).
    Only string fields are checked; a missing field reads as ''."""
    conds = []
    for field, pats in blocked_patterns.items():
        if field in hits.columns:
            if dict(hits.dtypes)[field] != "string":
                continue
            value = F.coalesce(F.col(field), F.lit(""))
        else:
            value = F.lit("")
        conds.append(matches_any(value, pats, ignore_case=True))
    blocked = F.lit(False)
    for c in conds:
        blocked = blocked | c
    return hits.withColumn("blocked", blocked)


def blocked_counts(flagged: DataFrame, query: str = "query_id") -> DataFrame:
    return flagged.groupBy(query).agg(
        F.count_if(~F.col("blocked")).cast("bigint").alias("n_kept"),
        F.count_if(F.col("blocked")).cast("bigint").alias("n_blocked"),
    )


_HOST_PAIR = {
    "github": r"(?i)(?=github\.com/([^/]*)/([^/?]*))",
    "gitlab": r"(?i)(?=gitlab\.com/([^/]*)/([^/?]*))",
}
_RAW_HOST = "raw.githubusercontent.com/"


def _pair_struct(kind: str):
    return lambda p: F.struct(F.lit(kind).alias("kind"), F.lower(p["o"]).alias("owner"), F.lower(p["n"]).alias("name"))


def url_candidates(hits: DataFrame, url: str = "url", keys: tuple[str, ...] = ("instance_id", "hit_id")) -> DataFrame:
    """Every ``(kind, owner, name)`` a repo URL rule could match in a URL.

    github/gitlab: each occurrence of ``host/owner/name`` (overlapping
    occurrences included, via a look-ahead) with name ending at ``/``, ``?``
    or the end; raw: every path segment after the raw host that has a ``/``
    on both sides.  Owners and names are lower-cased.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    cands = []
    for kind, rx in _HOST_PAIR.items():
        owners = F.regexp_extract_all(u, F.lit(rx), 1)
        names = F.regexp_extract_all(u, F.lit(rx), 2)
        cands.append(F.transform(F.arrays_zip(owners.alias("o"), names.alias("n")), _pair_struct(kind)))
    at = F.locate(_RAW_HOST, F.lower(u))
    rest = F.when(at > 0, F.substr(u, at + len(_RAW_HOST)))
    segs = F.split(rest, "/")
    inner = F.when(F.size(segs) >= 3, F.slice(segs, 2, F.size(segs) - 2)).otherwise(F.array().cast("array<string>"))
    cands.append(F.transform(F.coalesce(inner, F.array().cast("array<string>")),
                             lambda s: F.struct(F.lit("raw").alias("kind"), F.lit(None).cast("string").alias("owner"),
                                                F.lower(s).alias("name"))))
    return hits.select(*keys, F.explode(F.concat(*cands)).alias("c")).select(*keys, "c.*")


def repo_leak_join(hits: DataFrame, instances: DataFrame, repo: str = "repo", key: str = "instance_id",
                   hit_key: str = "hit_id", url: str = "url") -> DataFrame:
    """Hits of each instance with ``blocked`` = the URL matches one of the
    instance's repo URL rules (github / gitlab with the owner, or any owner
    when the repo has none; raw content by name only).

    Equi-join on ``(instance_id, name)`` with the owner test as residual;
    skew on one repo is split by AQE's skew-join handling.
    """
    owner, name = repo_parts(F.col(repo))
    rules = instances.where(F.length(F.col(repo)) > 0).select(
        F.col(key).alias("_rk"), F.lower(owner).alias("_rowner"), F.lower(name).alias("_rname"))
    cand = url_candidates(hits, url, (key, hit_key))
    j = cand.join(rules, (cand[key] == rules["_rk"]) & (cand["name"] == rules["_rname"]), "inner")
    hit_ok = F.when(F.col("kind") == "raw", F.lit(True)).when(
        F.col("_rowner").isNull(), F.col("owner") != "").otherwise(F.col("owner") == F.col("_rowner"))
    blocked = j.where(hit_ok).select(key, hit_key).distinct().withColumn("_b", F.lit(True))
    return hits.join(blocked, [key, hit_key], "left").withColumn(
        "blocked", F.coalesce(F.col("_b"), F.lit(False))).drop("_b")


# ── commands ───────────────────────────────────────────────────────────────


def effective_blocklist(instances: DataFrame, extra: list[str] | None = None, search: str = "search",
                        repo: str = "repo", key: str = "instance_id") -> DataFrame:
    """Per instance ``(instance_id, ord, pattern)``: always-blocked, then the
    non-search rules unless search is on, then extra rules not already
    present, then the repo's command rules."""
    base = F.array(*[F.lit(p) for p in ALWAYS_BLOCKED])
    nonsearch = F.array(*[F.lit(p) for p in NON_SEARCH_BLOCKED])
    head = F.when(F.coalesce(F.col(search), F.lit(False)), base).otherwise(F.concat(base, nonsearch))
    extra_arr = F.array(*[F.lit(p) for p in (extra or [])]) if extra else F.array().cast("array<string>")
    extra_new = F.filter(extra_arr, lambda p: ~F.array_contains(head, p))
    rules = F.concat(head, extra_new, repo_command_rules(F.col(repo)))
    return instances.select(key, F.posexplode(rules).alias("ord", "pattern"))


def block_commands(calls: DataFrame, blocklist: DataFrame, command: str = "command",
                   key: str = "instance_id") -> DataFrame:
    """Adds ``blocked``: a rule of the call's instance ``re.match``-es the
    command (case-sensitive; ``.`` stops at newlines, so line 2 is unseen).

    Each instance's rules are folded into one alternation, so the join
    brings one pattern per instance.  Spark keeps the last compiled pattern,
    so calls are sorted by instance inside their partitions (no shuffle):
    one compilation per instance and partition, whatever join was chosen.
    """
    folded = blocklist.groupBy(key).agg(
        F.concat(F.lit("(?dU)^(?:"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pattern"))),
                                          lambda r: F.concat(F.lit("(?:"), r["pattern"], F.lit(")"))), "|"),
                 F.lit(")")).alias("_rx"))
    out = calls.join(folded, key, "left").sortWithinPartitions(key)
    hit = F.when(F.col("_rx").isNull(), F.lit(False)).otherwise(
        F.regexp_like(F.coalesce(F.col(command), F.lit("")), F.col("_rx")))
    return out.withColumn("blocked", hit).drop("_rx")


def block_commands_fixed(calls: DataFrame, rules: list[str], command: str = "command") -> DataFrame:
    """Same check against one fixed rule list (one compiled literal)."""
    return calls.withColumn("blocked", matches_any(F.coalesce(F.col(command), F.lit("")), rules))


# ── set operations on rules ───────────────────────────────────────────────


def merge_constraints(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("scope_id", "field")) -> DataFrame:
    """Per key: union of patterns, first occurrence kept, left before right.

    ``(keys..., ord, pattern)`` in and out; the renumbering window runs per
    scope and field, whose size is one rule list."""
    ks = list(keys)
    both = left.select(*ks, "ord", "pattern", F.lit(0).alias("_src")).unionByName(
        right.select(*ks, "ord", "pattern", F.lit(1).alias("_src")))
    first = both.groupBy(*ks, "pattern").agg(F.min(F.struct("_src", "ord")).alias("_at"))
    w = Window.partitionBy(*ks).orderBy("_at")
    return first.select(*ks, (F.row_number().over(w) - 1).alias("ord"), "pattern")


# ── patch files ────────────────────────────────────────────────────────────


def _glob_regex(glob: str) -> str:
    out = []
    for ch in glob:
        out.append("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch))
    return "".join(out)


def gitignore_regex(patterns: list[str]) -> str | None:
    """One Java regex matching a file path ignored by any of the patterns.

    ``name`` matches a file or directory of that name at any depth; ``dir/``
    matches only directories; a pattern with an inner ``/`` is anchored at
    the repository root; ``*`` and ``?`` do not cross ``/``.
    """
    alts = []
    for p in patterns:
        dir_only = p.endswith("/")
        body = p.rstrip("/")
        anchored = "/" in body
        rx = _glob_regex(body.lstrip("/"))
        prefix = "^" if anchored else "^(?:.*/)?"
        suffix = "/.*$" if dir_only else "(?:/.*)?$"
        alts.append(f"{prefix}{rx}{suffix}")
    return "(?:" + "|".join(alts) + ")" if alts else None


def normalize_language(lang: Column) -> Column:
    """lower + strip, then alias -> canonical name; unknown stays as is."""
    l_ = py_strip(F.lower(F.coalesce(lang, F.lit(""))))
    expr = None
    for canon, aliases in LANGUAGE_ALIAS.items():
        cond = l_.isin(*aliases)
        expr = F.when(cond, F.lit(canon)) if expr is None else expr.when(cond, F.lit(canon))
    return expr.otherwise(l_)


def patch_files(patches: DataFrame, patch: str = "patch", language: str = "language",
                key: str = "instance_id") -> DataFrame:
    """Changed files of each patch with ``is_artefact`` (ignored build output
    for the patch's language: default rules plus the language's rules).

    The language switch is a CASE over literal regexes (each compiled once).
    """
    files = F.regexp_extract_all(F.coalesce(F.col(patch), F.lit("")), F.lit(r"(?m)^diff --git a/(\S+) b/"), 1)
    lang = normalize_language(F.col(language))
    base = patches.select(key, lang.alias("_lang"), F.posexplode(files).alias("file_pos", "file"))
    default_rx = gitignore_regex(DEFAULT_GITIGNORE)
    art = None
    for canon, pats in LANGUAGE_GITIGNORES.items():
        rx = gitignore_regex(DEFAULT_GITIGNORE + pats)
        cond = F.col("_lang") == canon
        art = F.when(cond, F.col("file").rlike(rx)) if art is None else art.when(cond, F.col("file").rlike(rx))
    art = art.otherwise(F.col("file").rlike(default_rx))
    return base.select(key, "file_pos", "file", art.alias("is_artefact"))

