"""Search hits and fetched pages: paging, text blocks, page markdown and
summariser request rows.

Per-query work is bounded by the page size (``num``), so ordered
``collect_list`` per query is safe; pages are processed row-locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import py_strip

# Fixed values of the reference: fields printed per hit, in order (position
# is replaced by our own numbering).
RESULT_SCHEME = ["position", "title", "description", "snippets", "url"]
DEFAULT_NUM = 10
DEFAULT_START = 0


def active_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Blank queries are dropped."""
    return queries.where(F.coalesce(py_strip(F.col(text)), F.lit("")) != "")


def page_hits(hits: DataFrame, queries: DataFrame, num: int = DEFAULT_NUM, start: int = DEFAULT_START,
              query: str = "query_id", position: str = "position") -> DataFrame:
    """The requested page of each non-blank query, blocked hits removed, then
    renumbered ``rank`` 1..n.  ``hits`` needs a ``blocked`` column.

    The paging filter runs before the window, so each window partition holds
    at most ``num`` rows."""
    q = active_queries(queries).select(query)
    page = hits.join(q, query, "left_semi").where(
        (F.col(position) >= start + 1) & (F.col(position) <= start + num))
    # ``blocked`` is dropped from the output (always false here), so the rule
    # regexes behind it run only in the filter
    kept = page.where(~F.col("blocked")).drop("blocked")
    w = Window.partitionBy(query).orderBy(position)
    return kept.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _entry(fields: list[str]) -> Column:
    """Text lines of one hit: ``[i]`` then ``  field: value`` per present field."""
    parts = []
    for f in fields:
        if f == "position":
            continue
        parts.append(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"  {f}: "), F.col(f).cast("string"))))
    lines = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(
        F.concat(F.array(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))), lines, F.array(F.lit(""))),
        "\n"))


def format_hits(hits: DataFrame, queries: DataFrame, num: int = DEFAULT_NUM, start: int = DEFAULT_START,
                fields: list[str] | None = None, query: str = "query_id", text: str = "query",
                position: str = "position") -> DataFrame:
    """One text block per non-blank query: header, optional filtered-count
    warning, then the page's unblocked hits numbered 1..n, or ``No results
    found.``  ``hits`` carry a ``blocked`` flag.

    One pass over the page: a running count of unblocked hits (one window
    partitioned by query) numbers the entries, and a single aggregation on
    the same partitioning collects them and counts the blocked ones, so the
    flags are evaluated once.  List-valued fields are space-joined."""
    fields = fields or RESULT_SCHEME
    cols = hits.columns
    q = active_queries(queries).select(query)
    page = hits.join(q, query, "left_semi").where((F.col(position) >= start + 1) & (F.col(position) <= start + num))
    for f in fields:
        if f in cols and dict(hits.dtypes)[f].startswith("array"):
            page = page.withColumn(f, F.array_join(F.transform(F.col(f), lambda v: v.cast("string")), " "))
    w = Window.partitionBy(query).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    page = page.withColumn("rank", F.sum(F.when(~F.col("blocked"), 1).otherwise(0)).over(w).cast("bigint"))
    present = [f for f in fields if f in cols]
    entry = F.when(~F.col("blocked"), _entry(present))
    agg = page.groupBy(query).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(entry.isNotNull(), F.struct(F.col("rank"),
                                                                                                 entry.alias("e"))))),
                                 lambda x: x["e"]), "\n").alias("_body"),
        F.count_if(entry.isNotNull()).alias("_n"),
        F.count_if(F.col("blocked")).alias("n_blocked"),
    )
    out = active_queries(queries).select(query, text).join(agg, query, "left")
    warn = F.when(F.coalesce(F.col("n_blocked"), F.lit(0)) > 0, F.concat(
        F.lit("WARNING: "), F.col("n_blocked").cast("string"), F.lit(" result(s) filtered by security constraints.")))
    head = F.filter(F.array(F.concat(F.lit("Search results for: "), F.col(text)), warn), lambda x: x.isNotNull())
    ranked_any = F.coalesce(F.col("_n"), F.lit(0)) > 0
    block = F.when(ranked_any, F.array_join(F.concat(head, F.array(F.lit("")), F.array(F.col("_body"))), "\n")) \
        .otherwise(F.array_join(F.concat(head, F.array(F.lit("No results found."))), "\n"))
    return out.select(query, block.alias("text"))


def _dict_lines(keys: Column, values: Column, fmt) -> Column:
    """Python ``dict(zip(keys, values))`` items as lines: first position of a
    key, last value written for it."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    uniq = F.array_distinct(keys)
    return F.transform(uniq, lambda k: fmt(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def page_markdown(pages: DataFrame, title: str = "title", description: str = "description",
                  content: str = "content", link_text: str = "link_text", link_href: str = "link_href",
                  image_alt: str | None = None, image_src: str | None = None) -> DataFrame:
    """Reader output -> markdown: ``# title``, ``> description`` (unless it
    occurs in the first 200 characters of the content), content, then
    ``## Links`` and ``## Images`` lists.  Empty when there is neither
    content nor title."""
    t = F.coalesce(F.col(title), F.lit(""))
    d = F.coalesce(F.col(description), F.lit(""))
    c = F.coalesce(F.col(content), F.lit(""))
    show_desc = (d != "") & ~F.left(c, F.lit(200)).contains(d)
    parts = [
        F.when(t != "", F.array(F.concat(F.lit("# "), t), F.lit(""))),
        F.when(show_desc, F.array(F.concat(F.lit("> "), d), F.lit(""))),
        F.when(c != "", F.array(c)),
    ]
    links = F.coalesce(F.col(link_text), F.array().cast("array<string>"))
    hrefs = F.coalesce(F.col(link_href), F.array().cast("array<string>"))
    parts.append(F.when(F.size(links) > 0, F.concat(
        F.array(F.lit(""), F.lit("## Links")),
        _dict_lines(links, hrefs, lambda k, v: F.concat(F.lit("- ["), k, F.lit("]("), v, F.lit(")"))))))
    if image_alt and image_src:
        alts = F.coalesce(F.col(image_alt), F.array().cast("array<string>"))
        srcs = F.coalesce(F.col(image_src), F.array().cast("array<string>"))
        parts.append(F.when(F.size(alts) > 0, F.concat(
            F.array(F.lit(""), F.lit("## Images")),
            _dict_lines(alts, srcs, lambda k, v: F.concat(F.lit("- !["), k, F.lit("]("), v, F.lit(")"))))))
    empty = F.array().cast("array<string>")
    body = F.array_join(F.concat(*[F.coalesce(p, empty) for p in parts]), "\n")
    md = F.when((c == "") & (t == ""), F.lit("")).otherwise(body)
    return pages.withColumn("markdown", md)


def summary_requests(df: DataFrame, url: str = "url", goal: str = "goal", content: str = "markdown",
                     blocked: str = "blocked") -> DataFrame:
    """Summariser request rows: ``status`` (empty_url / empty_goal / blocked /
    ok) and ``message`` (the error text, or the ``## URL / ## Goal /
    ## Page Content`` user message).  The model call itself is not made."""
    u = py_strip(F.coalesce(F.col(url), F.lit("")))
    g = py_strip(F.coalesce(F.col(goal), F.lit("")))
    status = (F.when(u == "", F.lit("empty_url")).when(g == "", F.lit("empty_goal"))
              .when(F.coalesce(F.col(blocked), F.lit(False)), F.lit("blocked")).otherwise(F.lit("ok")))
    msg = (
        F.when(status == "empty_url", F.lit("Error: empty URL."))
        .when(status == "empty_goal", F.lit("Error: empty goal. Please describe what information you need."))
        .when(status == "blocked", F.concat(
            F.lit("ACCESS DENIED: The URL '"), u,
            F.lit("' is blocked by security constraints. This URL may point to the target repository and "
                  "accessing it is not allowed during evaluation.")))
        .otherwise(F.concat(F.lit("## URL\n"), u, F.lit("\n\n## Goal\n"), g, F.lit("\n\n## Page Content\n"),
                            F.coalesce(F.col(content), F.lit(""))))
    )
    return df.withColumn("status", status).withColumn("message", msg)
