"""Quality rules by cross-document line frequency (DataFrame functions only).

A document's words are maximal runs of ``[^\\x20\\x09-\\x0D]``, its lines the
pieces between ``\\n``.  Two kinds of rule judge a text:

* base rules of the text alone: word, symbol, repeated-line and repeated-window
  counts;
* line frequency over documents: every line that has a word is normalised (A-Z
  lower-cased, digits to ``0``, runs of white space to one space, ends trimmed)
  and hashed; the distinct documents that hold it are counted per host; lines
  above the limit are removed; a document of which too little is left is
  rejected.

Equal texts of one host are one document of these counts, so copies alone do
not make their own lines frequent.  One pass over the texts writes a table of
counts and line hashes, a small part of the texts' size; everything else reads
that table.  Counts are combined before each shuffle and keyed on (host, line),
so a host, a line or a group of copies with a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import free_names, index_range, let, shared_table

SEPARATORS = " \t\n\x0b\x0c\r"
BETWEEN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: words of a window whose repetition counts, least words, most repeated words (percent)
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
#: a line is removed on a host if more distinct documents than both hold it:
#: this number, and this share (percent) of the host's distinct documents
LINE_DOCS = 10
LINE_SHARE = 1
#: a document is depleted if fewer words than this share (percent) are left
LEAST_LEFT = 30
#: frequent lines up to these many are sent to every task, at 24 bytes or so
#: each; more are shuffled
BROADCAST_LINES = 500_000


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def normalised(line: Column) -> Column:
    """A line as it is compared between documents."""
    folded = F.translate(line, UPPER + DIGITS, UPPER.lower() + "0" * len(DIGITS))
    return F.trim(F.regexp_replace(folded, BETWEEN, " "))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column) -> Column:
    """How many words of ``w`` lie in a window that occurs at least twice.

    Windows are sorted by hash with their start, so equal ones are neighbours;
    their starts in order then cover ``min(3, gap to the next start)`` words
    each.  Texts without a repeated window are done after the hash set."""
    grams = F.transform(index_range(F.size(w) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        starts = let(
            placed,
            lambda s: F.filter(s, lambda x, j: (F.get(s, j - F.lit(1))["g"].eqNullSafe(x["g"])) | (F.get(s, j + F.lit(1))["g"].eqNullSafe(x["g"]))),
        )
        ordered = F.sort_array(F.transform(starts, lambda x: x["i"]))
        return let(
            ordered,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + F.lit(1)) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, b: a + b,
            ),
        )

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: ids, the base counts of its whole text and
    ``lines``, per line its normalised hash (null without a word) and words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split("text", "\n", -1)
    worded = F.filter(F.col("l"), lambda x: _without(x, SEPARATORS) != "")
    hashed = F.transform("l", lambda x: F.struct(F.when(_without(x, SEPARATORS) != "", F.xxhash64(normalised(x))).alias("line"), F.size(words(x)).alias("n")))
    return (
        docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
        .select("doc_id", "host", "text", words(F.col("text")).alias("w"), lines.alias("l"))
        .select("*", worded.alias("worded"))
        .select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "host",
            F.xxhash64("text").alias("text_hash"),
            F.size("w").cast("long").alias("n_words"),
            F.length(_without(F.col("text"), SEPARATORS)).cast("long").alias("word_chars"),
            (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
            hashed.alias("lines"),
        )
    )


def frequent_lines(measured: DataFrame, *, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """``host, line, docs``: the lines above both limits of their host."""
    distinct = measured.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    hosts = measured.select("host", "text_hash").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all_docs"))
    counted = (
        distinct.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line")).filter("line IS NOT NULL")
        .groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > line_docs)
    )
    over = 100 * F.col("docs") > F.lit(line_share) * F.col("all_docs")
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(over).select("host", "line", "docs")


def _removed(measured: DataFrame, *, line_docs: int, line_share: float, broadcast_lines: int) -> DataFrame:
    """``row_id, host, text_hash, at, n``: the lines to remove, by their place."""
    frequent = shared_table(
        frequent_lines(measured, line_docs=line_docs, line_share=line_share).select(F.col("host").alias("f_host"), F.col("line").alias("f_line")),
        "frequent-lines",
    )
    side = F.broadcast(frequent) if frequent.count() <= broadcast_lines else frequent
    return (
        measured.select("row_id", "host", "text_hash", F.posexplode("lines").alias("at", "x"))
        .select("row_id", "host", "text_hash", "at", "x.line", "x.n").filter("line IS NOT NULL")
        .join(side, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
        .select("row_id", "host", "text_hash", "at", "n")
    )


def _kept(n_words: Column, n_repeat_words: Column, n_left: Column, least_left: float) -> tuple[Column, Column]:
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)
    return failed, ~failed & (100 * n_left >= F.lit(least_left) * n_words)


def judge(
    docs: DataFrame, *, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Per row of ``docs(doc_id, text, host)``: the base counts, ``base_failed``,
    ``n_removed_lines`` and ``n_left_words`` after the lines above the limits
    are removed, and ``kept``: not failed by the base rules nor depleted (under
    ``least_left`` percent of its words left).

    Null and empty texts have no words, fail the base rules and are not kept; a
    null host is a host like others; rows that repeat each get their own row;
    rows with one doc_id and different texts or hosts are judged by their own;
    an empty table gives no rows; other columns are ignored.
    """
    measured = shared_table(measures(docs, host), "line-measures")
    lost = (
        _removed(measured, line_docs=line_docs, line_share=line_share, broadcast_lines=broadcast_lines)
        .groupBy("row_id").agg(F.count("*").alias("n_lost"), F.sum("n").alias("lost_words"))
    )
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    failed, kept = _kept(F.col("n_words"), F.col("n_repeat_words"), left, least_left)
    return measured.drop("lines").join(lost, "row_id", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"),
        F.coalesce("n_lost", F.lit(0)).cast("long").alias("n_removed_lines"), left.cast("long").alias("n_left_words"),
    )


def clean(
    docs: DataFrame, *, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The rows of ``docs`` (any columns, among them ``doc_id``, ``text`` and the
    host's) that ``judge`` keeps, their texts without the removed lines; the
    cases are those of ``judge``.  Other text columns stay as they are."""
    measured = shared_table(measures(docs, host), "line-measures")
    # equal texts of a host lose the same places, so one row each is enough
    lost = (
        _removed(measured, line_docs=line_docs, line_share=line_share, broadcast_lines=broadcast_lines)
        .groupBy("host", "text_hash").agg(F.collect_set(F.struct("at", "n")).alias("lost"))
    )
    verdicts = (
        measured.groupBy("host", "text_hash").agg(F.first("n_words").alias("n_words"), F.first("n_repeat_words").alias("n_repeat_words"))
        .join(lost.withColumnsRenamed({"host": "x_host", "text_hash": "x_hash"}), F.col("host").eqNullSafe(F.col("x_host")) & (F.col("text_hash") == F.col("x_hash")), "left")
    )
    left = F.col("n_words") - F.coalesce(F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    _, kept = _kept(F.col("n_words"), F.col("n_repeat_words"), left, least_left)
    free = free_names(docs.columns, "kept_host", "kept_hash", "lost_at")
    verdicts = verdicts.filter(kept).select(F.col("host").alias(free[0]), F.col("text_hash").alias(free[1]), F.col("lost.at").alias(free[2]))
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.split(text, "\n", -1)
    rest = let(pieces, lambda l: F.array_join(F.transform(F.array_except(index_range(F.size(l)), F.col(free[2])), lambda i: F.get(l, i)), "\n"))
    joined = docs.join(verdicts, F.col(host).eqNullSafe(F.col(free[0])) & (F.xxhash64(text) == F.col(free[1])))
    return joined.withColumn("text", F.when(F.size(free[2]) > 0, rest).otherwise(F.col("text"))).select(*docs.columns)
