"""Search constraints held in a table: ``(scope, field, pattern)`` rows applied
to search hits without trying every rule on every hit.

A regex can only match a value that contains the literal runs it requires.
Each distinct rule is parsed once; the four-letter grams of its required runs
are counted among the hits, and the rarest becomes the rule's key.  Hits meet
rules by an equi-join on (scope, field, gram), and only those pairs run the
regex.  A rule without such a run has the empty gram, which every value holds:
it meets the values of its scope and field, still by an equi-join.  Rules for
all scopes meet values in blocks: a chunk of rules and a block of values are one
row, so a gram that many rules and values share is dealt over tasks, and only
values that hold a rule's longest run are tried.  Rules that do not compile are
skipped, one by one.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from re import _constants as OP
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 4
#: compiled rules that one task keeps
COMPILED = 4096
#: values and rules of one pair of blocks
VALUES, RULES = 512, 128
# characters that match ASCII letters when case is ignored, without lower-casing to them
_FOLD_FROM, _FOLD_TO = "ſıİK", "siik"


def required_runs(pattern: str) -> list[str]:
    """Lower-cased ASCII runs that every match of a regex contains."""
    runs: list[str] = []

    def walk(items) -> None:
        run = ""
        for op, arg in items:
            if op is OP.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if op is OP.AT:  # an anchor takes no character
                continue
            runs.append(run)
            run = ""
            if op is OP.SUBPATTERN:
                walk(arg[3])
            elif op in (OP.MAX_REPEAT, OP.MIN_REPEAT, OP.POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
            elif op is OP.ATOMIC_GROUP:
                walk(arg)
        runs.append(run)

    walk(parser.parse(pattern))
    return [r for r in runs if r]


def rule_grams(pattern: str | None) -> list[str] | None:
    """The grams of a rule's runs ([''] without any), None if it is broken."""
    try:
        re.compile(pattern, re.IGNORECASE)
        grams = {r[i : i + GRAM] for r in required_runs(pattern) for i in range(len(r) - GRAM + 1)}
    except (re.error, TypeError, RecursionError, OverflowError):
        return None
    return sorted(grams) or [""]


_FOLD = str.maketrans(_FOLD_FROM, _FOLD_TO)


def _folded(value: Column) -> Column:
    return F.lower(F.translate(value, _FOLD_FROM, _FOLD_TO))


def _value_grams(value: Column) -> Column:
    """Distinct grams of a folded value, and the empty one."""
    starts = F.when(F.length(value) >= GRAM, F.sequence(F.lit(1), F.length(value) - F.lit(GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(starts, lambda i: F.substr(value, i, F.lit(GRAM)))))


def _parsed(rules: DataFrame) -> DataFrame:
    """``pattern, run, grams`` of the distinct rules that compile; ``run`` is
    the longest required run."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch.column("pattern").to_pylist()
            grams = [rule_grams(p) for p in patterns]
            runs = [None if g is None else max(required_runs(p), key=len, default="") for p, g in zip(patterns, grams, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(runs, pa.string()), pa.array(grams, pa.list_(pa.string()))], names=["pattern", "run", "grams"])

    return rules.select("pattern").distinct().mapInArrow(parse, "pattern string, run string, grams array<string>").where("grams IS NOT NULL")


class _Compiled:
    """The last compiled rules of a task."""

    def __init__(self) -> None:
        self.kept: OrderedDict[str, re.Pattern] = OrderedDict()

    def __getitem__(self, pattern: str) -> re.Pattern:
        rx = self.kept.get(pattern)
        if rx is None:
            rx = self.kept[pattern] = re.compile(pattern, re.IGNORECASE)
            if len(self.kept) > COMPILED:
                self.kept.popitem(last=False)
        return rx


def _matching(candidates: DataFrame) -> DataFrame:
    """The ids of candidates ``(_hit, _value, pattern)`` whose rule matches at
    the start of the value, ignoring case; compiled rules are kept per task."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _Compiled()
        for batch in batches:
            pairs = zip(batch.column("_value").to_pylist(), batch.column("pattern").to_pylist(), strict=True)
            keep = [i for i, (value, pattern) in enumerate(pairs) if compiled[pattern].match(value)]
            yield batch.select(["_hit"]).take(pa.array(keep, pa.int64()))

    return candidates.select("_hit", "_value", "pattern").mapInArrow(check, candidates.select("_hit").schema)


def _matching_blocks(blocks: DataFrame) -> DataFrame:
    """The same for rows of ``hits, values`` (a block) and ``patterns, runs`` (a
    chunk of rules): every rule is tried on the values that hold its run."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _Compiled()
        for batch in batches:
            hits, keep, first = batch.column("hits").flatten(), [], 0
            columns = [batch.column(c) for c in ("values", "patterns", "runs")]
            for row in range(batch.num_rows):
                values, patterns, runs = (c[row].as_py() for c in columns)
                left = [(v.translate(_FOLD).lower(), v, first + i) for i, v in enumerate(values)]
                first += len(values)
                for pattern, run in zip(patterns, runs, strict=True):
                    some = [(v, i) for folded, v, i in left if run in folded]
                    found = {i for v, i in some if compiled[pattern].match(v)} if some else ()
                    if found:
                        keep.extend(found)
                        left = [x for x in left if x[2] not in found]
            yield pa.RecordBatch.from_arrays([hits.take(pa.array(keep, pa.int64()))], names=["_hit"])

    hit = blocks.schema["hits"].dataType.elementType
    return blocks.select("hits", "values", "patterns", "runs").mapInArrow(check, T.StructType([T.StructField("_hit", hit)]))


def _blocks(grams: DataFrame, keyed: DataFrame) -> DataFrame:
    """Blocks of values met by chunks of the rules ``keyed(_field, _gram, _n,
    pattern, run)``; ``_n`` values hold the gram."""
    key = ["_field", "_gram"]
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_rules"), F.ceil(F.max("_n") / VALUES).cast("bigint").alias("_blocks"))
    chunks = keyed.join(sizes, key).groupBy(*key, "_blocks", F.pmod(F.xxhash64("pattern"), F.ceil(F.col("_rules") / RULES)).alias("_chunk")).agg(
        F.collect_list(F.struct("pattern", "run")).alias("_r"))
    dealt = chunks.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"),
                          F.col("_r.pattern").alias("patterns"), F.col("_r.run").alias("runs"))
    # (by number: blocks are few bytes but much work, so their partitions must not be joined by size)
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = grams.join(sizes.drop("_rules"), key).withColumn("_block", F.pmod(F.xxhash64("_hit"), F.col("_blocks"))).repartition(parts, *key, "_block")
    values = values.groupBy(*key, "_block").agg(F.collect_list(F.struct("_hit", "_value")).alias("_v"))
    return values.select(*key, "_block", F.col("_v._hit").alias("hits"), F.col("_v._value").alias("values")).join(dealt, [*key, "_block"])


def filter_hits_by_rules(hits: DataFrame, rules: DataFrame, keys: list[str], scope: str | None = None) -> DataFrame:
    """``hits`` with ``blocked``: a rule of ``rules(scope_id, field, pattern)``
    (``merge_constraints`` gives such a table) matches at the start of the
    field's value, ignoring case.

    ``keys`` identify a hit, ``scope`` is the column that ``scope_id`` refers
    to; rules with a NULL scope hold for all hits.  Only string columns are
    checked; a NULL value and a missing column read as ''.  Broken rules, and
    NULL patterns or fields, are skipped."""
    fields = [n for n, t in hits.dtypes if t == "string" and n not in keys and n != scope]
    other = [n for n, t in hits.dtypes if t != "string"]
    hit_id = F.struct(*[F.col(k) for k in keys])
    own = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    wanted = rules.where(~F.col("field").isin(*other) if other else F.lit(True)).select(
        F.col("scope_id").cast("string").alias("_scope"), F.when(F.col("field").isin(*fields), F.col("field")).otherwise(F.lit("")).alias("_field") if fields else F.lit("").alias("_field"),
        "pattern", F.col("field").alias("_named")).where("pattern IS NOT NULL AND _named IS NOT NULL").drop("_named").distinct()
    # a column that hits do not have reads as '': one value per hit under the empty field name
    columns = [F.struct(F.lit(f).alias("f"), F.coalesce(F.col(f), F.lit("")).alias("v")) for f in fields]
    values = hits.select(hit_id.alias("_hit"), own.alias("_own"), F.explode(F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("v")), *columns)).alias("x"))
    grams = values.select("_hit", "_own", F.col("x.f").alias("_field"), F.col("x.v").alias("_value"), F.explode(_value_grams(_folded(F.col("x.v")))).alias("_gram"))
    # the rarest gram of a rule among the values of its field; a gram that no value holds ends the rule
    counts = grams.groupBy("_field", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    listed = wanted.select("_field", "pattern").distinct().join(_parsed(rules), "pattern").select("_field", "pattern", "run", F.explode("grams").alias("_gram"))
    rarest = (
        listed.join(counts, ["_field", "_gram"], "left").groupBy("_field", "pattern", "run")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("r"))
        .where("r.n > 0").select("_field", "pattern", "run", F.col("r.n").alias("_n"), F.col("r.g").alias("_gram"))
    )
    keyed = wanted.join(rarest, ["_field", "pattern"])
    own_pairs = grams.withColumnRenamed("_own", "_scope").join(keyed.where("_scope IS NOT NULL"), ["_scope", "_field", "_gram"])
    blocked = _matching(own_pairs).union(_matching_blocks(_blocks(grams, keyed.where("_scope IS NULL")))).distinct()
    flagged = hits.withColumn("_hit", hit_id).join(blocked.withColumn("_b", F.lit(True)), "_hit", "left")
    return flagged.select(*hits.columns, F.coalesce("_b", F.lit(False)).alias("blocked"))
