"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is cut into tokens (runs of non-space of at most ``MAX_TOKEN`` code
points; every character of scripts written without spaces is a token).  A
k-mer is ``K`` consecutive tokens, its inner s-mers are ``S`` tokens long.  It
is a closed syncmer if its smallest s-mer hash is its first or its last one.
That depends on the k-mer alone, so an edit moves or removes only the anchors
it touches.  The fingerprint is the ``SKETCH`` smallest distinct anchor hashes
(a bottom-k sketch); likeness is the Jaccard estimate of two sketches, exact
while both texts have at most ``SKETCH`` anchors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import gram_hash, index_range, let
from runlens.session import checkpoint_dir

K = 5
S = 2
SKETCH = 64
MAX_TOKEN = 32
_UNSPACED = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u2E80-\\uA4CF\\uF900-\\uFAFF"
TOKEN = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,{MAX_TOKEN}}}"


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def anchor_positions(h: Column) -> Column:
    """Positions (in tokens) of the closed syncmers of a token-hash array."""
    inner = K - S + 1

    def closed(s: Column) -> Column:
        def is_closed(i: Column) -> Column:
            edge = F.least(F.get(s, i), F.get(s, i + F.lit(inner - 1)))
            return edge <= F.least(*[F.get(s, i + F.lit(j)) for j in range(1, inner - 1)])

        return F.filter(index_range(F.size(h) - F.lit(K - 1)), is_closed)

    return let(F.transform(index_range(F.size(h) - F.lit(S - 1)), lambda i: gram_hash(h, i, S)), closed)


def _anchored(text: Column, anchor: Callable[[Column, Column], Column], whole: Callable[[Column], Column]) -> Column:
    """``anchor(token hashes, position)`` of every closed syncmer; of a text
    with tokens but without one (always under K tokens, sometimes at K or
    K + 1) the array of ``whole(token hashes)``."""

    def found(h: Column) -> Column:
        return let(
            F.transform(anchor_positions(h), lambda i: anchor(h, i)),
            lambda a: F.when((F.size(a) == 0) & (F.size(h) > 0), F.array(whole(h))).otherwise(a),
        )

    return let(token_hashes(text), found)


def anchors(text: Column) -> Column:
    """Array of (position, hash): the anchors for positional matching.  A text
    without a closed syncmer has one anchor, the whole of it; one without
    tokens has none."""
    return _anchored(
        text,
        lambda h, i: F.struct(i.alias("position"), gram_hash(h, i, K).alias("hash")),
        lambda h: F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")),
    )


def sketch(text: Column) -> Column:
    """The SKETCH smallest distinct 32-bit anchor hashes, ascending."""
    hashes = _anchored(
        text,
        lambda h, i: F.shiftright(gram_hash(h, i, K), 32).cast("int"),
        lambda h: F.shiftright(F.xxhash64(h), 32).cast("int"),
    )
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 0 to 1; two empty ones are alike."""
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.when(F.size(smallest) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), smallest)).cast("double") / F.size(smallest)
    )


def as_text(s: Column) -> Column:
    """A sketch as a string: 8 hex digits per hash."""
    return F.concat_ws("", F.transform(s, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` per row.  Null and empty texts (and texts of
    white space only) have the empty fingerprint; equal texts have equal ones."""
    return docs.select(F.col(doc_id).alias("doc_id"), as_text(sketch(F.col(text))).alias("fingerprint"))


def successors(keys: DataFrame) -> DataFrame:
    """``id, row_hash, next``: for each key row the next one in ascending
    (id, row_hash), the first one after the last.

    The order is global but never in one task: rows are range partitioned,
    each partition is ordered by itself, and only its first row (one per
    partition) takes part in the step across partitions.
    """
    spark = keys.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, so that both uses below see one and the same range split
    placed = keys.repartitionByRange(n, "id", "row_hash").withColumn("part", F.spark_partition_id()).checkpoint()
    key = F.struct("id", "row_hash")
    heads = placed.groupBy("part").agg(F.min(key).alias("head"))
    over_parts = Window.orderBy("part")  # one row per partition
    everything = over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("part", F.coalesce(F.lead("head").over(over_parts), F.first("head").over(everything)).alias("follow"))
    within = Window.partitionBy("part").orderBy("id", "row_hash")
    return (
        placed.withColumn("next", F.lead(key).over(within))
        .join(F.broadcast(following), "part")
        .select("id", "row_hash", F.coalesce("next", "follow").alias("next"))
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last floor(n/4) code points replaced by the first
    as many (or all) of the next document's, ascending doc_id; the first
    document follows the last.  ``docs(doc_id, text)``: null texts count as
    empty, null ids come first; rows with one id are ordered by a hash of the
    text, and equal rows count as one document (each returns its own equal
    row); a single document follows itself; an empty table gives no rows.
    """
    rows = docs.select(
        F.struct(F.col("doc_id").alias("v")).alias("id"), F.xxhash64("text").alias("row_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    full = rows.withColumn("sk", sketch(F.col("text")))
    pairs = successors(rows.select("id", "row_hash").distinct())
    lengths = rows.select("id", "row_hash", F.length("text").alias("n_chars")).distinct()
    wanted = lengths.join(pairs, ["id", "row_hash"]).select(
        F.col("next.id").alias("id"),
        F.col("next.row_hash").alias("row_hash"),
        F.col("id").alias("p_id"),
        F.col("row_hash").alias("p_hash"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("cut"),
    )
    heads = (
        full.join(wanted, ["id", "row_hash"])
        .select("p_id", "p_hash", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("head"), F.col("sk").alias("next_sk"))
        .dropDuplicates(["p_id", "p_hash"])
    )
    edited = (
        full.join(heads, (F.col("id") == F.col("p_id")) & (F.col("row_hash") == F.col("p_hash")))
        .withColumn("n_chars", F.length("text"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut")), "head"))
        .select("id", "n_chars", "edited", "sk", "next_sk")
        .withColumn("edited_sk", sketch(F.col("edited")))
    )
    return edited.select(
        F.col("id.v").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
