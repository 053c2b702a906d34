"""Connected components by alternating large-star and small-star steps.

Both steps are grouped minima with a map-side part and a join back, so a hub
with very many links neither meets in one task nor needs all its neighbours
together.  Each round is written to the shared folder; only a row count and a
checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of
    ``edges(a, b)`` but the smallest of each component.  No edges: no rows."""
    state = shared_table(_small_star(edges.filter("a <> b").select("a", "b")), "components")
    before = None
    while True:
        now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        state = shared_table(_small_star(_large_star(state)), "components")
