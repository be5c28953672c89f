"""Connected components by alternating large-star and small-star.

Both steps are a minimum per node, summed before the shuffle, and a join back
on the node, so no neighbourhood is ever collected. Each pass is written to the
shared folder; the driver sees one count and one checksum a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) but the smallest of each component, which names it.

    Links of a node to itself, repeated links and no links at all are allowed;
    nulls aren't.
    """
    now, before = cut(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.lit(0))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, old = tuple(state), now
        now = cut(_small_star(_large_star(now)))
        drop_cut(old)
