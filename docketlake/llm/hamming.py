"""Exact top-k search in binary codes by incremental multi-index hashing.

A code's segments are indexed by value. Queries probe each segment at a radius
of 0, 1, 2, ... bits; two codes within segments * (radius + 1) - 1 bits agree
with each other in some segment within the radius, so a query is done when its
kth verified distance is at most that. A pair is taken at the radius of its
nearest segment and at the first such segment only, so no pair comes twice.

Equal codes are one entry that keeps its k smallest ids, and equal queries are
asked once, so a vector that a third of all rows share is one row. Codes that
are not yet beaten by the k best so far are all kept; ties go to the smaller
id. Each round is a table in the shared folder.

Defined results: null, empty or wrongly sized vectors and rows without id are
not indexed and have no result; a bit is set for a positive component (not for
0 or a NaN, as NaN is taken as 0); repeated rows are one entry; with fewer than
k entries all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, name

BITS = 64


def binary_code(vector: Column) -> Column:
    """The signs of 64 components as a number, the first component as the highest bit."""
    bit = lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when((x > 0) & ~F.isnan(x), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) == BITS, F.aggregate(vector, F.lit(0).cast("long"), bit))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segment(code: Column, i: int, width: int) -> Column:
    return F.shiftright(code, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def flips(width: int, radius: int) -> Iterator[int]:
    """Every pattern of radius bits in a segment."""
    for at in combinations(range(width), radius):
        yield sum(1 << b for b in at)


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """code and its k smallest ids; first per part of the ids, then over all, so that no code is gathered whole."""
    first = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= k)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


#: Codes with one segment value of which a hash table is made.
MOST_ALIKE = 1_000_000


def _met(probes: DataFrame, index: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Probes with the codes of their segment values.

    Probes are many more than their table's size tells, so the index is the side
    to hash; values of very many codes (crowded) are merged instead, which
    spills, and which Spark divides.
    """
    on = ["part", "value"]
    if crowded is None:
        return probes.join(index.hint("shuffle_hash"), on)
    usual = probes.join(index.join(crowded, on, "left_anti").hint("shuffle_hash"), on)
    return usual.unionByName(probes.join(index.join(crowded, on, "left_semi").hint("merge"), on))


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 10, segments: int = 4, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """query_id, rank, id, distance of the k nearest rows of each query."""
    width = BITS // segments
    coded = lambda df: df.select(name(row_id).alias("id"), binary_code(name(vector)).alias("code")).filter("id is not null and code is not null")
    entries = cut(smallest_ids(coded(rows), k))
    asked, counted = cut(coded(queries).distinct()), Observation()
    every = cut(asked.select(F.col("code").alias("query")).distinct().observe(counted, F.count(F.lit(1)).alias("n")))
    codes = entries.select("code", F.size("ids").alias("held"))
    index = codes.select("code", "held", F.posexplode(F.array(*[segment(F.col("code"), i, width) for i in range(segments)])).alias("part", "value"))
    crowded = cut(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ALIKE).select("part", "value"))
    crowded = None if crowded.isEmpty() else crowded
    best, tasks = None, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_query = Window.partitionBy("query")
    for radius in range(width + 1):
        if best is None:
            waiting = every.withColumn("bound", F.lit(BITS))
        else:
            reached = best.filter("first").select("query", "n", "kth", "covered")
            waiting = every.join(reached, "query", "left").filter(~F.coalesce("covered", F.lit(False))).select("query", F.when(F.col("n") >= k, F.col("kth")).otherwise(BITS).alias("bound"))
        patterns = F.split(F.lit(",".join(map(str, flips(width, radius)))), ",").cast("array<int>")  # one literal, folded once
        # a query is a small row but thousands of probes: spread queries by number, not by bytes
        probes = waiting.repartition(tasks, "query").select("query", "bound", F.posexplode(F.array(*[segment(F.col("query"), i, width) for i in range(segments)])).alias("part", "own"))
        probes = probes.select("query", "bound", "part", F.explode(F.transform(patterns, lambda p: p.bitwiseXOR(F.col("own")))).alias("value"))
        near = [F.bit_count(segment(F.col("code").bitwiseXOR(F.col("query")), i, width)) for i in range(segments)]
        earlier = F.lit(False)
        for i in range(segments):
            earlier |= (near[i] < radius) | ((near[i] == radius) & (F.lit(i) < F.col("part")))
        found = _met(probes, index, crowded).filter(~earlier).withColumn("distance", hamming(F.col("code"), F.col("query"))).filter("distance <= bound").select("query", "code", "distance", "held")
        if best is not None:
            found = found.unionByName(best.select(*found.columns))
        # a code is kept unless k nearer ids are known: ties at the kth distance stay until ids decide
        nearer = by_query.orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        ranked = found.withColumn("nearer", F.coalesce(F.sum("held").over(nearer), F.lit(0))).filter(F.col("nearer") < k).drop("nearer")
        ranked = ranked.withColumns({"n": F.sum("held").over(by_query), "kth": F.max("distance").over(by_query), "first": F.row_number().over(by_query.orderBy("distance", "code")) == 1})
        ranked = ranked.withColumn("covered", (F.col("n") >= k) & (F.col("kth") <= segments * (radius + 1) - 1))
        seen, old = Observation(), best
        best = cut(ranked.observe(seen, F.count(F.when(F.col("first") & F.col("covered"), 1)).alias("covered")))
        if old is not None:
            drop_cut(old)
        if seen.get["covered"] == counted.get["n"]:
            break
    hits = best.join(entries, "code").select("query", "distance", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    hits = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.withColumnsRenamed({"id": "query_id", "code": "query"}).join(hits, "query").select("query_id", "rank", "id", "distance")
