"""Top-k by text or vector, best row per parent, fusion and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2, literal
from ..shared import cut

#: The fusion's constant and the candidate pool's bounds (fixed values).
RRF_CONSTANT, LEAST_POOL, MOST_POOL = 60, 100, 1000


def pool_size(offset: int, limit: int) -> int:
    return max(LEAST_POOL, min(MOST_POOL, offset + limit))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def best_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by order; one aggregation, no window over a key's rows."""
    fields = F.struct(*[F.struct(o).alias(f"o{i}") for i, o in enumerate(order)])
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*kept), fields).alias("best")).select(key, "best.*")


def knn(rows: DataFrame, row_id: str, vector: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The k rows nearest to a query vector, with distance (l2: smaller is nearer; dot: larger is)."""
    q = literal(query)
    rows = rows.filter(F.col(vector).isNotNull())
    if metric == "dot":
        return top(rows.withColumn("distance", dot(F.col(vector), q)), k, F.desc("distance"), F.col(row_id))
    return top(rows.withColumn("distance", l2(F.col(vector), q)), k, F.col("distance"), F.col(row_id))


def ranked(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, rank): ranks of a list that has already been cut to its candidates."""
    return rows.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(first: DataFrame, second: DataFrame, key: str, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, score, first_rank, second_rank.

    Order by score descending, then first_rank (nulls last), then second_rank.
    """
    both = first.select(key, F.col("rank").alias("first_rank"), F.lit(None).cast("int").alias("second_rank")).unionAll(
        second.select(key, F.lit(None).cast("int").alias("first_rank"), F.col("rank").alias("second_rank"))
    )
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    sums = both.groupBy(key).agg(F.min("first_rank").alias("first_rank"), F.min("second_rank").alias("second_rank"))
    return sums.withColumn("score", part("first_rank") + part("second_rank"))


def fused_order() -> list[Column]:
    return [F.desc("score"), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last()]


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def budget_page(chunks: DataFrame, group: Sequence[str], seq: str, text: str, *, offset: int = 0, limit: int = 3, max_chars: int = 6000) -> DataFrame:
    """Chunks of a page: from offset on, while fewer than limit and, but for the first, within max_chars in all.

    Adds total_chunks and next_offset (null at the end). group: the keys of a document.
    """
    by = Window.partitionBy(*group)
    rows = chunks.withColumn("total_chunks", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(seq)))
    rows = rows.filter(F.col("place") > offset)
    sofar = F.sum(F.length(text)).over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sofar", sofar).filter((F.col("place") <= offset + limit) & ((F.col("place") == offset + 1) | (F.col("sofar") <= max_chars)))
    end = F.max("place").over(by)
    return rows.withColumn("next_offset", F.when(end < F.col("total_chunks"), end)).drop("place", "sofar")


def fallback(rows: DataFrame, key: str, language: str, lang: str = "lang", original: str = "is_original", order: str = "id", version_first: bool = False) -> DataFrame:
    """One text row per key: of the language asked for, else the original, else any; the first by order.

    version_first: of several texts in the language asked for, one that isn't the original.
    """
    preference = F.when(F.col(lang) == language, 0).when(F.col(original) == 1, 1).otherwise(2)
    version = F.when((F.col(lang) == language) & (F.col(original) == 1), 1).otherwise(0) if version_first else F.lit(0)
    return best_per_key(rows, key, preference, version, F.col(order))


def numbered(rows: DataFrame, order: str, id: str) -> DataFrame:
    """rows with ids from 1 on in the order of a column that tells them apart.

    Ranges of the order are sorted in parallel and written once; a row's id is
    its place in its range after the ranges before, whose sizes are one row each.
    """
    sorted_ = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id()))
    part, bits = F.shiftright("_place", 33), (1 << 33) - 1
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    out = sorted_.join(F.broadcast(starts), part == F.col("_part"))  # a row for each range, of which there are as many as shuffle partitions
    return out.withColumn(id, (F.col("_before") + F.col("_place").bitwiseAND(F.lit(bits)) + 1).cast("long")).drop("_place", "_part", "_before")
