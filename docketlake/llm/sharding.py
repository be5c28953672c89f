"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard bids weight / -ln(u) for a key, u in (0, 1) from md5 of shard and
key; the highest bid holds it. A shard's share of the keys is its share of the
weights, and one more shard takes keys only into itself, since no other bid
changes. Bids are expressions, so rows are placed without a shuffle.

Slots number the rows of a shard from 0 without gaps. The order is a hash of
key and text, then both; its first 12 bits cut a shard into buckets, rows alike
are counted in each input partition before they are moved, and no window holds
more than a bucket's different rows or one input partition's copies of one row.

Defined results: a null key is a key of its own (all its rows lie in one
shard); null text is empty; repeated rows lie in one shard and take one slot
each, which of them takes which is open; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, name, packed

#: Added to each text's bytes (fixed value).
OVERHEAD = 16
#: Hexadecimal digits of a bid's hash and of the order's, and the order's bits within a bucket.
BID_DIGITS, ORDER_DIGITS, BUCKET_BITS = 13, 15, 48


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of md5(text) as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def bid(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key (a string)."""
    u = (_number(F.concat(F.lit(f"{shard}:"), key), BID_DIGITS) + 0.5) / float(16**BID_DIGITS)
    return F.lit(float(weight)) / -F.log(u)


def placed(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The highest bid (bid, shard) of weighted shards; weights are above 0."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("shards need weights above 0")
    return F.array_max(F.array(*[F.struct(bid(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in shards]))


def shard_documents(
    docs: DataFrame, shards: Sequence[tuple[int, float]], *, more: tuple[int, float] | None = None, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Rows (row, size, text_crc32, shard, slot, grown_shard): the columns of docs (or those in keep) and where each row lies.

    shards: (number, weight). more: one more shard; grown_shard is where a row
    lies with it, null without.
    """
    kept = docs if keep is None else docs.select(*[name(c) for c in keep])
    raw = F.coalesce(name(text).cast("binary"), F.lit(b""))
    k = F.coalesce(name(key).cast("string"), F.lit("null"))
    rows = docs.select(packed(kept), k.alias("key"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), placed(k, shards).alias("best"))
    grown = F.lit(None).cast("int") if more is None else F.when(bid(F.col("key"), *more) > F.col("best.bid"), F.lit(more[0])).otherwise(F.col("best.shard"))
    order = _number(F.concat_ws(":", F.lit("slot"), "key", "text_crc32", "size"), ORDER_DIGITS)
    rows = rows.select("row", "key", "size", "text_crc32", F.col("best.shard").alias("shard"), grown.alias("grown_shard"), order.alias("place"), F.spark_partition_id().alias("part"))
    return with_slots(cut(rows)).select("row", "size", "text_crc32", "shard", "slot", "grown_shard")


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (shard, place, key, text_crc32, size, part) of a written table with slot, their number in the shard."""
    bucket = F.shiftright("place", BUCKET_BITS)
    alike = ["shard", "place", "key", "text_crc32", "size", "part"]
    groups = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "bucket", before("n", Window.partitionBy("shard").orderBy("bucket")).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "key", "text_crc32", "size", "part")
    starts = groups.withColumn("bucket", bucket).withColumn("start", before("n", within)).join(offsets, ["shard", "bucket"]).select(*alike, (F.col("start") + F.col("offset")).alias("first"))
    copy = F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0)))
    return rows.join(starts, alike).withColumn("slot", (F.col("first") + copy - 1).cast("long"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write the rows of shard_documents as one folder a shard, in files sorted by slot; a shard may be many files."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
