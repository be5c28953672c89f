"""op13: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .sharding import shard_documents
from .sql import CRC_TABLE, crc32

SHARDS = 40


def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, over 40 shards of equal weight."""
    out = shard_documents(documents(spark, sf_dir), [(s, 1.0) for s in range(SHARDS)], more=(SHARDS, 1.0), keep=["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP13_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32("coalesce(text, '')")} AS crc FROM documents, crc_table),
b AS (SELECT r, s, 1 / -ln((CAST('0x' || substr(md5(s || ':' || key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS bid FROM d, range(41) AS x(s)),
p AS (SELECT r, arg_max(s, bid) FILTER (s < 40) AS shard, arg_max(s, bid) AS grown FROM b GROUP BY r),
o AS (SELECT *, CAST('0x' || substr(md5('slot:' || key || ':' || crc || ':' || size), 1, 15) AS BIGINT) AS place FROM d JOIN p USING (r))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place, key, crc, size) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM o
"""
