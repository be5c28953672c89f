"""op1: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .hamming import top_k


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rows nearest by sign bits to every row whose id is divisible by 20, itself included."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.filter("vec_id % 20 = 0"), k=10)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (SELECT q.id AS query_id, v.id AS id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance FROM v AS q, v WHERE q.id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p)
SELECT * FROM r WHERE rank <= 10
"""
