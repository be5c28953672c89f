"""op2: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .mixing import mix_curriculum, training_order


def op2_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first training position (null if not taken).

    The rows are the training stream's, range-sorted, but for later copies of a
    document; documents that aren't taken follow at the end.
    """
    stream = training_order(mix_curriculum(documents(spark, sf_dir), keep=["doc_id"]), untaken=True)
    first = stream.filter("copy = 0 or copy is null")
    return first.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("position").alias("first_position"))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS pattern FROM s),
c AS (SELECT *, CASE pattern WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM w),
l AS (SELECT *, most / weight AS level,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM c),
t AS (SELECT *, round(CASE WHEN level <= share THEN most ELSE weight * max(CASE WHEN level > share THEN share END) OVER () END, 6) AS target FROM l),
b AS (SELECT base.doc_id, base.size, t.source_size, t.target, t.pattern, base.key,
        coalesce(sum(base.size) OVER (PARTITION BY base.source ORDER BY base.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
      FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, passes + CASE WHEN begin_at + size / 2.0::DOUBLE < target - passes * source_size THEN 1 ELSE 0 END AS copies,
        least((begin_at + size / 2.0::DOUBLE) / target, 1.0) AS q FROM b)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN round(CASE pattern
         WHEN 0 THEN 2 * q / (1.2 + sqrt(1.44 - 0.8 * q)) WHEN 1 THEN q ELSE sqrt(q) END, 9) END AS first_position
FROM k
"""
