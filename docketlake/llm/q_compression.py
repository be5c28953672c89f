"""op4: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .compression import fit, score


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels.filter(rest != 0))
    held_out = F.coalesce(rest == 0, F.lit(False))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
