"""op10: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .secrets import scan_secrets


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding of every document: doc_id, kind, start, length, value_sha256, score, is_secret."""
    found = scan_secrets(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", F.explode("findings").alias("f"))
    return found.select(
        "doc_id",
        F.col("f.kind").alias("kind"),
        F.col("f.start").alias("start"),
        F.length("f.value").cast("long").alias("length"),
        F.sha2("f.value", 256).alias("value_sha256"),
        F.col("f.score").alias("score"),
        F.col("f.secret").alias("is_secret"),
    )
