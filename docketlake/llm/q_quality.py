"""op8: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .quality import quality_rules


def op8_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return quality_rules(documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", "counts.*", "base_failed", "kept")
