"""op6: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .minhash import near_duplicates


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, by shingles of 2 words."""
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80)
