"""op3: the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .passages import remove_repeats


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_repeats(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
