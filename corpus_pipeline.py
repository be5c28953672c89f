"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of documents. ``run`` applies them to documents,
writing each stage's result to the shared folder and reading it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.bpe import encode_documents
from docketlake.llm.common import cut, documents, name, prepare
from docketlake.llm.minhash import near_duplicates
from docketlake.llm.mixing import mix_curriculum, training_order
from docketlake.llm.quality import quality_rules
from docketlake.llm.secrets import scan_secrets

#: SQL can't express the outlier estimates, signatures, forest or merges; the tests hold each stage against a plain version.
ORACLE_SQL = None


def _rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents out of an operator's row struct."""
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source.

    Null and empty texts fail the base rules. Null languages and sources are
    values of their own. Repeated rows stay or go together.
    """
    return _rows(quality_rules(docs).filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity of 0.8 or more): the smallest id.

    Repeated rows of one id are one document; rows without id or without words
    stay.
    """
    prepare(spark)
    found = near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")
    again = cut(found.filter("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again_id")))
    if again.isEmpty():
        return left
    once = left.join(again, left["doc_id"] == F.col("again_id"), "left_anti")
    several = left.join(again, left["doc_id"] == F.col("again_id"), "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted again.

    Null and empty texts stay as they are; repeated rows change alike.
    """
    scanned = scan_secrets(docs)
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("clean") != F.col("row.text"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return scanned.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as the mix takes them, range-sorted by training position.

    Null and empty texts have no words and are taken as often as their source
    is repeated. A null source is a source of its own. Repeated rows are taken
    row by row.
    """
    return _rows(training_order(mix_curriculum(docs)), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the stream with its ids: the columns of documents, ids (little-endian unsigned 32-bit) and n_tokens.

    Null and empty texts have no ids and 0 tokens; repeated rows have the same.
    """
    prepare(spark)
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(*[name(c) for c in docs.columns], "ids", F.floor(F.octet_length("ids") / 4).alias("n_tokens"))


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("secret_scan", secrets), ("mix_sources", mixing), ("bpe_encode", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
