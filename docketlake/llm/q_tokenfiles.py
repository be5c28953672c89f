"""op5: the query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents
from .tokenfiles import pack, token_counts

END_OF_DOCUMENT = 50256

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text; null is empty."""
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [np.array(encoder(path).encode_ordinary(t), dtype="<u4").tobytes() if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return fields.mapInArrow(run, "doc_id long, ids binary")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, from a scan of flat token files of all documents."""
    ids = tokenised(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    files = cut(pack(ids, "documents", "ids", "doc_id", width=2, end=END_OF_DOCUMENT))
    counts = token_counts(files, width=2, end=END_OF_DOCUMENT)
    manifest = files.select("file", F.col("block").alias("closing_block"), F.posexplode("doc_ids").alias("place", "doc_id"))
    return counts.filter("closed").join(manifest, ["file", "closing_block", "place"]).select("doc_id", "n_tokens")
