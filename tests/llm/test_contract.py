"""Columns and types of the queries' results, on the driver's smallest tables."""

import os

import pytest

from docketlake.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")

WANT = {
    "op2_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op13": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}
OTHERS = {
    "op11_phrase_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op12_conversation_repair": {
        "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"
    },
}


@pytest.mark.parametrize("name", [k for k in queries() if k[:4] in WANT])
def test_columns(spark, name):
    df = queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in WANT[name[:4]]} == WANT[name[:4]]
    assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", OTHERS)
def test_columns_of_other_rows(spark, name):
    assert dict(queries()[name](spark, FOLDER).dtypes) == OTHERS[name]
