"""op9 against the tokenizers library, op5 against plain counting."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketlake.llm.bpe import PairIndexBPE, decode_ids, encode_documents
from docketlake.llm.q_bpe import digests
from docketlake.llm.q_tokenfiles import encoder, op5_token_counts
from docketlake.llm.tokenfiles import blocks_of_files, pack, token_counts

from .frames import frame, pairs, plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    r = random.Random(1)
    texts = ["", "a", "aaaaaaa bbbbbbb", "x" * 3000, "<|endoftext|>a<|endoftext|>  <|endoftext|>", "it's we'll  \n\n\t x", "\x1c\x1d a\x85b\xa0c d", "ſ ǅ ª º ⅷ ½ ²", "don't'D 'S", " "]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(256), r.randrange(256, 0x3000), 32, 10])) for _ in range(50)) for _ in range(500)]
    ours = PairIndexBPE(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coded = ours.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == want
    assert [ours.decode(x) for x in coded] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_documents_keep_their_columns(spark, library):
    docs = frame(spark)
    rows = encode_documents(docs, PATH, ids="score").collect()
    assert rows[0].asDict().keys() == {*docs.columns}
    assert sorted((repr(r.text), bytes(r.score)) for r in rows) == sorted((repr(t), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for _, t in pairs())


def test_round_trip_and_digests(spark):
    back = decode_ids(encode_documents(frame(spark).select("doc_id", "text"), PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert digests(frame(spark), PATH).count() == len(pairs())
    assert digests(plain(spark, []).limit(0), PATH).count() == 0


def counted(ids, end):
    out, n = [], 0
    for v in ids:
        if v == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + [(n, False)] * (n > 0)


@pytest.mark.parametrize("sparse,stretch", [(False, 3), (True, 2), (True, 4096)])
def test_flat_files(spark, tmp_path, monkeypatch, sparse, stretch):
    monkeypatch.setattr("docketlake.llm.tokenfiles.STRETCH", stretch)
    r, want = random.Random(7), {}
    for f in range(4):
        ids = [r.choice([1] * 60 + [0] if sparse else [0, 0, 1, 2]) for _ in range(r.choice([0, 1, 50, 401]))]
        np.array(ids, dtype="<u2").tofile(tmp_path / f"{f}.bin")
        want[f"{f}.bin"] = counted(ids, 0)
    got = {k: [] for k in want}
    rows = token_counts(blocks_of_files(spark, str(tmp_path), block_bytes=8), width=2, end=0).collect()
    for row in sorted(rows, key=lambda x: (x.file, x.ordinal)):
        got[row.file.rpartition("/")[2]].append((row.n_tokens, row.closed))
    assert got == want


def test_pack_and_scan(spark):
    r = random.Random(3)
    docs = [(i, np.array([r.randrange(1, 9) for _ in range(r.choice([0, 1, 5, 700]))], "<u4").tobytes()) for i in range(50)] + [(None, None)]
    tokens = spark.createDataFrame(docs, "doc_id long, ids binary").repartition(3)
    files = pack(tokens, "f", "ids", "doc_id", width=2, end=9, block_bytes=64).persist()
    counts = token_counts(files, width=2, end=9)
    assert sorted(x.n_tokens for x in counts.collect()) == sorted(len(b or b"") // 4 for _, b in docs)
    from pyspark.sql import functions as F

    manifest = files.select("file", F.col("block").alias("closing_block"), F.posexplode("doc_ids").alias("place", "doc_id"))
    found = {x.doc_id: x.n_tokens for x in counts.join(manifest, ["file", "closing_block", "place"]).collect()}
    assert found == {i: len(b or b"") // 4 for i, b in docs}


def test_a_file_of_more_than_two_gib(spark, tmp_path):
    """A sparse file of one id, with ends near its begin, across a block's edge and far behind."""
    size, ends = (1 << 31) + (1 << 22), [5, (1 << 17) - 1, 1 << 17, (1 << 30) + 12345]
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        for at in ends:
            f.seek(2 * at)
            f.write(b"\x07\x00")
    rows = token_counts(blocks_of_files(spark, str(tmp_path)), width=2, end=7).orderBy("ordinal").collect()
    want = [b - a - 1 for a, b in zip([-1, *ends], [*ends, size // 2])]
    assert [(r.n_tokens, r.closed) for r in rows] == [(n, i < len(ends)) for i, n in enumerate(want)]


def test_the_query_by_plain_counting(spark, tmp_path):
    frame(spark).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    plainly = lambda t: len(encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary(t)) if t else 0
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, op5_token_counts(spark, str(tmp_path)).collect()), key=key) == sorted(((i, plainly(t)) for i, t in pairs()), key=key)
    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        assert sorted(map(tuple, op5_token_counts(spark, folder).collect())) == sorted((d.doc_id, plainly(d.text)) for d in docs)
