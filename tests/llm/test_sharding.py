"""op13 against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from docketlake.llm.sharding import shard_documents, write_shards

from .frames import frame, pairs, plain

SHARDS = [(0, 1.0), (1, 2.5), (2, 0.5), (7, 1.0)]


def bid(key, shard, weight):
    u = (int(hashlib.md5(f"{shard}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return weight / -math.log(u)


def expected(rows, shards, more):
    placed = []
    for i, text in rows:
        key, raw = "null" if i is None else str(i), (text or "").encode()
        size, crc = len(raw) + 16, zlib.crc32(raw)
        best = max(shards, key=lambda s: bid(key, *s))
        order = int(hashlib.md5(f"slot:{key}:{crc}:{size}".encode()).hexdigest()[:15], 16)
        placed.append((best[0], order, key, crc, size, i, more[0] if bid(key, *more) > bid(key, *best) else best[0]))
    out, slots = [], Counter()
    for shard, _, _, crc, size, i, grown in sorted(placed, key=lambda x: x[:5]):
        out.append((i, size, crc, shard, slots[shard], grown))
        slots[shard] += 1
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.row.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.grown_shard) for r in df.collect()), key=repr)


def test_by_brute_force_with_awkward_rows(spark):
    df = shard_documents(frame(spark), SHARDS, more=(9, 1.0))
    assert got(df) == expected(pairs(), SHARDS, (9, 1.0))
    assert df.select("row.*").columns == frame(spark).columns


def test_a_hot_key_and_rows_alike(spark):
    rows = [(None, "same")] * 3000 + [(None, f"text {i % 700}") for i in range(2000)] + [(i, "x") for i in range(2000)]
    df = shard_documents(plain(spark, rows).repartition(7), SHARDS, more=(9, 1.0), keep=["doc_id"])
    assert got(df) == expected(rows, SHARDS, (9, 1.0))


def test_shares_follow_weights_and_few_rows_move(spark):
    rows = [(i, None) for i in range(20000)]
    found = shard_documents(plain(spark, rows), SHARDS, more=(9, 1.0), keep=["doc_id"]).collect()
    counts = Counter(r.shard for r in found)
    for shard, weight in SHARDS:
        assert abs(counts[shard] / 20000 - weight / 5) < 0.02
    assert {r.grown_shard for r in found if r.grown_shard != r.shard} == {9}
    assert abs(sum(r.grown_shard == 9 for r in found) / 20000 - 1 / 6) < 0.02


def test_empty_table_and_weights(spark):
    assert shard_documents(plain(spark, [(1, "a")]).limit(0), SHARDS).collect() == []
    with pytest.raises(ValueError):
        shard_documents(plain(spark, [(1, "a")]), [(0, 0.0)])
    assert shard_documents(plain(spark, [(1, "a")]), SHARDS).first().grown_shard is None


def test_written_shards(spark, tmp_path):
    df = shard_documents(frame(spark), SHARDS)
    write_shards(df, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r._shard, r._slot, r.doc_id) for r in back.collect() if r.doc_id) == sorted((r.shard, r.slot, r.row.doc_id) for r in df.collect() if r.row.doc_id)
