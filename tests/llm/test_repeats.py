"""op3 and op7 against plain versions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketlake.llm.anchors import PIECE, Unit, blocks_of
from docketlake.llm.bwt import repeated_starts
from docketlake.llm.passages import remove_repeats, spread_rows
from docketlake.llm.suffixes import remove_repeated_bytes

from .frames import frame, pairs, plain, prose


def expected(rows, length, kind):
    parts = [(i, (t or "").encode() if kind == "bytes" else (t or "").encode().split()) for i, t in rows]
    cut = (lambda x, k: x[k : k + length]) if kind == "bytes" else (lambda x, k: tuple(x[k : k + length]))
    counts = Counter(cut(x, k) for _, x in parts for k in range(len(x) - length + 1))
    out = []
    for i, x in parts:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if counts[cut(x, k)] > 1:
                gone[k : k + length] = [True] * length
        kept = [s for s, g in zip(x, gone) if not g]
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        text = bytes(kept) if kind == "bytes" else b" ".join(kept)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(text).hexdigest()))
    return sorted(out, key=repr)


def got(df, total):
    return sorted(((r.doc_id, r[total], r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=repr)


def mixed_rows(seed):
    r = random.Random(seed)
    pool = [prose(r.randrange(20, 90), 100 + k, 30) for k in range(6)]
    return [(i, " ".join(r.choice(pool) if r.random() < 0.6 else prose(r.randrange(1, 60), 1000 * seed + 7 * i + k, 30) for k in range(r.randrange(1, 5)))) for i in range(40)]


def test_passages_of_awkward_rows(spark):
    assert got(remove_repeats(frame(spark)), "n_words") == expected(pairs(), 35, "words")


@pytest.mark.parametrize("seed,length,gram", [(1, 35, 8), (2, 12, 3)])
def test_passages_of_mixed_rows(spark, seed, length, gram):
    rows = mixed_rows(seed)
    assert got(remove_repeats(plain(spark, rows), length=length, gram=gram, shard_bytes=3000), "n_words") == expected(rows, length, "words")


def test_bytes_of_awkward_rows(spark):
    assert got(remove_repeated_bytes(frame(spark)), "n_bytes") == expected(pairs(), 400, "bytes")


@pytest.mark.parametrize("most_blocks", [None, 1])
def test_bytes_of_mixed_rows(spark, most_blocks):
    rows = mixed_rows(3)
    df = remove_repeated_bytes(plain(spark, rows), length=80, gram=8, shard_bytes=4000, most_blocks=most_blocks)
    assert got(df, "n_bytes") == expected(rows, 80, "bytes")


def test_crowded_anchors_are_split_by_context(spark):
    """One passage in many surroundings: every border of it is a crowded anchor."""
    r, passage = random.Random(11), prose(60, 77, 50)
    rows = [(i, prose(r.randrange(0, 12), 500 + i, 9) + " " + passage[r.choice([0, 0, 40]) : r.choice([None, -30])] + " " + prose(r.randrange(0, 12), 900 + i, 9)) for i in range(60)]
    for most in (1, 3, 20):
        df = remove_repeated_bytes(plain(spark, rows), length=80, gram=8, shard_bytes=3000, most_blocks=most)
        assert got(df, "n_bytes") == expected(rows, 80, "bytes")


def test_frequent_keys_are_broadcast(spark, monkeypatch):
    from docketlake.llm import anchors

    rows = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(5000)], "k int, v int")
    counted = rows.groupBy("k").count().filter("k > 0").withColumn("more", F.col("k") * 2)
    joined = anchors.by_key(rows, counted, ["k"], "count", ["more"])
    assert sorted(map(tuple, joined.collect())) == sorted((k, v, 2 * k) for k, v in map(tuple, rows.collect()) if k > 0)


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_one_row_repeated_fills_no_shard(spark, kind):
    rows = [(None, prose(60, 3))] * 40 + [(5, prose(200, 9))] * 30 + [(6, prose(60, 3) + " x")] + [(7, prose(60, 8))]
    if kind == "words":
        shards, spread = spread_rows(plain(spark, rows), 900)
        assert shards > 40 and sorted(r.shares for r in spread.collect()) == sorted(1 + n * len(t) // 900 for n, t in ((40, rows[0][1]), (30, rows[40][1])))
        assert got(remove_repeats(plain(spark, rows), length=12, gram=3, shard_bytes=900), "n_words") == expected(rows, 12, kind)
    else:
        assert got(remove_repeated_bytes(plain(spark, rows), length=80, gram=8, shard_bytes=900), "n_bytes") == expected(rows, 80, kind)


def test_kept_texts(spark):
    base = prose(50, 5)
    rows = {r.doc_id: r for r in remove_repeats(plain(spark, [(1, "x " + base), (2, base + " y"), (3, None)])).collect()}
    assert (rows[1].kept, rows[2].kept, rows[3].kept) == ("x", "y", "")
    assert rows[1].spans == [[1, 51]]


def test_empty_tables(spark):
    empty = plain(spark, []).limit(0)
    assert remove_repeats(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0


def test_blocks_of_a_text_longer_than_a_piece():
    """A text of several pieces gives each of its windows once."""
    from docketlake.llm.anchors import _pieces

    size, length = 2 * PIECE + 12345, 400
    windows = [w for part in _pieces([size], length) for _, b, e in part for w in (b, e - length)]
    assert windows[0] == 0 and windows[-1] == size - length
    assert all(b == a + 1 for a, b in zip(windows[1::2], windows[2::2]))


def test_blocks_cover_every_window_once():
    import numpy as np

    data = np.frombuffer(prose(300, 9, 5).encode(), dtype=np.uint8)
    _, first, n, pos = blocks_of(data, np.array([len(data) - 100, 100]), Unit("bytes", 40, 8))
    starts = sorted(w for f, k in zip(first.tolist(), n.tolist()) for w in range(f, f + k))
    assert starts == [*range(len(data) - 139), *range(len(data) - 100, len(data) - 39)]


def test_transform_search_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        length = r.choice([1, 2, 3, 5, 8])
        texts = [bytes(r.choice(b"ab\x00"[: r.choice([1, 2, 3])]) for _ in range(r.randrange(15))) for _ in range(r.randrange(6))]
        counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = sorted((j, i) for j, t in enumerate(texts) for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1)
        a, b = repeated_starts(texts, length)
        assert sorted(zip(a.tolist(), b.tolist())) == want
