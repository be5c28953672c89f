"""Substring dedup by automata of repeated phrases.

1. Confirm recurring passages: windows of ``length`` words that start at two
   places or more, found by anchors (see ``anchors``), as whole blocks where the
   block recurs and as runs of windows where only a part of it does.
2. Compile sharded Aho-Corasick automata: a shard is a bounded part of the
   documents; its automaton holds each passage that occurs in it once, as a
   sequence of word numbers, so memory follows the shard and not the corpus.
3. Stream every document of the shard through the automaton to locate every
   occurrence of every passage; the words covered are repeated.

A document's shard follows from its row's key. Rows that are alike in id and
text are dealt over as many shards as their bytes need, each with their
passages, so a row that is repeated without bound doesn't fill one shard.

Defined results: null text has no words; a text shorter than the window is kept
whole; a text's words are joined by single spaces; repeated rows repeat each
other, so all their windows are covered.
"""

from __future__ import annotations

import hashlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .anchors import MOST_FREQUENT, Unit, distinct_blocks, recurring, recurring_blocks, row_key, signed, window_counts
from .common import cut, drop_cut, name

#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20


def spread_rows(docs: DataFrame, shard_bytes: int) -> tuple[int, DataFrame]:
    """The number of shards, and (doc, shares): the keys of rows that are repeated so often that they are dealt over shares of shards.

    These are fewer than MOST_FREQUENT and so a small table.
    """
    size = F.octet_length("text").cast("long")
    keys = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), F.coalesce(size, F.lit(0)).alias("size"))
    keys = cut(keys.groupBy("doc").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("bytes")))
    n, total = keys.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    most, bytes_ = max(1, n // MOST_FREQUENT), max(shard_bytes, total // MOST_FREQUENT)
    return 1 + total // shard_bytes, keys.filter((F.col("k") > most) & (F.col("bytes") > bytes_)).select("doc", (F.floor(F.col("bytes") / shard_bytes) + 1).cast("int").alias("shares"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc", "share"), F.lit(shards)).cast("int").alias("shard")


def confirmed_passages(docs: DataFrame, unit: Unit, shards: int, spread: DataFrame) -> DataFrame:
    """Passages to look for: shard, doc, start, n (words) of one place in each shard, and its hash if it is a block."""
    found = recurring(docs, unit)
    blocks = cut(distinct_blocks(found))
    parts = window_counts(docs, blocks.filter("mixed"), unit)
    every = F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1)
    whole = recurring_blocks(found, blocks).join(F.broadcast(spread), "doc", "left").withColumn("share", F.explode(every))
    whole = whole.groupBy(_shard(shards), "anchor", "block").agg(F.min(F.struct("doc", "start", "n")).alias("at"))
    whole = whole.select("shard", "at.doc", "at.start", (F.col("at.n") + (unit.length - 1)).alias("n"), "block", F.lit(True).alias("whole"))
    some = parts.withColumn("share", F.lit(0)).select(_shard(shards), "doc", "start", (F.col("n") + (unit.length - 1)).alias("n"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("whole"))
    out = cut(whole.unionByName(some))
    drop_cut(found, blocks)
    return out


def _covered(ids: list[int], automaton, least: int) -> np.ndarray | None:
    """Which words of a text lie in an occurrence of a passage; None if there is no occurrence.

    ids: numbers of the words that passages hold, 0 for others. Only stretches
    of least such words or more can hold a passage and are streamed.
    """
    gaps = np.flatnonzero(np.array(ids, dtype=np.int64) == 0)
    begins, stops = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(ids)]))
    long = np.flatnonzero(stops - begins >= least)
    hits = []
    for begin, stop in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
        found = list(automaton.iter(tuple(ids[begin:stop])))
        if found:
            hits.append(np.array(found, dtype=np.int64) + (begin, 0))
    if not hits:
        return None
    ends, sizes = np.concatenate(hits).T
    edge = np.bincount(ends - sizes + 1, minlength=len(ids) + 1) - np.bincount(ends + 1, minlength=len(ids) + 1)
    return np.cumsum(edge[:-1]) > 0


class _Numbers(dict):
    """Numbers words from 1 in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def locate(unit: Unit, keep_text: bool, id_type: pa.DataType):
    """The function of a shard: its documents and its passages to spans and what is kept."""
    types = [("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept_sha256", pa.string()), ("kept", pa.string())]

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        import ahocorasick

        numbers = _Numbers()
        split = [raw.as_py().split() for raw in docs["raw"]]
        rows: dict[int, list[int]] = {}
        for i, doc in enumerate(docs["doc"].to_pylist()):
            rows.setdefault(doc, []).append(i)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for doc, start, n, block, whole in zip(*(places[c].to_pylist() for c in ("doc", "start", "n", "block", "whole")), strict=True):
            for i in rows.get(doc, ()):
                passage = split[i][start : start + n]
                if len(passage) == n and (not whole or signed(xxhash.xxh3_64_intdigest(b" ".join(passage))) == block):
                    automaton.add_word(tuple(map(numbers.__getitem__, passage)), int(n))
        found = len(automaton) > 0
        if found:
            automaton.make_automaton()
        out: list[list] = [[] for _ in types]
        for i, parts in enumerate(split):
            gone = _covered(list(map(numbers.get, parts, repeat(0))), automaton, unit.length) if found and parts else None
            if gone is None:
                kept, spans, n_gone = b" ".join(parts), [], 0
            else:
                kept = b" ".join(compress(parts, (~gone).tolist()))
                spans = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2).tolist()
                n_gone = int(gone.sum())
            for column, x in zip(out[1:], (len(parts), n_gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None), strict=True):
                column.append(x)
            split[i] = []
        return pa.table([docs["doc_id"], *[pa.array(x, t) for x, (_, t) in zip(out[1:], types[1:], strict=True)]], schema=pa.schema(types))

    return run


def remove_repeats(docs: DataFrame, *, length: int = 35, gram: int = 8, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word, word after), kept_sha256 and kept (null unless keep_text), a row for each row of docs."""
    docs = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"))
    unit = Unit("words", length, gram)
    shards, spread = spread_rows(docs, shard_bytes)
    places = confirmed_passages(docs, unit, shards, spread)
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")).join(F.broadcast(spread), "doc", "left")
    rows = rows.withColumn("share", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("shares")), F.lit(0)).cast("int")).select(_shard(shards), "doc", "doc_id", "raw")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(
        locate(unit, keep_text, to_arrow_type(docs.schema["doc_id"].dataType)), f"doc_id {kind}, n_words long, n_removed long, spans array<array<int>>, kept_sha256 string, kept string"
    )
