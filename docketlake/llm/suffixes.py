"""Suffix-array dedup: bytes in strings of a minimum length that occur elsewhere.

Strings that can be equal are brought together by anchors (see ``anchors``).
Blocks of equal content are counted first and enter once. The distinct blocks
of anchors with more than one content go, by anchor, to shards of bounded size;
a shard's Burrows-Wheeler transform is searched by threshold-bounded interval
expansion (see ``bwt``) for the strings that start at two places or more.

Anchors with more distinct blocks than fit in a shard are split by context: a
string has its anchor at one of length - gram + 1 offsets, these are divided
into ranges, and blocks can only share a string of a range if they agree in what
all its offsets have left and right of the anchor. Groups that are still too
large are divided again; a range of one offset has the whole string as context,
so a group of it is one string that occurs as often as the group has blocks.

Defined results: null text is empty; texts shorter than the minimum are kept
whole; matches never cross documents; repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Unit, by_key, distinct_blocks, recurring, recurring_blocks, row_key, runs_of, signed, with_places
from .bwt import repeated_starts
from .common import cut, drop_cut, name

#: Bytes of blocks in a shard.
SHARD_BYTES = 2 << 20


def _slices(length: int):
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("copies", pa.int64()), ("start", pa.int32()), ("pos", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for doc, raw, places in zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in ("doc", "raw", "places")), strict=True):
                    for p in places:
                        content = raw[p["start"] : p["start"] + p["n"] + length - 1]
                        if signed(xxhash.xxh3_64_intdigest(content)) == p["block"]:
                            out.append((doc, p["anchor"], p["block"], p["copies"], p["start"], p["pos"], content))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _trimmed(keys: list, at: list[int], contents: list[bytes], unit: Unit, steps: int = 8) -> tuple[list[int], list[bytes]]:
    """Where in each block strings can begin that another block of its key may hold, and that part of it (empty: none).

    A string around the anchor can only occur in another block if what it has
    left of the anchor, and what it has right of it, also does. Both are tested
    at growing distances, and the block is cut where no other one agrees.
    """
    room = unit.length - unit.gram
    levels = [room * (k + 1) // steps for k in range(steps)]
    seen: Counter = Counter()
    sides_of = []
    for key, content, p in zip(keys, contents, at, strict=True):
        q = p + unit.gram
        left = [(key, content[p - d : p]) for d in levels if p >= d]
        right = [(key, d, content[q : q + d]) for d in levels if q + d <= len(content)]
        sides_of.append((left, right))
        seen.update(left)
        seen.update(right)
    cuts, parts = [], []
    for content, p, sides in zip(contents, at, sides_of, strict=True):
        q, reach = p + unit.gram, []
        for side in sides:
            shared = next((i for i, k in enumerate(side) if seen[k] < 2), len(side))
            reach.append(levels[shared] - 1 if shared < len(levels) else room)
        begin, end = max(0, p - reach[0]), min(len(content), q + reach[1])
        cuts.append(begin)
        parts.append(content[begin:end] if end - begin >= unit.length else b"")
    return cuts, parts


def _search(unit: Unit):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates(["anchor", "key", "block"]).reset_index(drop=True)
        cuts, parts = _trimmed(list(zip(shard["anchor"], shard["key"], strict=True)), shard["pos"].tolist(), shard["content"].tolist(), unit)
        held = np.flatnonzero([len(p) > 0 for p in parts])
        text, offset = repeated_starts([parts[i] for i in held.tolist()], unit.length)
        text = held[text]
        lone = shard["copies"].to_numpy()[text] == 1
        text, offset = text[lone], offset[lone]
        out = shard.iloc[text][["doc", "anchor", "block"]].reset_index(drop=True)
        out["at"] = (shard["start"].to_numpy()[text] + np.array(cuts, dtype=np.int64)[text] + offset).astype(np.int32)
        return out

    return run


#: Ranges that a range of offsets is divided into.
FAN = 8


def _divided(groups: DataFrame, unit: Unit) -> DataFrame:
    """Each block once for every part of its range of offsets in which it has a string, cut to these, keyed by their common context."""
    room = unit.length - unit.gram
    step = F.ceil((F.col("hi") - F.col("lo")) / FAN).cast("int")
    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.struct((F.col("lo") + j * step).alias("lo"), F.least(F.col("hi"), F.col("lo") + (j + 1) * step).alias("hi"))), lambda r: r["lo"] < r["hi"])
    rows = groups.select("doc", "anchor", "block", "copies", "start", "pos", "content", F.explode(ranges).alias("r")).select("*", "r.lo", "r.hi").drop("r")
    right = F.octet_length("content") - F.col("pos") - unit.gram
    rows = rows.filter((F.col("pos") >= F.col("lo")) & (right >= room - F.col("hi") + 1))
    context = F.substr(F.col("content"), F.col("pos") - F.col("lo") + 1, F.col("lo") + (unit.gram + room + 1) - F.col("hi"))
    begin = F.greatest(F.col("pos") - F.col("hi") + 1, F.lit(0))
    end = F.least(F.col("pos") + unit.length - F.col("lo"), F.octet_length("content"))
    return rows.select("anchor", F.xxhash64("lo", "hi", context).alias("key"), "lo", "hi", "doc", "block", "copies", (F.col("start") + begin).alias("start"), (F.col("pos") - begin).alias("pos"), F.substr("content", begin + 1, end - begin).alias("content"))


def _found_in(contents: DataFrame, unit: Unit, shard_bytes: int, most_blocks: int) -> DataFrame:
    """Starts (doc, anchor, block, at) of repeated strings in blocks that occur once."""
    groups = contents.select("anchor", F.lit(0).cast("long").alias("key"), F.lit(0).alias("lo"), F.lit(unit.length - unit.gram + 1).alias("hi"), "doc", "block", "copies", "start", "pos", "content")
    on, out = ["anchor", "key"], []
    while True:
        sizes = groups.groupBy(*on).agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("content")).alias("bytes")).filter("k > 1")
        sizes = cut(sizes)
        fit = sizes.filter(F.col("k") <= most_blocks)
        total = fit.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        shard = F.pmod(F.xxhash64(*on), F.lit(1 + total // shard_bytes)).alias("shard")
        out.append(cut(by_key(groups, fit, on, "k").groupBy(shard).applyInPandas(_search(unit), "doc long, anchor long, block long, at int")))
        crowded = sizes.filter(F.col("k") > most_blocks)
        if crowded.isEmpty():
            break
        large = cut(by_key(groups, crowded, on, "k"))
        if len(out) > 1:
            drop_cut(groups)
        one = F.col("hi") - F.col("lo") == 1
        out.append(cut(large.filter(one & (F.col("copies") == 1)).select("doc", "anchor", "block", (F.col("start") + F.col("pos") - F.col("lo")).alias("at"))))
        groups = cut(_divided(large.filter(~one), unit))
        drop_cut(large, sizes)
    return reduce(DataFrame.unionByName, out)


def repeated_spans(docs: DataFrame, unit: Unit, *, shard_bytes: int = SHARD_BYTES, most_blocks: int | None = None) -> DataFrame:
    """Runs of repeated windows: doc, start, n (windows)."""
    found = recurring(docs, unit)
    blocks = cut(distinct_blocks(found))
    mixed = blocks.filter("mixed").select("doc", "anchor", "block", "copies", "start", "n", "pos")
    contents = cut(with_places(docs, mixed, "doc long, anchor long, block long, copies long, start int, pos int, content binary", _slices(unit.length)))
    parts = runs_of(_found_in(contents, unit, shard_bytes, most_blocks or max(2, shard_bytes // unit.length)))
    out = cut(recurring_blocks(found, blocks).select("doc", "start", "n").unionByName(parts.select("doc", "start", "n")).distinct())
    drop_cut(found, blocks, contents)
    return out


def _remove(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raws, places = part.column("raw").to_pylist(), part.column("places").to_pylist()
                removed, spans, digests, kept = [], [], [], []
                for raw, found in zip(raws, places, strict=True):
                    runs: list[list[int]] = []
                    for begin, end in sorted((p["start"], p["start"] + p["n"] + length - 1) for p in found or ()):
                        if runs and begin <= runs[-1][1]:
                            runs[-1][1] = max(end, runs[-1][1])
                        else:
                            runs.append([begin, end])
                    rest, at = [], 0
                    for begin, end in runs:
                        rest.append(raw[at:begin])
                        at = end
                    left = b"".join([*rest, raw[at:]])
                    removed.append(len(raw) - len(left))
                    spans.append(runs)
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if keep_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeated_bytes(docs: DataFrame, *, length: int = 400, gram: int = 32, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first byte, byte after), kept_sha256, kept (bytes, null unless keep_text), a row for each row of docs."""
    docs = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"))
    spans = repeated_spans(docs, Unit("bytes", length, gram), **limits)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    id_type = dict(docs.dtypes)["doc_id"]
    return rows.join(lists, "doc", "left").select("doc_id", "raw", "places").mapInArrow(
        _remove(length, keep_text), f"doc_id {id_type}, n_bytes long, n_removed long, spans array<array<int>>, kept_sha256 string, kept binary"
    )
