"""Repeated windows of fixed length, found by content-chosen anchors.

A window is ``length`` consecutive symbols (words or bytes) of one document.
Its anchor is its smallest gram of ``gram`` symbols under a hash, leftmost on a
tie; equal windows have equal anchors at equal offsets, so only windows with
the same anchor need to be compared. Consecutive windows with one anchor form a
block, the unit that is stored: one row of a few numbers for every
(length - gram) / 2 symbols, instead of one for every symbol. A block also
says where in it the anchor stands (pos).

Blocks with the same content are counted before anything is moved to one place,
so a passage copied a million times is one row for each map task. What is left
are anchors that occur in different blocks; how those are resolved is up to the
caller (``window_counts`` here is exact for groups of any size). Rows are joined
to counted keys by ``by_key``, so the rows of a frequent key never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Symbols whose hashes are in memory at a time; positions in such a piece take POSITION_BITS.
PIECE, POSITION_BITS = 1 << 19, 21
#: Odd multipliers of the gram hash: powers of one odd constant.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, _ODD, dtype=np.uint64))


def _finish(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on (gram a multiple of 8)."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    n = len(data) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(_multipliers(gram // 8)):
            h += (x[8 * j : 8 * j + n] ^ (x[8 * j : 8 * j + n] >> np.uint64(31))) * c
    return _finish(h)


def word_grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    n = len(hashes) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(_multipliers(gram)):
            h += hashes[j : j + n] * c
    return _finish(h)


@dataclass(frozen=True)
class Unit:
    """What is compared: kind 'words' or 'bytes', the window's length and the gram's."""

    kind: str
    length: int
    gram: int

    def split(self, raw: bytes) -> tuple[np.ndarray, bytes, np.ndarray | None]:
        """Symbols, the text whose slices are windows, and where each symbol begins in it (None: one byte each)."""
        if self.kind == "bytes":
            return np.frombuffer(raw, dtype=np.uint8), raw, None
        parts = raw.split()
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        begins = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=begins[1:])
        return np.array(list(map(xxhash.xxh3_64_intdigest, parts)), dtype=np.uint64), joined, begins

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        return byte_grams(symbols, self.gram) if self.kind == "bytes" else word_grams(symbols, self.gram)


def cut_out(text: bytes, begins: np.ndarray | None, start: int, n: int) -> bytes:
    """n symbols of a split text."""
    return text[start : start + n] if begins is None else text[begins[start] : begins[start + n] - 1]


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def blocks_of(symbols: np.ndarray, sizes: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows and the anchor's place in every block of documents laid end to end."""
    h, length, n = unit.grams(symbols), unit.length, len(symbols)
    ends = np.cumsum(sizes)
    span_end = np.repeat(ends, sizes)
    at = np.arange(len(h))
    low = np.uint64((1 << POSITION_BITS) - 1)
    key = (h & ~low) | at.astype(np.uint64)
    width = length - unit.gram + 1
    least, span = key, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    windows = np.flatnonzero(np.arange(n - length + 1) + length <= span_end[: n - length + 1])
    if not len(windows):
        return np.zeros(0, np.int64), windows, windows, windows
    anchor = (least[windows] & low).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)))
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate((first, [len(windows)])))
    return h[anchor[first]].view(np.int64), windows[first], counts, anchor[first] - windows[first]


def _pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, begin, end) of at most PIECE symbols; long documents in overlapping parts."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        begin = 0
        while size - begin >= length:
            end = min(size, begin + PIECE)
            if total and total + end - begin > PIECE:
                yield held
                held, total = [], 0
            held.append((i, begin, end))
            total += end - begin
            if end == size:
                break
            begin = end - length + 1
    if held:
        yield held


#: Windows that are handed on at once.
AT_ONCE = 20_000
BLOCK_ROWS = "doc long, anchor long, block long, start int, n int, pos int"


def _scan(unit: Unit):
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 256):
                texts = [unit.split(x) for x in batch.column(1).slice(lo, 256).to_pylist()]
                for part in _pieces([len(t[0]) for t in texts], unit.length):
                    sizes = np.array([e - b for _, b, e in part])
                    anchors, firsts, counts, pos = blocks_of(np.concatenate([texts[i][0][b:e] for i, b, e in part]), sizes, unit)
                    offsets = np.cumsum(sizes) - sizes
                    which = np.searchsorted(offsets, firsts, side="right") - 1
                    docs = np.array([i for i, _, _ in part])[which]
                    starts = firsts - offsets[which] + np.array([b for _, b, _ in part])[which]
                    content = np.fromiter(
                        (xxhash.xxh3_64_intdigest(cut_out(texts[i][1], texts[i][2], s, c + unit.length - 1)) for i, s, c in zip(docs.tolist(), starts.tolist(), counts.tolist(), strict=True)),
                        dtype=np.uint64,
                        count=len(docs),
                    ).view(np.int64)
                    ints = [pa.array(x.astype(np.int32)) for x in (starts, counts, pos)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + docs]), pa.array(anchors), pa.array(content), *ints], schema=schema)

    return run


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart; rows alike in both have the same key, and the same windows."""
    return F.xxhash64(doc_id, text)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, raw): each row's key and text as bytes, null as empty."""
    t = F.col(text)
    return docs.select(row_key(F.col(doc_id), t).alias("doc"), F.coalesce(t.cast("binary"), F.lit(b"")).alias("raw"))


#: Keys that by_key treats as frequent are fewer than this (24 bytes each).
MOST_FREQUENT = 20_000


def by_key(rows: DataFrame, counted: DataFrame, on: list[str], count: str, columns: list[str] = []) -> DataFrame:  # noqa: B006
    """rows of the keys in counted, a table of distinct keys and how many rows each has, with columns of it.

    Keys of more than a 20,000th of all rows (and of 1,000 at least) are fewer
    than 20,000: these are broadcast, and their rows stay where they are. The
    others are joined by a shuffle.
    """
    total, largest = counted.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    most = max(1000, total // MOST_FREQUENT)
    if largest <= most:
        return rows.join(counted.select(*on, *columns), on)
    frequent = F.broadcast(counted.filter(F.col(count) > most).select(*on, *columns))
    others = rows.join(frequent.select(*on), on, "left_anti")
    return rows.join(frequent, on).unionByName(others.join(counted.filter(F.col(count) <= most).select(*on, *columns), on))


def recurring(docs: DataFrame, unit: Unit) -> DataFrame:
    """Blocks whose anchor occurs more than once: doc, anchor, block, start, n, pos, mixed.

    mixed: the anchor occurs in blocks of different content.
    """
    found = cut(keyed(docs).mapInArrow(_scan(unit), BLOCK_ROWS))
    several = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), (F.min("block") != F.max("block")).alias("mixed")).filter("k > 1"))
    out = cut(by_key(found, several, ["anchor"], "k", ["mixed"]))
    drop_cut(found, several)
    return out


def distinct_blocks(found: DataFrame) -> DataFrame:
    """One row for each content: anchor, block, pos, n, mixed, copies and one place (doc, start)."""
    return (
        found.groupBy("anchor", "block")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("mixed").alias("mixed"), F.min(F.struct("doc", "start", "n", "pos")).alias("at"))
        .select("anchor", "block", "copies", "mixed", "at.doc", "at.start", "at.n", "at.pos")
    )


def recurring_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """The places of blocks that occur as a whole more than once."""
    return by_key(found, blocks.filter("copies > 1"), ["anchor", "block"], "copies")


def with_places(docs: DataFrame, places: DataFrame, out: str, run) -> DataFrame:
    """Apply run (Arrow batches of doc, raw, places) to the documents that have places.

    places: rows keyed by doc; a document's own blocks, so no list outgrows its text.
    """
    lists = places.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "doc"])).alias("places"))
    rows = keyed(docs).join(lists, "doc")
    return rows.mapInArrow(run, out)


def window_counts(docs: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """Runs of windows of blocks that occur once which also occur in another block of their anchor.

    Exact for groups of any size: windows are counted by hash, summed before
    they are moved. Rows: doc, anchor, block, start, n.
    """
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("copies", pa.int64()), ("at", pa.int32()), ("window", pa.int64())])
    length = unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for doc, raw, places in zip(*(batch.column(c).slice(lo, 64).to_pylist() for c in ("doc", "raw", "places")), strict=True):
                    symbols, text, begins = unit.split(raw)
                    for p in places:
                        s, n = p["start"], p["n"]
                        if s + n + length - 1 > len(symbols) or signed(xxhash.xxh3_64_intdigest(cut_out(text, begins, s, n + length - 1))) != p["block"]:
                            continue  # another row with an equal key
                        for x, v in zip(cols, (doc, p["anchor"], p["block"], p["copies"]), strict=False):
                            x.extend([v] * n)
                        cols[4].extend(range(s, s + n))
                        cols[5].extend(signed(xxhash.xxh3_64_intdigest(cut_out(text, begins, i, length))) for i in range(s, s + n))
                        if len(cols[0]) >= AT_ONCE:
                            yield full()
                            cols = [[] for _ in schema]
        if cols[0]:
            yield full()

    rows = cut(with_places(docs, mixed.select("doc", "anchor", "block", "copies", "start", "n"), "doc long, anchor long, block long, copies long, at int, window long", run))
    # the windows of one block all differ, as each has the anchor at another offset
    counts = rows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("k"), (F.min("block") != F.max("block")).alias("shared"))
    shared = cut(counts.filter("shared").select("anchor", "window", "k"))
    out = cut(runs_of(by_key(rows.filter("copies = 1"), shared, ["anchor", "window"], "k")))
    drop_cut(rows, shared)
    return out


def runs_of(windows: DataFrame) -> DataFrame:
    """Consecutive windows (doc, anchor, block, at) as runs (doc, anchor, block, start, n)."""
    ats = F.array_sort(F.collect_set("at"))
    lists = windows.groupBy("doc", "anchor", "block").agg(ats.alias("ats"))
    return (
        lists.select("doc", "anchor", "block", F.posexplode("ats").alias("i", "at"))
        .groupBy("doc", "anchor", "block", (F.col("at") - F.col("i")).alias("run"))
        .agg(F.min("at").alias("start"), F.count(F.lit(1)).cast("int").alias("n"))
        .select("doc", "anchor", "block", "start", "n")
    )
