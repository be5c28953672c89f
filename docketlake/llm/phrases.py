"""Phrases that recur, and how far their words attract each other, by growing patterns to the right.

A phrase is 2 to ``longest`` consecutive words of a piece (texts are split at
punctuation and line ends) that occur at least ``least`` times in a language.
Frequent prefixes are projected as in PrefixSpan: a pointer to each occurrence,
with the words that follow, sorted so that all pointers of a prefix are one
range. A task grows its prefixes depth first: a range splits into the ranges of
the next word, and those below the threshold aren't followed.

- Every occurrence of a frequent phrase is projected: pairs of words are counted
  in 2^bits bins of a hash, and only pairs in bins below the threshold are left
  out. The bins' verdicts are a bit each, at most 2^bits / 8 bytes, broadcast.
- Equal projections are counted before they are moved, and those left are dealt
  by ranges, so a frequent prefix is spread over tasks. A range border may cut
  the prefixes that it lies in: these are reported whatever their count, and the
  parts' counts are added up before the threshold decides. Arrow batches are
  treated alike, so a task holds one batch at a time.

Defined results: null text is empty; a null language is ``und``; texts are read
whole; repeated rows count each time; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import by_key
from .common import cut, drop_cut

#: Characters that end a piece and those between words (fixed values).
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
#: The language of rows without one (fixed value).
NO_LANGUAGE = "und"
#: The words of a phrase, apart in sorted keys: less than any character of a word, once escape() has been there.
APART = "\0"
#: Bytes of text whose words are in memory at a time.
PIECE_BYTES = 1 << 21
#: Bits of a bin's number within a row of the broadcast table.
ROW_BITS = 15
#: Shares in which a language's phrases are ranked before all are.
SHARES = 64
_END = b"\xff"
_TABLE = bytes(0xFF if chr(i) in ENDS else 0x20 if chr(i) in GAPS else i for i in range(256)).lower()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def escape(raw: bytes) -> bytes:
    """Without NUL; order and equality of words stay."""
    return raw.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


def word_stream(raw: bytes) -> list[bytes]:
    """The words of a text in lower case (A-Z only), with _END where a piece ends."""
    return escape(raw).translate(_TABLE).replace(_END, b" " + _END + b" ").split()


class _Words:
    """Texts of one language as numbers of their distinct words."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.stream, self.size = lang, {_END: 0}, [], 0
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())

    def add(self, raw: bytes) -> None:
        numbers = self.numbers
        self.stream.extend([numbers.setdefault(w, len(numbers)) for w in word_stream(raw)])
        self.stream.append(0)
        self.size += len(raw)

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stream, the places where a pair begins, and the pairs' bins."""
        ids = np.array(self.stream, dtype=np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) for w in self.numbers), np.uint64, len(self.numbers))
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        with np.errstate(over="ignore"):
            mixed = (hashes[ids[at]] * _ODD) ^ hashes[ids[at + 1]]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _ODD
        return ids, at, (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _languages(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """The texts (lang, raw) by language, a bounded number of bytes at a time; one text is never split."""
    held: dict[str, _Words] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for lang, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = held.get(lang) or held.setdefault(lang, _Words(lang))
                words.add(raw)
                if words.size >= PIECE_BYTES:
                    yield held.pop(lang)
            if sum(w.size for w in held.values()) >= 4 * PIECE_BYTES:
                yield from held.values()
                held = {}
    yield from held.values()


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("bin", pa.int64()), ("n", pa.int64())])
_WINDOWS = pa.schema([("lang", pa.string()), ("window", pa.binary())])


def _count(bits: int):
    """Counts of each word and of each bin of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _languages(batches):
            ids, _, bins = words.pairs(bits)
            n = np.bincount(ids, minlength=len(words.numbers))[1:]
            bins, k = np.unique(bins, return_counts=True)
            nulls = lambda m, t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(n), pa.string()), pa.array(list(words.numbers)[1:], pa.binary()), nulls(len(n), pa.int64()), pa.array(n)], schema=_COUNTED)
            for lo in range(0, len(bins), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([nulls(len(bins[part]), pa.string()), nulls(len(bins[part]), pa.binary()), pa.array(bins[part]), pa.array(k[part])], schema=_COUNTED)

    return run


def _project(bits: int, longest: int, frequent):
    """Each place where a frequent pair begins, with the words that follow while their pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(frequent.value, np.uint8)
        apart = APART.encode()
        for words in _languages(batches):
            ids, at, bins = words.pairs(bits)
            good = (table[bins >> 3] >> (bins & 7)) & 1 == 1
            follows = np.zeros(len(ids) + longest, dtype=np.int64)
            follows[at[good]] = 1
            reach = follows.copy()  # how many pairs follow on each other from here, longest - 1 at most
            for _ in range(longest - 2):
                reach[:-1] = follows[:-1] * (1 + reach[1:])
            spelled = list(words.numbers)
            tokens = [spelled[j] for j in words.stream]
            begins = at[good]
            ends = begins + 1 + reach[begins]
            for lo in range(0, len(begins), 1 << 15):
                part = slice(lo, lo + (1 << 15))
                windows = [apart.join(tokens[i:j]) for i, j in zip(begins[part].tolist(), ends[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(windows), pa.string()), pa.array(windows, pa.binary())], schema=_WINDOWS)

    return run


def grown(projected: list[tuple[str, list[str]]], n: list[int], least: int) -> list[tuple[str, list[str], int]]:
    """Phrases of sorted projections (language, words), with their counts.

    Those of the first and the last projection are given whatever their count.
    """
    total = np.concatenate([[0], np.cumsum(np.array(n, dtype=np.int64))])
    last, out = len(projected), []
    common = [0] * last  # words that a projection shares with the one before
    for i in range(1, last):
        (lang, a), (other, b) = projected[i - 1], projected[i]
        k = 0
        if lang == other:
            k = 1
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                k += 1
        common[i] = k  # 0: another language, 1: the language, 2: the first word, ...
    common = np.array(common, dtype=np.int64)

    def extend(lo: int, hi: int, depth: int) -> None:
        """Grow the prefix that projections lo to hi - 1 share, of depth words."""
        while lo < hi and len(projected[lo][1]) == depth:
            lo += 1  # the pointers whose pieces end here
        if lo == hi:
            return
        borders = np.concatenate([[lo], lo + 1 + np.flatnonzero(common[lo + 1 : hi] <= depth + 1), [hi]])
        counts = total[borders[1:]] - total[borders[:-1]]
        for j in np.flatnonzero((counts >= least) | (borders[:-1] == 0) | (borders[1:] == last)).tolist():
            i, k = int(borders[j]), int(borders[j + 1])
            if depth:
                out.append((projected[i][0], projected[i][1][: depth + 1], int(counts[j])))
            extend(i, k, depth + 1)

    languages = np.concatenate([[0], np.flatnonzero(common == 0)[1:], [last]]) if last else []
    for lo, hi in zip(languages[:-1], languages[1:], strict=True):
        extend(int(lo), int(hi), 0)
    return out


def _grow(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, window, n = (c.to_pylist() for c in batch.columns)
                found = grown([(x, w.split(APART)) for x, w in zip(lang, window, strict=True)], n, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in found], pa.string()), pa.array([w for _, w, _ in found], pa.list_(pa.string())), pa.array([k for _, _, k in found], pa.int64())], names=["lang", "words", "a"]
                )

    return run


def frequent_phrases(docs: DataFrame, *, least: int = 100, longest: int = 5, bits: int = 27, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Tables words (lang, word, a, n) and phrases (lang, words, a) of all that occur at least ``least`` times.

    a: occurrences, overlaps included; n: all words of the language. Words are
    escaped as in escape(). bits: the logarithm of the bins; beyond some
    2^bits * least pairs of words in the corpus the bins leave nothing out, and
    all words are projected.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    counted = cut(rows.mapInArrow(_count(bits), "lang string, word binary, bin long, n long").groupBy("lang", "word", "bin").agg(F.sum("n").alias("n")))
    words = counted.filter("bin is null").withColumn("word", F.col("word").cast("string"))
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.filter(F.col("n") >= least).select("lang", "word", F.col("n").alias("a")).join(sums, "lang")
    kept = counted.filter((F.col("bin").isNotNull()) & (F.col("n") >= least))
    width = 1 << ROW_BITS
    bitmaps = kept.groupBy((F.shiftright("bin", ROW_BITS)).alias("row")).agg(F.bitmap_construct_agg(F.col("bin").bitwiseAND(F.lit(width - 1))).alias("bits"))
    table = bytearray(1 << (bits - 3))
    for r in bitmaps.collect():  # at most 2^(bits - ROW_BITS) rows of 4 KB
        table[r.row * width // 8 : (r.row + 1) * width // 8] = r.bits
    frequent = spark.sparkContext.broadcast(bytes(table))
    windows = rows.mapInArrow(_project(bits, longest, frequent), "lang string, window binary").groupBy("lang", F.col("window").cast("string").alias("window")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = windows.repartitionByRange("lang", "window").sortWithinPartitions("lang", "window")
    parts = sorted_.mapInArrow(_grow(least), "lang string, words array<string>, a long")
    phrases = cut(parts.groupBy("lang", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    frequent.unpersist()
    words = cut(words)
    drop_cut(counted)
    return words, phrases


def _looked_up(rows: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """rows with held's count of (lang, words); a key that many rows share is broadcast."""
    asked = rows.groupBy("lang", key).agg(F.count(F.lit(1)).alias("k"))
    found = cut(asked.join(held.select("lang", F.col("words").alias(key), F.col("a").alias(value)), ["lang", key]))
    return by_key(rows, found, ["lang", key], "k", [value])


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of longs, exact where a * n has up to 34 digits and l * r up to 38."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    product = (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (whole("l") * whole("r")).cast("decimal(38,0)"))


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, most: int = 2000, bits: int = 27, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases.

    score: the least floor(1000 * a * n / (l * r)) over the places where a
    phrase can be cut in two, l and r the counts of the parts there. Phrases
    that always lie in one longer phrase are left out.
    """
    words, phrases = frequent_phrases(docs, least=least, longest=longest, bits=bits, text=text, lang=lang)
    held = phrases.unionByName(words.select("lang", F.array("word").alias("words"), "a"))
    size = F.size("words")
    inside = phrases.filter(size > 2).select("lang", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("a").alias("longer"))
    longer = inside.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = phrases.join(longer, ["lang", "words"], "left").filter("longer is null or longer < a").drop("longer")
    cuts = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cut(cuts.select("*", F.slice("words", F.lit(1), F.col("cut")).alias("first"), F.slice("words", F.col("cut") + 1, size - F.col("cut")).alias("rest")))
    both = _looked_up(_looked_up(cuts, held, "first", "l"), held, "rest", "r").join(F.broadcast(words.groupBy("lang").agg(F.max("n").alias("n"))), "lang")
    scored = both.withColumn("score", score())
    best = scored.groupBy("lang", "words").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("v"))
    out = best.select("lang", unescape(F.array_join("words", " ")).alias("phrase"), "v.*")
    order, best = [F.desc("score"), F.desc("a"), F.col("phrase")], F.col("rank") <= most
    some = out.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(best)  # of at most SHARES * most rows a language
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
