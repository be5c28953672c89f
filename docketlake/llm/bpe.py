"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch are laid end to end as symbol arrays with
links to the next and previous symbol. An index maps every mergeable pair, by
its rank, to all its positions in the batch. Active ranks are taken in
ascending order from a heap; each is applied at all its positions at once, and
only the lists of the pairs next to a changed position are updated. Ids equal
those of the ``tokenizers`` library for the same file.

Scale: rows are independent, so the operator is one Arrow-batched pass without
a shuffle; memory is the distinct pre-tokens of a few thousand rows.

Defined results: null is encoded as an empty text (no ids); very long texts are
encoded whole; repeated rows give equal ids; decoding null gives an empty text.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import name, with_column

#: The pre-token pattern of byte-level vocabularies (fixed value; white space as the Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class _Numbering(dict):
    """Numbers its keys from 0 in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class PairIndexBPE:
    """A vocabulary file of the byte-level BPE kind, with encoder and decoder."""

    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = self.left * self.width + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and where each one's end."""
        raw = [b"?" if t in self.special else t.encode() for t in tokens]
        marked = [(i, self.special[t]) for i, t in enumerate(tokens) if t in self.special]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        symbols = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(symbols)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            ranks = self._ranks(symbols[at], symbols[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for r, part in zip(ranks[starts].tolist(), np.split(at, starts[1:]), strict=True):
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heapq.heappush(heap, r)

        index(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = where.pop(rank)
            a, b = self.left[rank], self.right[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:
                at = np.sort(at)
                head = np.concatenate(([True], after[at[:-1]] != at[1:]))
                run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbols[at] = self.merged[rank]
            symbols[gone] = -1
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[has]))
            if len(touched):
                index(np.unique(touched))
        for i, mark in marked:
            symbols[ends[i] - 1] = mark
        alive = symbols >= 0
        return symbols[alive].astype("<u4"), np.cumsum(alive)[ends - 1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian uint32."""
        number = _Numbering()
        rows = []
        for text in texts:
            if not text:
                pieces = []
            elif self.marks is not None and self.marks.search(text):
                pieces = [p for i, part in enumerate(self.marks.split(text)) for p in ([part] if i % 2 else self.pieces(part))]
            else:
                pieces = self.pieces(text)
            rows.append(np.array(list(map(number.__getitem__, pieces)), dtype=np.int32))
        if not number:
            return [b""] * len(texts)
        flat, ends = self.merge(list(number))
        begins = np.concatenate(([0], ends[:-1]))
        lengths = ends - begins
        out = []
        for row in rows:
            sizes = lengths[row]
            stops = np.cumsum(sizes)
            at = np.repeat(begins[row] - (stops - sizes), sizes) + np.arange(stops[-1] if len(row) else 0)
            out.append(flat[at].tobytes())
        return out

    def decode(self, ids: bytes | None) -> str:
        table = self.bytes_of
        return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist())).decode("utf-8", errors="replace")


_loaded: dict[str, PairIndexBPE] = {}


def load(path: str) -> PairIndexBPE:
    """The vocabulary, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


#: Texts encoded and handed on at a time, so that a worker's memory doesn't follow the batch.
ROWS_AT_ONCE = 3000


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with the ids of each whole text as binary of little-endian unsigned 32-bit integers.

    decoded: name of a further column with the text decoded from those ids.
    Columns of the same names are replaced; keep: only these others are returned.
    """
    fields = [T.StructField(ids, T.BinaryType())]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.StringType()))

    def make(texts: list) -> list:
        coded = load(path).encode(texts)
        return [coded, [load(path).decode(x) for x in coded]] if decoded is not None else [coded]

    return with_column(docs, name(text), make, fields, ROWS_AT_ONCE, keep)


def decode_ids(rows: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of ids as encode_documents gives them."""
    return with_column(rows, name(ids), lambda coded: [[load(path).decode(x) for x in coded]], [T.StructField(text, T.StringType())], ROWS_AT_ONCE)
