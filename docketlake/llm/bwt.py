"""Repeated strings of a minimum length from a Burrows-Wheeler transform.

Threshold-bounded interval expansion: starting from the interval of the empty
string, intervals are extended backwards by one symbol at a time, breadth first.
Strings of length l give exactly the places in suffix order where the common
prefix of two neighbours is l, so lengths come in increasing order, and the
search stops at the minimum length: neighbours not separated by then share a
prefix of at least that length.
"""

from __future__ import annotations

import numpy as np


#: Symbols packed in the first sort key: seven of nine bits.
PACKED = 7


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first depth symbols at least (those beyond the end are the smallest), and each suffix' place.

    Doubling; only suffixes whose place isn't settled yet are sorted again.
    """
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    for k in range(min(n, PACKED)):
        key[: n - k] |= symbols[k:] << (9 * (PACKED - 1 - k))
    order = np.argsort(key)
    ordered = key[order]
    heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = PACKED
    while h < depth:
        alone = heads & np.concatenate((heads[1:], [True]))
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        open_ = order[places]
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + h, n)] + 1
        sort = np.argsort(key)
        open_, key = open_[sort], key[sort]
        order[places] = open_
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads[places] = new
        rank[open_] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, place


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as symbols, each closed by a separator (the smallest symbol); their begins and the separators' places."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    symbols = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.int64) + 1
    closes = begins + sizes
    symbols[closes] = 0
    return symbols, begins, closes


def repeated_starts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of every string of the given length, inside one text, that also starts at another place."""
    nothing = np.zeros(0, dtype=np.int64)
    if not texts:
        return nothing, nothing
    symbols, begins, closes = joined(texts)
    n = len(symbols)
    order, place = suffix_order(symbols, length)
    transform = symbols[order - 1].astype(np.uint16)
    step = place[order - 1]
    split = np.zeros(n + 1, dtype=bool)
    split[0] = split[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        sizes = hi - lo
        stops = np.cumsum(sizes)
        at = np.repeat(lo - (stops - sizes), sizes) + np.arange(stops[-1])
        to = np.sort(step[at])
        # extensions of one interval by one symbol lie side by side; a new one begins where the interval or the symbol changes
        by = transform[at]
        sort = np.argsort(by, kind="stable")
        of, by = np.repeat(np.arange(len(lo)), sizes)[sort], by[sort]
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (by[1:] != by[:-1]))))
        lo, hi = to[new], np.concatenate((to[new[1:] - 1], to[-1:])) + 1
        fresh = ~split[hi]
        lo, hi = lo[fresh], hi[fresh]
        split[hi] = True
    near = np.flatnonzero(~split)
    starts = np.unique(np.concatenate((order[near], order[near - 1])))
    text = np.searchsorted(begins, starts, side="right") - 1
    inside = starts + length <= closes[text]
    return text[inside], (starts - begins[text])[inside]
