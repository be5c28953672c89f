"""Snippets: the best window of a row's text for a query, with its hits marked.

In each column the earliest window with most distinct phrases (then most hits)
is taken; the best column wins, the earlier on a tie. Runs of hits are wrapped,
and an ellipsis shows where text was cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from .match import Phrase, phrases_of

#: Marks and the window's tokens (fixed values).
OPEN, CLOSE, ELLIPSIS, WINDOW = "[[", "]]", "...", 12


def _window(hits: Sequence[tuple[int, int, int]], n: int, size: int) -> tuple[tuple[int, int], int]:
    """The first of the windows over n words with most distinct phrases, then most hits: that rank, and its start."""
    hits = [h for h in hits if h[1] - h[0] <= size]
    coming, going = sorted(hits, key=lambda h: h[1]), sorted(hits)
    best, held, k, came, went = ((-1, -1), 0), Counter(), 0, 0, 0
    for start in range(max(1, n - size + 1)):
        while came < len(coming) and coming[came][1] <= start + size:
            held[coming[came][2]] += 1
            came, k = came + 1, k + 1
        while went < len(going) and going[went][0] < start:
            held[going[went][2]] -= 1
            if not held[going[went][2]]:
                del held[going[went][2]]
            went, k = went + 1, k - 1
        if (len(held), k) > best[0]:
            best = ((len(held), k), start)
    return best


def best_window(columns: Sequence[str | None], names: Sequence[str], phrases: Sequence[Phrase], size: int = WINDOW) -> str:
    import regex

    best = None
    for text, column in zip(columns, names, strict=True):
        if not text:
            continue
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", text)]
        words = [(tokens_of(text[a:b]) or [""])[0] for a, b in spans]
        hits = []
        for p, phrase in enumerate(phrases):
            n = len(phrase.tokens)
            if phrase.column not in (None, column):
                continue
            for i in range(len(words) - n + 1):
                if all(words[i + k] == t or (phrase.prefix and k == n - 1 and words[i + k].startswith(t)) for k, t in enumerate(phrase.tokens)):
                    hits.append((i, i + n, p))
        if words:
            rank, start = _window(hits, len(words), size)
            if best is None or rank > best[0]:
                best = (rank, text, spans, hits, start)
    if best is None:
        return ""
    _, text, spans, hits, start = best
    inside = [h for h in hits if h[0] >= start and h[1] <= start + size]
    stop = min(start + size, len(spans))
    marked = {k for a, b, _ in inside for k in range(a, b)}
    out, at = [ELLIPSIS] if start else [], spans[start][0] if start else 0
    for k in range(start, stop):
        a, b = spans[k]
        out += [text[at:a], OPEN * (k in marked and k - 1 not in marked), text[a:b], CLOSE * (k in marked and k + 1 not in marked)]
        at = b
    return "".join(out) + (ELLIPSIS if stop < len(spans) else text[at:])


def snippet(columns: Sequence[str], tree, size: int = WINDOW) -> Column:
    """Column of the snippet over text columns, for a compiled query."""
    phrases = phrases_of(tree)

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([best_window(r, list(columns), phrases, size) for r in rows.itertuples(index=False, name=None)], dtype=object)

    return run(F.struct(*[F.col(c) for c in columns]))
