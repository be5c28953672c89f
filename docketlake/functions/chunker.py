"""Splitting bodies into overlapping passages.

Paragraphs are packed greedily to a target length; a full passage's tail opens
the next one; a paragraph beyond the target is split at spaces. The packing
depends on all that came before, so it is a fold in Python over one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Characters of a passage and of its overlap (fixed values).
TARGET, OVERLAP = 1600, 200


def _tail(passage: str, overlap: int) -> str:
    """What a passage hands on: its last characters from a word on; nothing of a short one."""
    if len(passage) <= overlap:
        return ""
    end = passage[-overlap:]
    space = end.find(" ")
    return end[space + 1 :] if space > 0 else end


def _pieces(paragraph: str, target: int) -> Iterator[str]:
    at = 0
    while at < len(paragraph):
        stop = min(at + target, len(paragraph))
        if stop < len(paragraph):
            space = paragraph.rfind(" ", at, stop)
            if space - at > target // 2:
                stop = space
        piece = paragraph[at:stop].strip()
        if piece:
            yield piece
        at = stop


def split_text(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """The passages of a text; none for a blank one."""
    text = (text or "").strip()
    if len(text) <= target:
        return [text] if text else []
    sep = "\n\n" if "\n\n" in text else "\n"
    out: list[str] = []
    held: list[str] = []
    size = 0
    for paragraph in filter(None, (p.strip() for p in text.split(sep))):
        if len(paragraph) > target:
            if held:
                out.append(sep.join(held))
            held, size = [], 0
            out.extend(_pieces(paragraph, target))
            continue
        if held and size + len(paragraph) + 2 > target:
            out.append(sep.join(held))
            tail = _tail(out[-1], overlap)
            held, size = ([tail], len(tail)) if tail else ([], 0)
        held.append(paragraph)
        size += len(paragraph) + 2
    if held:
        out.append(sep.join(held))
    return out


def chunks(text: Column) -> Column:
    """The passages of a text column, as an array."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(split_text)

    return split(text)


@udtf(returnType="seq int, piece string")
class SplitText:
    """Table function: SELECT * FROM t, LATERAL split_text(t.body)."""

    def eval(self, text: str):
        yield from enumerate(split_text(text))
