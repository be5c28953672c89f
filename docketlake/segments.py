"""A text index in segments: what changes is written, what was there stays.

A segment is a slice of name_postings and name_row_stats. A change adds a
segment with the rows that are new or changed, and the ids that are gone from
the segments before it as a slice of name_deletes; it counts once it is listed
in name_segments, by one commit, so readers see all of a change or nothing.
Segments of like sizes are merged, without the rows that are gone. The list also holds by how many
rows and tokens each change made the index larger or smaller, so that what
ranking needs of the whole is their sum and no rows are read for it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.postings import PAGES, postings, row_stats, shape
from .store import Store, ranged

#: Segments of one size class that are merged; classes are powers of it.
FACTOR = 4
#: Ids that are gone beyond which they are merged with the postings by sorting, never sent whole to all.
MANY_GONE = 200_000


def _names(name: str) -> tuple[str, str, str, str]:
    return f"{name}_postings", f"{name}_row_stats", f"{name}_deletes", f"{name}_segments"


def exists(store: Store, name: str) -> bool:
    return store.exists(f"{name}_segments")


def segments(store: Store, name: str) -> dict[int, int]:
    """Rows written by each segment; a change without rows has none."""
    return {seg: n for seg, (n, _, _) in _figures(store, name).items()}


def _figures(store: Store, name: str) -> dict[int, tuple[int, int, int]]:
    """By segment: rows written, and the rows and tokens that the index gained by it. A few rows, since segments are merged."""
    return {r.seg: (r.n, r.rows, r.tokens) for r in store.read(f"{name}_segments").collect()} if exists(store, name) else {}


def searched(store: Store, name: str) -> tuple[DataFrame, DataFrame]:
    """Postings of all segments without the rows that are gone, and their shape (rows, tokens): what bm25() asks for."""
    whole = store.read(f"{name}_segments").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return live(store, name)[0], whole


def _commit(store: Store, name: str, found: dict[int, tuple[int, int, int]]) -> None:
    listed = [(seg, *figures) for seg, figures in sorted(found.items())]
    store.replace(f"{name}_segments", store.spark.createDataFrame(listed, "seg long, n long, rows long, tokens long").coalesce(1))


def _drop(store: Store, table: str, gone: list) -> None:
    there = store.slices(table) & {str(x) for x in gone}
    if there:
        store.drop_slices(table, there)


def _add(store: Store, name: str, seg: int, index: DataFrame, stats: DataFrame) -> tuple[int, int]:
    """Write a segment that isn't listed yet; its rows and tokens."""
    for table in _names(name)[:3]:
        _drop(store, table, [seg])  # left by a change that was interrupted
    for table, made, options in ((_names(name)[0], index, PAGES), (_names(name)[1], stats, None)):
        store.append(table, made.withColumn("seg", F.lit(seg).cast("long")), only=seg, options=options)
    return tuple(shape(store.read(_names(name)[1], [seg])).first())


def build(store: Store, name: str, rows: DataFrame, columns: Sequence[str]) -> None:
    """Index rows (id and columns) anew, as one segment."""
    seg = max((r.seg for r in store.read(f"{name}_segments").select("seg").collect()), default=0) + 1 if exists(store, name) else 1
    n, tokens = _add(store, name, seg, postings(rows, "id", columns), row_stats(rows, "id", columns))
    _commit(store, name, {seg: (n, n, tokens)})
    for table in _names(name)[:3]:
        _drop(store, table, [x for x in store.slices(table) if int(x) != seg])


def change(store: Store, name: str, rows: DataFrame, columns: Sequence[str], gone: DataFrame | None = None) -> None:
    """Index rows that are new or changed; gone: row_id of those changed or removed."""
    before = _figures(store, name)
    seg = max(before, default=0) + 1
    n, tokens = _add(store, name, seg, postings(rows, "id", columns), row_stats(rows, "id", columns))
    less = (0, 0)
    if gone is not None:
        store.append(f"{name}_deletes", gone.select("row_id", F.lit(seg).cast("long").alias("seg")), ["row_id"], "seg")
        left = store.read(f"{name}_deletes", [seg]).select("row_id")
        less = shape(live(store, name)[1].join(left.hint("merge"), "row_id", "left_semi")).first()
    _commit(store, name, before | {seg: (n, n - less[0], tokens - less[1])})
    merge(store, name)


def live(store: Store, name: str, only: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and row statistics of all segments, or only of some, without the rows that are gone."""
    figures = _figures(store, name)
    listed = {seg: n for seg, (n, _, _) in figures.items()}
    many = sum(n - rows for n, rows, _ in figures.values()) > MANY_GONE
    wanted = [s for s in listed if only is None or s in only]
    deletes = f"{name}_deletes"
    later = [x for x in (store.slices(deletes) if store.exists(deletes) else ()) if min(wanted, default=0) < int(x) <= max(listed, default=0)]

    def without(table: str) -> DataFrame:
        rows = store.read(table, wanted)
        if not later:
            return rows
        gone = store.read(deletes, later).select(F.col("row_id").alias("gone_id"), F.col("seg").alias("gone_by"))
        if many:
            gone = gone.hint("merge")
        return rows.join(gone, (F.col("row_id") == F.col("gone_id")) & (F.col("seg") < F.col("gone_by")), "left_anti")

    return without(f"{name}_postings"), without(f"{name}_row_stats")


def merge(store: Store, name: str) -> None:
    """Merge the segments of each size class that has FACTOR of them or more, until none has."""
    while True:
        listed = segments(store, name)
        classes: dict[int, list[int]] = {}
        for seg, n in listed.items():
            classes.setdefault(int(math.log(max(n, 1), FACTOR)), []).append(seg)
        full = [x for c in classes.values() if len(c) >= FACTOR for x in c]
        if not full:
            return
        seg = max(listed) + 1
        index, stats = live(store, name, full)
        n, _ = _add(store, name, seg, ranged(index, "term", "row_id"), stats)
        gains = [figures for s, figures in _figures(store, name).items() if s in full]
        left = {s: x for s, x in _figures(store, name).items() if s not in full} | {seg: (n, sum(x[1] for x in gains), sum(x[2] for x in gains))}
        _commit(store, name, left)
        for table in _names(name)[:2]:
            _drop(store, table, full)
        _drop(store, f"{name}_deletes", [x for x in store.slices(f"{name}_deletes") if int(x) <= min(left)])
