"""Inverted index: positional postings and what ranking needs of the whole.

postings(row_id, n_tokens, col, term, tf, positions), where n_tokens are those of
the whole row, so that a row is scored from its postings alone;
shape(rows, tokens), one row; row_stats(row_id, n_tokens, digest), by which rows
are told apart when they change; bounds, see bounded.py. Postings are written
where their rows are read, in runs of up to TOKENS_AT_ONCE tokens, each sorted by
term: nothing is shuffled or sorted beyond a run, whatever the size. A term or a
prefix is read by the statistics of the files' small pages, a few in each run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_in

#: Tokens of rows that are put together at once; a longer row is taken alone.
TOKENS_AT_ONCE = 1_000_000
#: How postings are written: pages of few rows, since a term is in a small part of each run.
PAGES = {"parquet.page.row.count.limit": "5000"}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (row_id, col, n_tokens, words): a row's places of a term put together within the row, in runs sorted by term."""
    held, n = [], 0
    for b in batches:
        begins = b.column("words").offsets.to_numpy()
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + TOKENS_AT_ONCE, "right")) - 1)
            size = int(begins[end] - begins[at])
            if held and n + size > TOKENS_AT_ONCE:
                yield from _gathered_rows(_together(held))
                held, n = [], 0
            held.append(b.slice(at, end - at))
            at, n = end, n + size
    if held:
        yield from _gathered_rows(_together(held))


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _gathered_rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = b.column("words")
    coded, sizes = words.flatten().dictionary_encode(), words.value_lengths().to_numpy(zero_copy_only=False)
    n = len(coded)
    if n == 0:
        return
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pos = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    key = rank[codes] * len(sizes) + row  # by term, then in the order of rows
    order = np.argsort(key, kind="stable")  # places stay in their order
    heads = np.flatnonzero(np.diff(key[order], prepend=-1))
    first, ends = order[heads], np.append(heads, n).astype(np.int32)
    at = pa.array(row[first])
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32)))
    held = [b.column("row_id").take(at), b.column("col").take(at), coded.dictionary.take(pa.array(codes[first])), b.column("n_tokens").take(at), pa.array(np.diff(ends)), positions]
    yield pa.RecordBatch.from_arrays(held, ["row_id", "col", "term", "n_tokens", "tf", "positions"])


def _by_column(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id and the words of each column) as what _gathered() takes: a batch of each column, whose words aren't copied."""
    for b in batches:
        lists = b.columns[1:]
        total = pa.array(sum(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists))
        for c, words in zip(columns, lists, strict=True):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.repeat(c, b.num_rows), total, words], ["row_id", "col", "n_tokens", "words"])


def postings(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """The postings of rows. A row's places of a term are put together in the row's own task, so nothing is shuffled and no groups are sorted for it.

    The words of all columns go to the task as they are: exploding them would copy every list of words twice more.
    """
    words = rows.select(F.col(row_id).alias("row_id"), *[tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    kind, columns = words.schema["row_id"].dataType.simpleString(), list(columns)
    return words.mapInArrow(lambda batches: _gathered(_by_column(batches, columns)), f"row_id {kind}, col string, term string, n_tokens long, tf int, positions array<int>")


def digest(columns: Sequence[str]) -> Column:
    """Tells apart the contents of a row's columns."""
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in columns])


def row_stats(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Tokens of each row over all columns, and its digest: no shuffle, tokens are counted in place."""
    total = sum((tokens_in(F.col(c)) for c in columns), F.lit(0))
    return rows.select(F.col(row_id).alias("row_id"), total.cast("long").alias("n_tokens"), digest(columns).alias("digest"))


def shape(stats: DataFrame) -> DataFrame:
    """rows and tokens of all row statistics: what ranking needs of the whole, one row."""
    return stats.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))


def write_index(rows: DataFrame, row_id: str, columns: Sequence[str], path: str, block: int | None = None) -> None:
    """Write the index of rows: postings in sorted runs, and their shape; block: also bounds of runs of as many ids."""
    postings(rows, row_id, columns).write.mode("overwrite").options(**PAGES).parquet(f"{path}/postings")
    shape(row_stats(rows, row_id, columns)).write.mode("overwrite").parquet(f"{path}/shape")
    if block is not None:
        held = bounds(rows.sparkSession.read.parquet(f"{path}/postings"), block)
        held.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/bounds")


def bounds(index: DataFrame, block: int) -> DataFrame:
    """term, col, block, rows, most, dense: of a term's postings in a run of ``block`` ids, how many rows have it, its greatest frequency, and its greatest share of a row's tokens.

    col is '' for all columns together, where rows counts each row once; by
    these, how many rows hold a term is a sum over its runs.
    """
    run = F.floor(F.col("row_id") / block).cast("long").alias("block")
    held = index.filter("row_id is not null")
    own = held.groupBy("term", "col", run).agg(F.count(F.lit(1)).alias("rows"), F.max("tf").cast("long").alias("most"), F.max(F.col("tf") / F.col("n_tokens")).alias("dense"))
    once = held.groupBy("term", "row_id").agg(F.sum("tf").alias("tf"), F.max("n_tokens").alias("n_tokens"))
    whole = once.groupBy("term", F.lit("").alias("col"), run).agg(F.count(F.lit(1)).alias("rows"), F.max("tf").alias("most"), F.max(F.col("tf") / F.col("n_tokens")).alias("dense"))
    return own.unionByName(whole)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/shape")
