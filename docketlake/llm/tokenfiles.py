"""Token counts by a separator scan of flat token files.

A flat file is a stream of fixed-width token ids without any index; documents
end at an end-of-document id. Files are read as blocks of a fixed number of
bytes. Each block is searched for the separator at once, as an array; what it
found is one row: how many documents end in it, and how many tokens follow the
last end. A prefix scan over the blocks of a file, in order, stitches documents
that begin in one block and end in another, however many lie between.

Scale: blocks are independent; the scan is over one small row a block and runs
per file in two levels (stretches of blocks, then blocks), so one huge file is
not one task.

Defined results: an empty file has no documents; tokens after the last
separator are a document that isn't closed; two separators in a row close an
empty document; bytes that don't fill a last token are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import file_system
from .common import cut

BLOCK_BYTES = 1 << 18
#: Blocks whose scan is one task's.
STRETCH = 4096


#: File systems that Python workers open themselves, by scheme, and the name that Arrow has for them.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Blocks that one task reads at a time.
RANGE = 256


def _opened(file: str):
    """A file, open for reading from any place."""
    scheme, _, rest = file.partition(":")
    if scheme == "file":
        return open(url2pathname("/" + rest.lstrip("/")), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{OPENED[scheme]}:{rest}")
    return store.open_input_file(path)


def blocks_of_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, payload) of the flat files at or in a path.

    Spark lists the files; ranges of blocks are read by the workers, so a file
    of any size is dealt to many tasks. Files in stores that only Spark opens
    are read by its reader of whole files, which ends at 2 GiB a file.
    """
    p, store = file_system(spark, path)
    found = [f for f in store.globStatus(p) or () if f.isFile()] or [f for d in store.globStatus(p) or () for f in store.listStatus(d.getPath()) if f.isFile()]
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.getLen() and not f.getPath().getName().startswith((".", "_"))]
    if not all(f.partition(":")[0] in OPENED for f, _ in files):
        whole = spark.read.format("binaryFile").load(path).filter("length > 0")
        rows = whole.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
        return rows.select("file", "block", F.substr("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("payload"))
    n_ranges = sum(1 + (size - 1) // (block_bytes * RANGE) for _, size in files)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes), F.lit(RANGE).cast("long"))
    ranges = spark.createDataFrame(files, "file string, size long").select("file", "size", F.explode(starts).alias("first")).repartition(max(1, min(n_ranges, 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, begin in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with _opened(file) as f:
                    f.seek(begin * block_bytes)
                    for block in range(begin, min(begin + RANGE, 1 + (size - 1) // block_bytes)):
                        payload = f.read(min(block_bytes, size - block * block_bytes))
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])

    return ranges.mapInArrow(run, "file string, block long, payload binary")


def pack(tokens: DataFrame, file: str, ids: str, doc_id: str, *, width: int, end: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lay documents end to end, each closed by the separator: rows (file, block, payload, doc_ids).

    Every input partition is one flat file, named by file and the partition's
    number. ids: little-endian unsigned 32-bit ids; width: bytes of an id in
    the file (2 or 4). doc_ids: the ids of the documents closed in the block,
    kept beside the file as its manifest.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    rows = tokens.select(F.spark_partition_id().alias("part"), F.col(ids).alias("ids"), F.col(doc_id).cast("long").alias("doc_id"))
    close = np.array([end], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, closed, block, part = bytearray(), [], 0, 0
        make = lambda payload, docs: pa.RecordBatch.from_arrays([pa.array([f"{file}-{part:05d}"]), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([docs], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])
        for batch in batches:
            for part, coded, doc in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                values = np.frombuffer(coded or b"", dtype="<u4")
                if width == 2 and len(values) and int(values.max()) > 65535:
                    raise ValueError("an id doesn't fit in two bytes")
                if (values == end).any():
                    raise ValueError("a document holds the separator's id")
                held += values.astype(kind).tobytes() + close
                # the separator's last byte decides in which block a document is closed
                while len(held) > block_bytes:
                    yield make(bytes(held[:block_bytes]), closed)
                    del held[:block_bytes]
                    block, closed = block + 1, []
                closed.append(doc)
                if len(held) == block_bytes:
                    yield make(bytes(held), closed)
                    held, block, closed = bytearray(), block + 1, []
        if held:
            yield make(bytes(held), closed)

    return rows.mapInArrow(run, "file string, block long, payload binary, doc_ids array<long>")


def scan_blocks(blocks: DataFrame, *, width: int, end: int) -> DataFrame:
    """One row a block: file, block, n_tokens, n_ends, before (tokens up to the first end), inner (token counts between ends), after."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for payload in batch.column(2).to_pylist():
                if len(payload) % width:
                    raise ValueError("a block doesn't hold whole tokens")
                ids = np.frombuffer(payload, dtype=kind)
                ends = np.flatnonzero(ids == end)
                row = (len(ids), len(ends), int(ends[0]) if len(ends) else len(ids), (np.diff(ends) - 1).tolist(), len(ids) - int(ends[-1]) - 1 if len(ends) else 0)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.int64())],
                names=["file", "block", "n_tokens", "n_ends", "before", "inner", "after"],
            )

    return blocks.select("file", F.col("block").cast("long").alias("block"), "payload").mapInArrow(run, "file string, block long, n_tokens long, n_ends long, before long, inner array<long>, after long")


def token_counts(blocks: DataFrame, *, width: int, end: int) -> DataFrame:
    """file, ordinal (from 0), n_tokens, closed, closing_block of every document of flat files given as blocks."""
    found = cut(scan_blocks(blocks, width=width, end=end)).withColumn("stretch", F.floor(F.col("block") / STRETCH))
    # tokens carried out of a block: after its last end, or all of them on top of what came in
    step = F.struct(F.col("n_ends").alias("n"), F.when(F.col("n_ends") > 0, F.col("after")).otherwise(F.col("n_tokens")).alias("tail"))
    found = found.withColumn("step", step)
    inside = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = _scanned(found, inside, F.col("n_ends"), F.col("step.tail"))
    whole = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = _sums(found, whole).groupBy("file", "stretch").agg(F.max("all_ends").alias("all_ends"), F.max("all_tail").alias("all_tail"))
    above = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = _scanned(sums, above, F.col("all_ends"), F.col("all_tail")).select(F.col("file").alias("f"), F.col("stretch").alias("s"), F.col("ends_before").alias("ends_above"), F.col("carried").alias("carried_above"))
    rows = found.join(sums, (F.col("file") == F.col("f")) & (F.col("stretch") == F.col("s")))
    rows = rows.withColumn("carried", F.col("carried") + F.when(F.col("ends_before") == 0, F.col("carried_above")).otherwise(0)).withColumn("ends_before", F.col("ends_before") + F.col("ends_above"))
    counts = F.concat(F.array(F.col("carried") + F.col("before")), F.col("inner"))
    closed = rows.filter("n_ends > 0").select("file", "ends_before", "block", F.posexplode(counts).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("ends_before") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"), F.col("block").alias("closing_block"), F.col("i").cast("long").alias("place"))
    last = Window.partitionBy("file", "stretch").orderBy("block")
    ends = rows.withColumn("next", F.lead("block").over(last)).filter("next is null")
    top = ends.groupBy("file").agg(F.max(F.struct("block", "ends_before", "n_ends", "carried", "n_tokens", "after")).alias("t"))
    tail = F.when(F.col("t.n_ends") > 0, F.col("t.after")).otherwise(F.col("t.carried") + F.col("t.n_tokens"))
    rest = top.select("file", (F.col("t.ends_before") + F.col("t.n_ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("closed"), F.col("t.block").alias("closing_block"), F.lit(-1).cast("long").alias("place"))
    return closed.unionByName(rest.filter("n_tokens > 0"))


def _scanned(rows: DataFrame, window, ends, tail) -> DataFrame:
    """ends_before, and the tokens carried in: those since the last end before the row."""
    before = F.coalesce(F.sum(ends).over(window), F.lit(0))
    rows = rows.withColumn("ends_before", before)
    total = F.coalesce(F.sum(tail).over(window), F.lit(0))
    # tails of rows up to the last one with an end don't count, but that one's own does
    gone = F.max(F.when(ends > 0, F.struct(F.col(_order(rows)).alias("at"), F.col("_upto").alias("upto"))))
    rows = rows.withColumn("_upto", total)
    return rows.withColumn("carried", total - F.coalesce(gone.over(window)["upto"], F.lit(0))).drop("_upto")


def _order(rows: DataFrame) -> str:
    return "block" if "block" in rows.columns else "stretch"


def _sums(rows: DataFrame, window) -> DataFrame:
    """all_ends and all_tail of a stretch as if it were one block."""
    last = F.max(F.when(F.col("n_ends") > 0, F.struct("block", F.col("_upto").alias("upto")))).over(window)["upto"]
    upto = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_upto", F.coalesce(F.sum("step.tail").over(upto), F.lit(0)))
    return rows.withColumn("all_ends", F.sum("n_ends").over(window)).withColumn("all_tail", F.sum("step.tail").over(window) - F.coalesce(last, F.lit(0)))
