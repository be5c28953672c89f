"""Tables on Parquet: layout, metadata, appends by anti-join, slices overwritten.

A store is a folder with one table a subfolder. A table is the list of parts
named by its record with the highest number; a change writes a new part and
then a new record, so readers never see half of a change, and an interrupted
one leaves the table as it was. Records are created, never overwritten, so of
two writers at once the second fails. The parts of the record before stay for
readers that have already planned on them; what only older records name is
deleted.

A table may be kept in slices, by a column of short plain values: a part then
holds one slice. Slices are read and exchanged on their own, and the files of
the others stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.once import let
from .shared import file_system

#: Parts of a table, or of a slice, beyond which an append puts them together.
MOST_PARTS = 64
#: What the last folder of a slice's part is called.
SLICE = "_slice="
#: Bytes of input files a range of rows that are sorted, so that a range is sorted in memory whatever the table's size.
RANGE_BYTES = 8 << 20


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows sorted in ranges: as many as the session's shuffle partitions, or more if the files that the rows are made of are large."""
    spark = rows.sparkSession
    n = sum(fs.getFileStatus(p).getLen() for p, fs in (file_system(spark, f) for f in rows.inputFiles())) // RANGE_BYTES
    columns = [F.col(c) for c in order]
    many = n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(n, *columns) if many else rows.repartitionByRange(*columns)).sortWithinPartitions(*order)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _records(self, table: str) -> list[int]:
        """Numbers of a table's records, the latest first."""
        p, fs = file_system(self.spark, f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted((int(n.removeprefix("_current-")) for n in names if n.startswith("_current-")), reverse=True)

    def _record(self, table: str, number: int) -> dict | None:
        """What a record says; None while it is being written."""
        p, fs = file_system(self.spark, f"{self.path}/{table}/_current-{number}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _current(self, table: str) -> tuple[int, dict] | None:
        whole = ((n, self._record(table, n)) for n in self._records(table))
        return next(((n, r) for n, r in whole if r is not None), None)

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def read(self, table: str, slices: Iterable | None = None) -> DataFrame:
        """A table, or only some of its slices."""
        found = self._current(table)
        if found is None:
            raise LookupError(f"no table {table} in {self.path}")
        record, wanted = found[1], None if slices is None else {str(x) for x in slices}
        schema = StructType.fromJson(record["schema"])
        parts = [p for p in record["parts"] if wanted is None or _slice_of(p) in wanted]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{table}/{p}" for p in parts])

    def slices(self, table: str) -> set[str]:
        """The slices that a table has rows in; no files are read."""
        found = self._current(table)
        return set() if found is None else {x for p in found[1]["parts"] if (x := _slice_of(p)) is not None}

    def _write(self, table: str, rows: DataFrame, sort: list[str] | None, by: str | None = None, only: object = None, options: dict | None = None) -> list[str]:
        """Write rows; the parts made: one, or one a slice. only: the one slice that all rows lie in; they are written as they come."""
        part = f"v-{uuid.uuid4().hex}"
        path = f"{self.path}/{table}/{part}"
        if only is not None:
            part, path = f"{part}/{SLICE}{only}", f"{path}/{SLICE}{only}"
            rows.write.options(**options or {}).option("compression", "zstd").parquet(path)
            if self.spark.read.schema(rows.schema).parquet(path).isEmpty():
                self._delete(f"{table}/{part}")
                return []
            return [part]
        if by is None:
            out = rows if sort is None else ranged(rows, *sort)
            out.write.option("compression", "zstd").parquet(path)
            return [part]
        order = [by, *(sort or [])]
        name = SLICE.rstrip("=")
        out = ranged(rows, *order)  # by the sort columns too, so that a slice of any size is many files
        out.withColumn(name, F.col(by).cast("string")).write.partitionBy(name).option("compression", "zstd").parquet(path)
        p, fs = file_system(self.spark, path)
        found = [x.getPath().getName() for x in fs.listStatus(p)]
        return [f"{part}/{x}" for x in sorted(found) if x.startswith(SLICE)]

    def _commit(self, table: str, last: int, parts: list[str], schema: StructType) -> None:
        p, fs = file_system(self.spark, f"{self.path}/{table}/_current-{last + 1}")
        stream = fs.create(p, False)  # fails if another writer was first
        stream.write(bytearray(json.dumps({"parts": parts, "schema": schema.jsonValue()}).encode()))
        stream.close()
        before = self._record(table, last) if last else None
        kept = {*parts, *(before["parts"] if before else ())}
        for n in self._records(table):
            if n < last:
                for old in (self._record(table, n) or {"parts": []})["parts"]:
                    if old not in kept:
                        self._delete(f"{table}/{old}")  # a folder whose slices have all gone stays, empty
                self._delete(f"{table}/_current-{n}")

    def _delete(self, path: str) -> None:
        p, fs = file_system(self.spark, f"{self.path}/{path}")
        fs.delete(p, True)

    def replace(self, table: str, rows: DataFrame, sort: list[str] | None = None, by: str | None = None, only: object = None, options: dict | None = None) -> None:
        """Write rows as all of the table; sort: columns whose row-group bounds look-ups use; by: the column of slices; only: the one slice of all rows."""
        parts = self._write(table, rows, sort, by, only, options)
        self._commit(table, max(self._records(table), default=0), parts, rows.schema)

    def append(self, table: str, rows: DataFrame, sort: list[str] | None = None, by: str | None = None, only: object = None, options: dict | None = None) -> bool:
        """Add rows as parts of their own; whether there were any. Columns that one side lacks are null there."""
        found = self._current(table)
        if found is None:
            self.replace(table, rows, sort, by, only, options)
            return True
        number, record = found
        held = self.spark.createDataFrame([], StructType.fromJson(record["schema"]))
        rows = held.unionByName(rows, allowMissingColumns=True)
        made = self._write(table, rows, sort, by, only, options)
        if by is None and only is None and self.spark.read.schema(rows.schema).parquet(f"{self.path}/{table}/{made[0]}").isEmpty():
            self._delete(f"{table}/{made[0]}")
            return False
        if not made:
            return False
        parts = [*record["parts"], *made]
        self._commit(table, number, parts, rows.schema)
        if by is None and only is None and len(parts) > MOST_PARTS:
            self.replace(table, self.read(table), sort)
        crowded = [x for x, n in Counter(map(_slice_of, parts)).items() if x is not None and n > MOST_PARTS]
        if crowded and by is not None:
            self.replace_slices(table, self.read(table, crowded), by, sort)
        return True

    def replace_slices(self, table: str, rows: DataFrame, by: str, sort: list[str] | None = None, gone: Iterable = ()) -> None:
        """Exchange the slices that rows lie in, and drop those in gone; the files of the others aren't touched."""
        number, record = self._current(table)
        made = self._write(table, rows, sort, by)
        touched = {_slice_of(p) for p in made} | {str(x) for x in gone}
        self._commit(table, number, [*[p for p in record["parts"] if _slice_of(p) not in touched], *made], StructType.fromJson(record["schema"]))

    def append_new(self, table: str, rows: DataFrame, keys: list[str]) -> bool:
        """Add the rows whose keys the table doesn't hold yet; what is there is read for its keys only."""
        return self.append(table, new_keys(rows, self.read(table), keys) if self.exists(table) else rows)

    def drop_slices(self, table: str, gone: Iterable) -> None:
        """Drop slices; nothing is written but the record."""
        number, record = self._current(table)
        dropped = {str(x) for x in gone}
        self._commit(table, number, [p for p in record["parts"] if _slice_of(p) not in dropped], StructType.fromJson(record["schema"]))

    def set_meta(self, **values: str) -> None:
        new = self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string").coalesce(1)
        self.replace("meta", upserted(self.read("meta"), new, "key").coalesce(1) if self.exists("meta") else new)

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").collect()} if self.exists("meta") else {}

    def is_indexed(self) -> bool:
        """Whether the store can be searched; an unreadable one can't."""
        try:
            return bool(self.meta().get("indexed_at"))
        except Exception:
            return False


def _slice_of(part: str) -> str | None:
    """The slice that a part holds; None of a table without."""
    return part.rpartition(SLICE)[2] if SLICE in part else None


def upserted(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """held with the rows of new, which win by key."""
    both = held.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    fields = [c for c in held.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*fields), "_age").alias("v")).select(key, "v.*")


def replaced_slice(held: DataFrame, slice_: Column, rows: DataFrame) -> DataFrame:
    return held.filter(~F.coalesce(slice_, F.lit(False))).unionByName(rows, allowMissingColumns=True)


def new_keys(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(held.select(*keys).distinct(), keys, "left_anti")


def repaired(bag: DataFrame, norm: Column, column: str = "provision", raw: str = "raw") -> DataFrame:
    """Normalise again the rows that were stored raw."""
    stored_raw = F.col(column) == F.col(raw)
    again = let(norm, lambda n: F.when((n != F.col(raw)) & (n != ""), n).otherwise(F.col(column)))
    return bag.withColumn(column, F.when(stored_raw, again).otherwise(F.col(column)))
