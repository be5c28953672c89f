"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import cut, dealt, drop_cut, ship

__all__ = ["SPACES", "cut", "dealt", "documents", "drop_cut", "name", "packed", "prepare", "with_column", "words"]

#: ASCII white space, the separators of words (fixed value).
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def name(c: str) -> Column:
    """Column c by its exact name, dots included."""
    return F.col("`" + c.replace("`", "``") + "`")


def packed(docs: DataFrame, alias: str = "row") -> Column:
    """All columns of docs as one struct, out of the way of an operator's own names."""
    return F.struct(*[name(c) for c in docs.columns]).alias(alias)


def with_column(df: DataFrame, value: Column, make: Callable[[list], list], fields: list[T.StructField], rows_at_once: int, keep: list[str] | None = None) -> DataFrame:
    """df with new columns (those in fields, replacing any of the same name).

    make turns the values of some rows into lists of values, one for each
    field; it is given a bounded number of rows at a time. The other columns
    pass as one struct, whatever their names are; keep: only these do.
    """
    kept = df.columns if keep is None else keep
    rows = df.select(packed(df.select(*[name(c) for c in kept])), value.alias("value"))
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(lo, rows_at_once)
                made = make(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m, t) for m, t in zip(made, types, strict=True)]], names=["row", *[f"c{i}" for i in range(len(types))]])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], *[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]]))
    names = [f.name for f in fields]
    return out.select(*[F.col("row")[c].alias(c) for c in kept if c not in names], *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def words(text: Column) -> Column:
    """The words of a text: maximal runs of characters that are not ASCII space; null has none."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(text.isNull() | (inner == ""), F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


#: Rows of an Arrow batch that holds whole texts; the setting's own default makes batches of tens of MB on both sides.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> None:
    """What queries and stages, never operators, do to a session: send the package, and make batches of whole texts small where the caller left their size as it was."""
    ship(spark)
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return dealt(spark, f"{sf_dir}/documents.parquet")
