"""The driver's tables, and what is made of them once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.postings import read_index, write_index
from ..shared import dealt, file_system, shared_folder, ship

_made: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that takes long on each row: dealt to all cores if it is small and of few files."""
    ship(spark)
    return dealt(spark, f"{sf_dir}/{name}.parquet")


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Names, sizes and times of a table's files."""
    p, fs = file_system(spark, f"{sf_dir}/{name}.parquet")
    files = fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def made(spark: SparkSession, sf_dir: str, tables: Sequence[str], name: str, make: Callable[[str], object]) -> str:
    """The path of something made of tables: made once an application, and again only if their files changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *(_state(spark, sf_dir, t) for t in tables))
    if key not in _made:
        path = f"{shared_folder(spark)}/made-{name}-{len(_made)}"
        make(path)
        _made[key] = path
    return _made[key]


def text_index(spark: SparkSession, sf_dir: str, source: str, name: str, rows: Callable[[], DataFrame], row_id: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and shape of rows derived from a table: like any text index, written once and then asked."""
    return read_index(spark, made(spark, sf_dir, [source], name, lambda path: write_index(rows(), row_id, columns, path)))


def bounded_index(spark: SparkSession, sf_dir: str, source: str, name: str, rows: Callable[[], DataFrame], row_id: str, columns: Sequence[str], block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """text_index() with the bounds of runs of ``block`` ids, written by the same job."""
    path = made(spark, sf_dir, [source], f"{name}-bounds-{block}", lambda path: write_index(rows(), row_id, columns, path, block))
    return *read_index(spark, path), spark.read.parquet(f"{path}/bounds")
