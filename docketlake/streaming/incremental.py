"""Incremental ingest: new files are appended by key, each batch as one change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Store


def ingest_new(spark: SparkSession, folder: str, schema: T.StructType, store: Store, table: str, keys: list[str], order: list[str], checkpoint: str, files_at_once: int | None = None):
    """Read what is new in a folder of Parquet files and add the rows with new keys; returns when all is done.

    Within a batch the first row of a key, by order, counts; over batches the
    earlier one does. No state is kept but the table's own keys.
    """
    reader = spark.readStream.schema(schema)
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)

    def add(batch: DataFrame, number: int) -> None:
        store.append_new(table, first_rows(batch, keys, order), keys)

    query = reader.parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*keys, "v.*").select(*rows.columns)
