"""Registered queries with their DuckDB SQL, one module per family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, changes, ingest, lookups, passages, structure, text, vectors  # noqa: E402

FAMILIES = [text, vectors, passages, lookups, ingest, structure, answers, changes]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in FAMILIES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in FAMILIES for k, s in m.SQL.items()}
