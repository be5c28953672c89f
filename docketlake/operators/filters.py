"""Metadata filters; an argument of None switches its filter off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metadata_filters(
    rows: DataFrame,
    *,
    board: str | None = None,
    type_code: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    language: str | None = None,
    provision: str | None = None,
    provisions: DataFrame | None = None,
    ipc_prefix: str | None = None,
    any_ipc: bool = False,
    only_with_headnote: bool = False,
    key: str = "id",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Rows that pass; dates are ISO text and compared as such, so partial bounds work.

    provisions: (decision_id, provision), for a semi join. ipc_prefix tests the
    joined codes, or with any_ipc each of them; it takes LIKE's wildcards.
    columns: names of the columns where they differ from the usual ones.
    """
    at = lambda c: F.col((columns or {}).get(c, c))
    if board is not None:
        rows = rows.filter(at("board") == board)
    if type_code is not None:
        rows = rows.filter(at("code") == type_code.upper())
    if date_from is not None:
        rows = rows.filter(at("decision_date") >= date_from)
    if date_to is not None:
        rows = rows.filter(at("decision_date") <= date_to)
    if language is not None:
        rows = rows.filter(at("lang") == language)
    if ipc_prefix is not None:
        like = ipc_prefix.lower() + "%"
        codes = F.lower(at("ipc"))
        rows = rows.filter(F.exists(F.split(codes, " "), lambda x: x.like(like)) if any_ipc else codes.like(like))
    if only_with_headnote:
        rows = rows.filter(at("has_headnote") == 1)
    if provision is not None and provisions is not None:
        having = provisions.filter(F.col("provision") == provision).select(F.col("decision_id").alias("_having"))
        rows = rows.join(having, at(key) == F.col("_having"), "left_semi")
    return rows
