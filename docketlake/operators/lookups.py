"""Look-ups: citations, provisions, sections and their neighbours, ids of decisions and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casenum import parse_case
from .ranking import best_per_key


def cites(edges: DataFrame, decisions: DataFrame, citing: str, cited: str, key: str, order: str) -> DataFrame:
    """Each citation with the decision it names, the first by order where several share the number; in_corpus tells whether there is one."""
    first = best_per_key(decisions, key, F.col(order)).withColumnRenamed(key, "_key")
    out = edges.join(first, F.col(cited) == F.col("_key"), "left")
    return out.withColumn("in_corpus", F.col("_key").isNotNull()).drop("_key")


def cited_by(edges: DataFrame, decisions: DataFrame, citing: str, cited: str, number, key: str, date: str, limit: int = 50) -> DataFrame:
    """The latest decisions that cite a number; a citation counts each time."""
    rows = edges.filter(F.col(cited) == number).join(decisions, F.col(citing) == F.col(key))
    return rows.orderBy(F.desc_nulls_last(date), key).limit(limit)


def provision_count(bag: DataFrame, provision, *, column: str = "provision", key: str = "decision_id") -> DataFrame:
    return bag.filter(F.col(column) == provision).agg(F.countDistinct(key).alias("decision_count"))


def recent_with_provision(bag: DataFrame, decisions: DataFrame, provision, *, column: str, key: str, id: str, date: str, shown: list[str], limit: int = 10) -> DataFrame:
    rows = bag.filter(F.col(column) == provision).join(decisions, F.col(key) == F.col(id)).select(*shown).distinct()
    return rows.orderBy(F.desc_nulls_last(date), *[F.col(c) for c in shown if c != date]).limit(limit)


def top_with_provision(bag: DataFrame, decisions: DataFrame, provision, *, column: str, key: str, id: str, priority: list[Column], shown: list[str], limit: int = 5) -> DataFrame:
    """Decisions by priority, then by how many of their provision rows it is (provision_row_count)."""
    counts = bag.filter(F.col(column) == provision).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("provision_row_count"))
    rows = counts.join(decisions, F.col("_key") == F.col(id)).orderBy(*priority, F.desc("provision_row_count"), F.col(id)).limit(limit)
    return rows.select(*shown, "provision_row_count")


def neighbours(sections: DataFrame, source: str, section_id: str, n: int = 3) -> DataFrame:
    """The n sections before and after the parts of a section, in document order: section_id, title, direction."""
    own = sections.filter((F.col("source") == source) & (F.col("section_id") == section_id)).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rows = sections.filter((F.col("source") == source) & (F.col("section_id") != section_id)).join(F.broadcast(own))  # one row
    side = F.when(F.col("id") < F.col("low"), "previous").when(F.col("id") > F.col("high"), "next")
    rows = rows.withColumn("direction", side).filter("direction is not null")
    near = F.when(F.col("direction") == "previous", -F.col("id")).otherwise(F.col("id"))
    place = F.row_number().over(Window.partitionBy("direction").orderBy(near))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).select("direction", "id", "section_id", "title")


def resolve_section(sections: DataFrame, source: str, wanted: str) -> DataFrame:
    """The section id meant: exactly, else ignoring case, else the only one that begins so; no row if there is none.

    One pass: each section says how it fits, and the best fit that is allowed is taken.
    """
    ids = sections.filter(F.col("source") == source).select("section_id").distinct()
    low, w = F.lower("section_id"), wanted.strip()
    fit = F.when(F.col("section_id") == w, 0).when(low == w.lower(), 1).when(low.startswith(w.lower()), 2)
    fits = ids.withColumn("fit", fit).filter("fit is not null")
    groups = fits.groupBy("fit").agg(F.min("section_id").alias("section_id"), F.count(F.lit(1)).alias("k")).filter("fit < 2 or k = 1")
    return groups.orderBy("fit").limit(1).select("section_id")


def resolve_decision(decisions: DataFrame, key: str) -> DataFrame:
    """The decision of a case number in any spelling, or of an ECLI; the first by id."""
    canonical = parse_case(F.lit(key.strip()))
    fits = F.when(canonical.isNotNull(), F.col("case_number") == canonical).otherwise((F.col("ecli") == key.strip()) | (F.col("case_number") == key.strip()))
    return decisions.filter(fits).orderBy("id").limit(1)


def append_language(languages: Column, lang: Column) -> Column:
    """An ordered comma-joined set with one more language."""
    return F.when(languages.isNull() | (languages == ""), lang).otherwise(F.array_join(F.array_union(F.split(languages, ","), F.array(lang)), ","))
