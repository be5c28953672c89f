"""Ingest: merges by key, queues, slices, repairs, page text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legalref
from ..sources.outline import clean_page, heading_offset, join_hyphens, suffixed
from ..shared import shared_folder
from ..store import Store, new_keys, repaired, replaced_slice, upserted
from ..streaming.incremental import first_rows, ingest_new
from .tables import spread, table


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, and its types in order of first appearance."""
    e = table(spark, sf_dir, "events")
    first = first_rows(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])
    return first.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


DEDUPE = "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1"


def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return new_keys(docs, docs.filter("doc_id % 3 = 0"), ["source", "lang"]).unionAll(new_keys(docs, docs.filter("doc_id % 3 = 0"), ["doc_id"]).select("source", "lang", "doc_id")).select("source", "lang", "doc_id")


ANTI = """
SELECT source, lang, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents h WHERE h.doc_id % 3 = 0 AND h.source = d.source AND h.lang = d.lang)
UNION ALL SELECT source, lang, doc_id FROM documents WHERE doc_id % 3 <> 0
"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector, by language: the work queue."""
    docs, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    left = docs.join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("pending"), F.min("doc_id").alias("first_id"))


PENDING = "SELECT lang, count(*) AS pending, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that run from every seventh page to the next: pages joined by range, texts in order."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    starts = p.filter("page_id % 7 = 0").select(F.col("page_id").alias("begin"))
    spans = starts.withColumn("until", F.coalesce(F.lead("begin").over(Window.orderBy("begin")) - 1, F.col("begin") + 6))
    pages = spans.select("begin", "until", F.explode(F.sequence("begin", "until")).alias("page_id")).join(p, "page_id")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.substring("url", 8, 5).alias("t")))), lambda x: x["t"]), "|")
    return pages.groupBy("begin", "until").agg(F.count(F.lit(1)).alias("n_pages"), parts.alias("parts"))


INTERVALS = """
WITH s AS (SELECT page_id AS begin, coalesce(lead(page_id) OVER (ORDER BY page_id) - 1, page_id + 6) AS until FROM pages WHERE page_id % 7 = 0)
SELECT begin, until, count(*) AS n_pages, string_agg(substr(url, 8, 5), '|' ORDER BY page_id) AS parts FROM s JOIN pages ON page_id BETWEEN begin AND until GROUP BY ALL
"""


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return e.select("event_id", suffixed(e, "user_id", "key", "event_id").alias("id"))


SUFFIXES = """
WITH k AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS key FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(key) ORDER BY event_id) AS n FROM k)
SELECT event_id, CASE WHEN n = 1 THEN key ELSE key || ' (' || n || ')' END AS id FROM n
"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's first line begins in its text, in upper case (which has no single sign for ß) and wider spaced; its last line; and a title that isn't there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first, last = F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)
    wide = F.upper(F.replace(first, F.lit(" "), F.lit("  ")))
    at = lambda title: heading_offset(F.col("text"), title).cast("long")
    return docs.select("doc_id", at(wide).alias("first"), at(last).alias("last"), at(F.lit("no such. (title)")).alias("none"))


_TITLE = r"array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda x: x <> '')[1:8], ' ')"
_AT = r"CASE WHEN {0} = '' THEN -1 WHEN instr(lower(t), lower({0})) = 0 THEN -1 ELSE instr(lower(t), lower({0})) - 1 END::BIGINT"
HEADINGS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    f"s AS (SELECT *, {_TITLE.format('string_split(t, chr(10))[1]')} AS a, {_TITLE.format('string_split(t, chr(10))[-1]')} AS z FROM d) "
    f"SELECT doc_id, CASE WHEN contains(a, 'ß') THEN -1 ELSE {_AT.format('a')} END::BIGINT AS first, {_AT.format('z')} AS last, -1::BIGINT AS none FROM s"
)


def hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: its lines broken at hyphens, between page numbers and running headers."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    page = F.concat(F.lit("exam-\n  ple of\n12\nxiv\nab\nGuidelines for Examination in the EPO 3\n"), F.replace(text, F.lit("-"), F.lit(" ")), F.lit("\n7"))
    return docs.select("doc_id", clean_page(page).alias("cleaned"), join_hyphens(F.concat(F.lit("a-\nb "), F.col("source"))).alias("joined"))


HYPHENS = r"""
WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(replace(coalesce(text, ''), '-', ' '), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+|[ivxlc]+|[IVXLC]+')) AS l FROM documents)
SELECT doc_id, array_to_string(['example of'] || l, chr(10)) AS cleaned, 'ab ' || source AS joined FROM l
"""


def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored raw are normalised again; rows changed by hand and texts that aren't codes stay."""
    l = spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")  # noqa: E741
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("PCT2003_Rule_"), F.col("l_suppkey").cast("string"))).otherwise(F.lit("no code"))
    bag = l.withColumn("raw", raw).withColumn("provision", F.when(F.col("l_linenumber") == 4, F.lit("by hand")).otherwise(raw))
    return repaired(bag, legalref.normalise_raw(F.col("raw"))).select("l_orderkey", "l_linenumber", "provision")


REPAIR = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 'by hand' WHEN l_linenumber % 2 = 0 THEN 'R. ' || l_suppkey || ' PCT' ELSE 'no code' END AS provision FROM lineitem"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 3).alias("value"))
    new = e.filter("event_type = 'click' and event_id % 2 = 0").withColumn("value", F.lit(0.0))
    return replaced_slice(e, F.col("event_type") == "click", new)


SLICES = "SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN 0.0 ELSE round(value, 3) END::DOUBLE AS value FROM events WHERE event_type <> 'click' OR event_id % 2 = 0"


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    held = e.groupBy("event_type").agg(F.count(F.lit(1)).cast("string").alias("value")).withColumnRenamed("event_type", "key")
    new = e.filter("event_type = 'error'").groupBy("event_type").agg(F.lit("seen").alias("value")).withColumnRenamed("event_type", "key").unionAll(held.limit(1).select(F.lit("stage").alias("key"), F.lit("new").alias("value")))
    return upserted(held, new, "key")


META = "SELECT event_type AS key, CASE WHEN event_type = 'error' THEN 'seen' ELSE count(*)::VARCHAR END AS value FROM events GROUP BY event_type UNION ALL SELECT 'stage', 'new'"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in files; the first of each user, over all of them, ends in the table."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    e.repartitionByRange(4, "event_id").write.mode("overwrite").parquet(f"{work}/in")
    store = Store(spark, f"{work}/store")
    ingest_new(spark, f"{work}/in", e.schema, store, "events", ["user_id"], ["event_id"], f"{work}/checkpoint")
    return store.read("events")


STREAM = "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"

QUERIES = {
    "dedupe_by_key_first": dedupe, "anti_new_keys": anti, "pending_backfill": pending, "interval_slice": intervals, "dup_id_suffix": suffixes, "heading_offset": headings,
    "hyphen_clean": hyphens, "repair_update": repair, "slice_replace": slices, "meta_upsert": meta, "incremental_stream": stream,
}
SQL = {
    "dedupe_by_key_first": DEDUPE, "anti_new_keys": ANTI, "pending_backfill": PENDING, "interval_slice": INTERVALS, "dup_id_suffix": SUFFIXES, "heading_offset": HEADINGS,
    "hyphen_clean": HYPHENS, "repair_update": REPAIR, "slice_replace": SLICES, "meta_upsert": META, "incremental_stream": STREAM,
}
