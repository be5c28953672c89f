"""Citations, provisions, sections, ids and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ordered_join
from ..operators import lookups
from ..operators.ranking import fallback
from .tables import table


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cite parts by ten times their key, orders whose keys divided by 4 leave a rest are the corpus."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 10).alias("cited"))
    corpus = table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderstatus", F.col("o_custkey"))
    out = lookups.cites(edges, corpus, "l_orderkey", "cited", "o_orderkey", "o_custkey")
    return out.select("l_orderkey", "l_linenumber", "cited", "in_corpus", "o_orderstatus")


CITES = """
SELECT l_orderkey, l_linenumber, l_partkey * 10 AS cited, o_orderkey IS NOT NULL AS in_corpus, o_orderstatus
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) ON o_orderkey = l_partkey * 10
"""


def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    rows = lookups.cited_by(edges, table(spark, sf_dir, "orders"), "l_orderkey", "l_suppkey", 7, "o_orderkey", "o_orderdate", limit=5000)
    ordered = rows.orderBy(F.desc("o_orderdate"), "o_orderkey", "l_linenumber", "l_partkey").limit(50)
    return ordered.select("o_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


CITED_BY = "SELECT o_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 7 ORDER BY o_orderdate DESC, o_orderkey, l_linenumber, l_partkey LIMIT 50"


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.provision_count(table(spark, sf_dir, "lineitem"), 11, column="l_partkey", key="l_orderkey")


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return lookups.recent_with_provision(table(spark, sf_dir, "lineitem"), orders, 5, column="l_suppkey", key="l_orderkey", id="o_orderkey", date="day", shown=["day", "o_orderkey", "o_orderstatus"])


RECENT = "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 5 ORDER BY day DESC, o_orderkey, o_orderstatus LIMIT 10"


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.when(F.col("o_orderstatus").isin("P", "F"), 0).otherwise(1)]
    rows = lookups.top_with_provision(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "R", column="l_returnflag", key="l_orderkey", id="o_orderkey", priority=first, shown=["o_orderkey", "o_orderstatus"])
    return rows


BEST = """
SELECT o_orderkey, o_orderstatus, count(*) AS provision_row_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey, o_orderstatus, o_orderpriority
ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus IN ('P', 'F') THEN 0 ELSE 1 END, provision_row_count DESC, o_orderkey LIMIT 5
"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sections of two sources, with ids as A-12 and their url as title."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "clb").otherwise("gl").alias("source"), F.concat(F.lit("A-"), F.floor(F.col("page_id") / 4).cast("string")).alias("section_id"), F.col("url").alias("title"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.neighbours(_sections(spark, sf_dir), "clb", "A-10").select("direction", "id", "section_id", "title")


_S = "WITH s AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'clb' ELSE 'gl' END AS source, 'A-' || (page_id // 4) AS section_id, url AS title FROM pages)"
NEIGHBOURS = _S + """,
o AS (SELECT min(id) AS lo, max(id) AS hi FROM s WHERE source = 'clb' AND section_id = 'A-10')
(SELECT 'previous' AS direction, id, section_id, title FROM s, o WHERE source = 'clb' AND id < lo ORDER BY id DESC LIMIT 3) UNION ALL
(SELECT 'next', id, section_id, title FROM s, o WHERE source = 'clb' AND id > hi AND section_id <> 'A-10' ORDER BY id LIMIT 3)
"""


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, in another case, by a prefix of one only, by a prefix of several (no row), and with a wildcard (no row)."""
    s, out = _sections(spark, sf_dir), None
    for w in ("A-10", "a-11", "a-5", "A-2%", "A-"):
        one = lookups.resolve_section(s, "clb", w).select(F.lit(w).alias("wanted"), "section_id")
        out = one if out is None else out.unionAll(one)
    return out


RESOLVE = _S + """, w AS (SELECT unnest(['A-10', 'a-11', 'a-5', 'A-2%', 'A-']) AS wanted),
f AS (SELECT DISTINCT wanted, section_id, CASE WHEN section_id = wanted THEN 0 WHEN lower(section_id) = lower(wanted) THEN 1 ELSE 2 END AS fit
      FROM s, w WHERE source = 'clb' AND starts_with(lower(section_id), lower(wanted))),
g AS (SELECT wanted, fit, min(section_id) AS section_id, count(*) AS k FROM f GROUP BY ALL)
SELECT wanted, arg_min(section_id, fit) AS section_id FROM g WHERE fit < 2 OR k = 1 GROUP BY wanted
"""


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions, found by a case number written loosely and by an ecli."""
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("T "), F.lpad((F.col("o_orderkey") % 500).cast("string"), 4, "0"), F.lit("/16")).alias("case_number"), F.concat(F.lit("ECLI:"), F.col("o_orderkey").cast("string")).alias("ecli"))
    return lookups.resolve_decision(d, "t 42 / 2016").unionAll(lookups.resolve_decision(d, " ECLI:77 ")).unionAll(lookups.resolve_decision(d, "nothing"))


DECISION = """
WITH d AS (SELECT o_orderkey AS id, 'T ' || lpad((o_orderkey % 500)::VARCHAR, 4, '0') || '/16' AS case_number, 'ECLI:' || o_orderkey AS ecli FROM orders)
(SELECT * FROM d WHERE case_number = 'T 0042/16' ORDER BY id LIMIT 1) UNION ALL (SELECT * FROM d WHERE ecli = 'ECLI:77' ORDER BY id LIMIT 1)
"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("is_original"))
    return fallback(docs, "source", "es").select("source", "id", "lang")


LANGUAGES = """
SELECT source, id, lang FROM (SELECT source, doc_id AS id, lang, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'es' THEN 0 WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END, doc_id) AS k FROM documents) WHERE k = 1
"""


def language_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each source in the order in which they come first."""
    first = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("at"))
    return first.groupBy("source").agg(ordered_join(F.col("at"), F.col("lang"), ",").alias("languages")).withColumn("more", lookups.append_language(F.col("languages"), F.lit("it")))


LANGUAGE_SETS = "SELECT source, string_agg(lang, ',' ORDER BY first_id) AS languages, string_agg(lang, ',' ORDER BY first_id) || ',it' AS more FROM (SELECT source, lang, min(doc_id) AS first_id FROM documents GROUP BY ALL) GROUP BY source"


def multivalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return lines.groupBy("l_orderkey").agg(ordered_join(order, F.col("l_partkey").cast("string"), " ").alias("parts"))


MULTIVALUES = "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey"

QUERIES = {
    "cites_left_join": cites, "cited_by_top50": cited_by, "provision_count": count, "provision_recent": recent, "provision_top": best, "section_neighbours": neighbours, "section_resolve": resolve,
    "decision_resolve": decision, "lang_fallback": languages, "ordered_language_set": language_sets, "multivalue_join": multivalues,
}
SQL = {
    "cites_left_join": CITES, "cited_by_top50": CITED_BY, "provision_count": "SELECT count(DISTINCT l_orderkey) AS decision_count FROM lineitem WHERE l_partkey = 11", "provision_recent": RECENT, "provision_top": BEST,
    "section_neighbours": NEIGHBOURS, "section_resolve": RESOLVE, "decision_resolve": DECISION, "lang_fallback": LANGUAGES, "ordered_language_set": LANGUAGE_SETS, "multivalue_join": MULTIVALUES,
}
