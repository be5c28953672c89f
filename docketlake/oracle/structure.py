"""Documents and books made from the tables, written as files where they are files, and ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, drop_cut
from ..sources import decision_xml, outline
from .tables import made, table


def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and value: orders as decision documents in three languages, two of a key."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    s = lambda c: F.col(c).cast("string")
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("k") % 3 + 1).cast("int"))
    key = F.floor(F.col("k") / 400) * 200 + F.col("k") % 200
    xml = F.concat(
        F.lit('<!-- <ep-appeal-decision> --><ep-appeal-decision lang="'), lang, F.lit('" procedure-lang="en"><ep-appeal-bib-data volume="v1"><ep-case-num code="T"><ep-appeal-num>'), s("k"), F.lit("</ep-appeal-num><ep-year>"), F.date_format("o_orderdate", "yyyy"),
        F.lit("</ep-year></ep-case-num><ep-ecli>E"), key.cast("string"), F.lit("</ep-ecli><ep-date-of-decision><date>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("</date></ep-date-of-decision></ep-appeal-bib-data><ep-headword>H"), s("k"),
        F.lit("</ep-headword><ep-legal-refs><ep-legal-citation><ep-legal-ref-presentation>EPC2000_Art_"), F.lpad((F.col("k") % 150).cast("string"), 3, "0"),
        F.lit("(1)</ep-legal-ref-presentation></ep-legal-citation></ep-legal-refs><ep-keywords><keyword>"), F.col("o_orderstatus"), F.lit("</keyword><keyword> </keyword><keyword>"), F.col("o_orderpriority"),
        F.lit('</keyword></ep-keywords><ep-cited-decisions><ep-cited-decision code="G"><ep-appeal-num>'), (F.col("k") % 7).cast("string"), F.lit("</ep-appeal-num><ep-year>2001</ep-year></ep-cited-decision></ep-cited-decisions>"),
        F.when(F.col("k") % 4 == 0, F.lit("<ep-headnote><p>note</p></ep-headnote>")).otherwise(F.lit("")), F.lit("<ep-reasons-for-decision><heading>no</heading><p>reason <b>dropped</b>"), s("k"), F.lit("</p><p> </p>\n<p>end</p></ep-reasons-for-decision></ep-appeal-decision>"),
    )
    return o.select("k", xml.alias("value"))


def _write_xml(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The documents in files whose names follow their order."""
    xml_lines(spark, sf_dir).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as decision documents, scanned from XML files."""
    path = made(spark, sf_dir, ["orders"], "orders-xml", lambda path: _write_xml(spark, sf_dir, path))
    read = decision_xml.scan(spark, f"{path}/part-*")
    docs = cut(read)  # parsed once; tables() reads documents several times
    drop_cut(read)
    return docs


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decision_xml.tables(_scanned(spark, sf_dir))["decisions"]
    return made.select("id", "ecli", "case_number", "decision_date", "language", "headword", "keywords", "has_headnote", "available_languages")


_D = """
WITH d AS (SELECT o_orderkey AS k, 'E' || (o_orderkey // 400 * 200 + o_orderkey % 200) AS ecli, ['en', 'de', 'fr'][(o_orderkey % 3 + 1)::INT] AS lang, o_orderdate, o_orderstatus || chr(10) || o_orderpriority AS kw FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY ecli ORDER BY k) AS n, lead(k) OVER (PARTITION BY ecli ORDER BY k) AS k2, lead(lang) OVER (PARTITION BY ecli ORDER BY k) AS lang2, lead(kw) OVER (PARTITION BY ecli ORDER BY k) AS kw2 FROM d)
"""
DECISIONS = _D + """
SELECT row_number() OVER (ORDER BY k)::BIGINT AS id, ecli, 'T ' || lpad(k::VARCHAR, greatest(4, len(k::VARCHAR))::INT, '0') || '/' || strftime(o_orderdate, '%y') AS case_number, strftime(o_orderdate, '%Y-%m-%d') AS decision_date, 'en' AS language,
  'H' || CASE WHEN lang2 = 'en' THEN k2 ELSE k END AS headword, CASE WHEN lang2 = 'en' THEN kw2 ELSE kw END AS keywords, CASE WHEN k % 4 = 0 OR (k2 % 4 = 0 AND lang2 = 'en') THEN 1 ELSE 0 END AS has_headnote,
  lang || CASE WHEN lang2 <> lang THEN ',' || lang2 ELSE '' END AS available_languages
FROM f WHERE n = 1
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decision_xml.tables(_scanned(spark, sf_dir))
    return made["decision_texts"].join(made["keys"].hint("merge"), ["decision_id", "lang"]).select("ecli", "lang", "is_original", "headnote", "reasons", "orders")


TEXTS = _D + """
SELECT ecli, lang, CASE WHEN lang = 'en' THEN 1 ELSE 0 END::INT AS is_original, CASE WHEN k % 4 = 0 THEN 'note' ELSE '' END AS headnote, 'reason ' || k || chr(10) || chr(10) || 'end' AS reasons, '' AS orders
FROM (SELECT *, row_number() OVER (PARTITION BY ecli, lang ORDER BY k) AS m FROM d) WHERE m = 1
"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decision_xml.tables(_scanned(spark, sf_dir))
    both = made["decision_provisions"].select("decision_id", F.lit("provision").alias("kind"), F.col("provision").alias("value")).unionAll(made["decision_citations"].select(F.col("citing_id").alias("decision_id"), F.lit("citation").alias("kind"), F.col("cited_case_number").alias("value")))
    keys = made["keys"].select("decision_id", "ecli").dropDuplicates(["decision_id"])
    return both.join(keys.hint("merge"), "decision_id").select("ecli", "kind", "value")


REFERENCES = _D + """
SELECT ecli, 'provision' AS kind, 'Art. ' || (k % 150) || '(1) EPC' AS value FROM f WHERE n = 1 UNION ALL SELECT ecli, 'citation', 'G 000' || (k % 7) || '/01' FROM f WHERE n = 1
"""


def _write_marked(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Orders as documents with close tags where they close nothing, and with white space in those that do."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    key, kind = F.col("k").cast("string"), F.col("k") % 5
    odd = (
        F.when(kind == 0, "<!-- </ep-appeal-decision> <ep-appeal-decision> -->").when(kind == 1, "<![CDATA[</ep-appeal-decision> <!--]]>").when(kind == 2, "<?note <!-- </ep-appeal-decision> ?>")
        .when(kind == 3, "<ep-appeal-decisions>dropped</ep-appeal-decisions>").otherwise("")
    )
    between = F.when(F.col("k") % 3 == 0, "<!-- <ep-appeal-decision></ep-appeal-decision> -->").otherwise("")
    xml = F.concat(
        between, F.lit('<ep-appeal-decision lang="en"><ep-appeal-bib-data><ep-ecli>E'), key, F.lit("</ep-ecli></ep-appeal-bib-data><ep-reasons-for-decision><p>"), F.col("o_orderpriority"), F.lit(" "), odd, key,
        F.lit("</p></ep-reasons-for-decision></ep-appeal-decision"), F.when(kind == 4, " \t").otherwise(""), F.lit(">"),
    )
    o.select("k", xml.alias("value")).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders read back in splits of a megabyte: ecli and reasons."""
    path = made(spark, sf_dir, ["orders"], "orders-marked-xml", lambda path: _write_marked(spark, sf_dir, path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        return decision_xml.scan(spark, f"{path}/part-*").select("ecli", "reasons")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


MARKED = """
SELECT 'E' || o_orderkey AS ecli, o_orderpriority || ' ' || CASE o_orderkey % 5 WHEN 1 THEN '</ep-appeal-decision> <!--' ELSE '' END || o_orderkey AS reasons FROM orders
"""


#: Digits of Roman numerals by place (fixed values).
ROMAN = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC"))


def _roman(n: Column) -> Column:
    digit = lambda signs, place: F.element_at(F.array(*[F.lit(x) for x in signs]), (F.floor(n / 10**place) % len(signs) + 1).cast("int"))
    return F.concat(*[digit(ROMAN[place], place) for place in (2, 1, 0)])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as two books whose leaves stand in every way that cuts differ by.

    By page: one heading after a running header; two in order; two in reverse,
    of which the first has no text; none that is in the text.
    """
    p = table(spark, sf_dir, "pages").withColumn("n", (F.col("page_id") + 1).cast("int")).withColumn("word", F.regexp_extract("url", "//([a-z]+)", 1))
    s, line = F.col("n").cast("string"), lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    one, other = line("1.", s, " Topic of ", F.col("word")), line("2.", s, " Other of ", F.col("word"))
    body, second = line("A body of more than forty characters on page ", s), line("Another body that is also longer than forty signs, page ", s)
    kind = F.col("n") % 5
    inside = (
        F.when(kind == 1, F.concat_ws("\n", one, body, other, second)).when(kind == 2, F.concat_ws("\n", other, second, one, body)).when(kind == 3, body).otherwise(F.concat_ws("\n", F.upper(one), body))
    )
    text = F.concat_ws("\n", F.lit("tail of the one before"), F.lit("Guidelines for Examination in the EPO"), inside, s)
    books = p.select("*", F.explode(F.array(F.lit("clb"), F.lit("gl"))).alias("source"))
    pages = books.select("source", F.col("n").alias("page"), text.alias("text"))
    chapter = F.when(F.col("source") == "clb", F.lit(2)).otherwise(F.floor(F.col("page_id") / 10) + 100).cast("long")
    node = lambda rows, id, up, title: rows.select("source", id.cast("long").alias("node_id"), up.cast("long").alias("parent_id"), id.cast("long").alias("ord"), title.alias("title"), F.col("n").alias("page"))
    leaf = F.col("page_id") * 2 + 1_000_000_000
    leaves = node(books, leaf, chapter, one).unionAll(node(books.filter(kind.isin(1, 2)), leaf + 1, chapter, other))
    above = node(books.filter("source = 'gl' and page_id % 10 = 0"), chapter, F.lit(1), line("Chapter ", _roman(F.floor(F.col("page_id") / 10) % 300 + 1), "  Of things"))
    above = above.unionAll(node(books.filter("source = 'clb' and page_id = 0"), F.lit(2), F.lit(1), F.lit("A. Inventions")))
    top = node(books.filter("page_id = 0"), F.lit(1), F.lit(None), F.when(F.col("source") == "clb", "II. PATENTABILITY").otherwise("Part A Formalities"))
    return outline.sections(pages, leaves.unionAll(above).unionAll(top)).select("id", "source", "section_id", "breadcrumb", "page_from", "page_to", "body")


def _roman_sql(n: str) -> str:
    return " || ".join(f"[{', '.join(repr(x) for x in ROMAN[place])}][({n}) // {10**place} % {len(ROMAN[place])} + 1]" for place in (2, 1, 0))


SECTIONS = rf"""
WITH p AS (SELECT page_id, (page_id + 1)::INT AS n, (page_id + 1) % 5 AS kind, regexp_extract(url, '//([a-z]+)', 1) AS w, {_roman_sql("page_id // 10 % 300 + 1")} AS r FROM pages),
h AS (SELECT *, '1.' || n || ' Topic of ' || w AS one, '2.' || n || ' Other of ' || w AS other, 'A body of more than forty characters on page ' || n AS body, 'Another body that is also longer than forty signs, page ' || n AS second FROM p),
t AS (SELECT *, concat_ws(chr(10), 'tail of the one before', CASE kind WHEN 1 THEN concat_ws(chr(10), one, body, other, second) WHEN 2 THEN concat_ws(chr(10), other, second, one, body) WHEN 3 THEN body ELSE concat_ws(chr(10), upper(one), body) END) AS text FROM h),
l AS (SELECT *, 0 AS k, one AS title, CASE WHEN kind = 3 THEN -1 ELSE instr(lower(text), lower(one)) - 1 END AS off FROM t UNION ALL SELECT *, 1, other, instr(lower(text), lower(other)) - 1 FROM t WHERE kind IN (1, 2)),
x AS (SELECT *, lead(n) OVER (ORDER BY n, k) AS next_n, lead(off) OVER (ORDER BY n, k) AS next_off, row_number() OVER (ORDER BY n, k) AS place FROM l),
s AS (SELECT x.*, y.text AS next_text, CASE WHEN next_n IS NULL OR next_n = x.n THEN x.n WHEN next_off > 0 THEN next_n ELSE next_n - 1 END::INT AS page_to FROM x LEFT JOIN t y ON y.n = next_n AND next_n > x.n),
b AS (SELECT *, greatest(off, 0) AS lo, CASE WHEN next_n = n AND next_off >= 0 THEN next_off ELSE length(text) END AS hi FROM s),
c AS (SELECT *, concat_ws(chr(10), nullif(trim(CASE WHEN hi > lo THEN substr(text, lo + 1, hi - lo) ELSE '' END, ' ' || chr(10)), ''), CASE WHEN page_to > n THEN nullif(trim(substr(next_text, 1, next_off), ' ' || chr(10)), '') END) AS body_ FROM b),
k AS (SELECT c.*, unnest(['clb', 'gl']) AS source FROM c WHERE length(body_) >= 40)
SELECT row_number() OVER (ORDER BY source, place) AS id, source, CASE source WHEN 'clb' THEN 'II.A.' ELSE 'A-' || r || ', ' END || split_part(title, ' ', 1) AS section_id,
  CASE source WHEN 'clb' THEN 'II. PATENTABILITY > A. Inventions > ' ELSE 'Part A Formalities > Chapter ' || r || ' Of things > ' END || title AS breadcrumb, n AS page_from, page_to, body_ AS body FROM k
"""

QUERIES = {"ingest_decisions": decisions, "ingest_texts": texts, "ingest_references": references, "ingest_sections": sections, "ingest_close_tags": marked}
SQL = {"ingest_decisions": DECISIONS, "ingest_texts": TEXTS, "ingest_references": REFERENCES, "ingest_sections": SECTIONS, "ingest_close_tags": MARKED}
