"""Passages: budgeted pages, scores, chunks, codes of cases and provisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casenum, legalref
from ..functions.chunker import chunks
from ..functions.text import essence, first_values, iso_date, passage_score, query_terms
from ..operators.ranking import budget_page
from .tables import spread, table


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = budget_page(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", offset=1, limit=3, max_chars=1000)
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("chars"), "total_chunks", F.col("next_offset").cast("long").alias("next_offset"))


BUDGET = """
WITH r AS (SELECT conv_id, turn, length(text)::BIGINT AS chars, count(*) OVER (PARTITION BY conv_id) AS total_chunks, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY p) AS sofar FROM r WHERE p > 1),
k AS (SELECT * FROM s WHERE p <= 4 AND (p = 2 OR sofar <= 1000))
SELECT conv_id, turn, chars, total_chunks, CASE WHEN max(p) OVER (PARTITION BY conv_id) < total_chunks THEN max(p) OVER (PARTITION BY conv_id) END::BIGINT AS next_offset FROM k
"""


def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", passage_score(F.col("text"), "The thing of").alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "conv_id", "turn").limit(50)


_TERM = "(length(text) - length(replace(lower(text), '{0}', ''))) // {1}"
LEXICAL = (
    "SELECT conv_id, turn, (CASE WHEN contains(lower(text), 'the thing of') THEN 10 ELSE 0 END + " + " + ".join(_TERM.format(w, len(w)) for w in ("the", "thing", "of")) + ")::BIGINT AS score "
    "FROM conversations QUALIFY score > 0 ORDER BY score DESC, conv_id, turn LIMIT 50"
).replace("QUALIFY score > 0", "WHERE contains(lower(text), 'the') OR contains(lower(text), 'thing') OR contains(lower(text), 'of')")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("seq", "piece"))
    return docs.select("doc_id", "seq", "piece")


_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SEP = "CASE WHEN contains(t, chr(10) || chr(10)) THEN chr(10) || chr(10) ELSE chr(10) END"
#: One paragraph, or one piece of a long one, a step: what is held back, and what a step gives (emit).
CHUNKED = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_STRIPPED.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, {_SEP} AS sep, list_filter(list_transform(string_split(t, {_SEP}), lambda x: {_STRIPPED.format("x")}), lambda x: x <> '') AS ps FROM d WHERE length(t) > 1600),
s AS (
  SELECT doc_id, 0 AS step, 1 AS i, NULL::VARCHAR AS rest, NULL::VARCHAR AS held, 0::BIGINT AS size, NULL::VARCHAR AS emit, false AS done FROM p
  UNION ALL
  SELECT doc_id, step + 1, CASE WHEN rest IS NULL AND q IS NOT NULL THEN i + 1 ELSE i END,
    CASE WHEN rest IS NOT NULL THEN nullif(substr(rest, stop + 1), '') WHEN length(q) > 1600 THEN q END,
    CASE WHEN rest IS NOT NULL THEN held WHEN q IS NULL OR length(q) > 1600 THEN NULL WHEN over THEN concat_ws(sep, nullif(tail, ''), q) ELSE concat_ws(sep, held, q) END,
    CASE WHEN rest IS NOT NULL THEN size WHEN q IS NULL OR length(q) > 1600 THEN 0 WHEN over THEN length(tail) + length(q) + 2 ELSE size + length(q) + 2 END,
    CASE WHEN rest IS NOT NULL THEN nullif({_STRIPPED.format("substr(rest, 1, stop)")}, '') WHEN q IS NULL OR length(q) > 1600 OR over THEN held END,
    rest IS NULL AND q IS NULL
  FROM (SELECT *, length(q) <= 1600 AND held IS NOT NULL AND size + length(q) + 2 > 1600 AS over,
          CASE WHEN length(rest) > 1600 AND blank > 0 AND 1600 - blank > 800 THEN 1600 - blank ELSE least(1600, length(rest)) END AS stop,
          CASE WHEN length(held) <= 200 THEN '' WHEN instr(right(held, 200), ' ') > 1 THEN substr(right(held, 200), instr(right(held, 200), ' ') + 1) ELSE right(held, 200) END AS tail
        FROM (SELECT s.*, sep, ps[i] AS q, instr(reverse(substr(rest, 1, 1600)), ' ') AS blank FROM s JOIN p USING (doc_id) WHERE NOT done))),
c AS (SELECT doc_id, step, emit FROM s WHERE emit IS NOT NULL UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) BETWEEN 1 AND 1600)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS seq, emit AS piece FROM c
"""


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that fit in one chunk are that chunk; longer ones have several, none over the bound."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", r"^\s+|\s+$", ""))
    docs = docs.select("doc_id", "t", chunks(F.col("text")).alias("c"))
    bound = F.aggregate("c", F.lit(0), lambda s, x: F.greatest(s, F.length(x))) <= 1802
    return docs.select("doc_id", (F.size("c") == 1).alias("whole"), bound.alias("bounded"))


CHUNK_BOUNDS = r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) <= 1600 AS whole, true AS bounded FROM documents"


def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written loosely from order keys, and their canonical form; every fifth isn't one, nor are those of five digits."""
    o = table(spark, sf_dir, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("X "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("t  "), F.col("o_orderkey").cast("string"), F.lit(" / "), year))
    return o.select("o_orderkey", casenum.parse_case(raw).alias("parsed"), casenum.format_case(F.lit("G"), F.col("o_orderkey").cast("string"), year.cast("int")).alias("formatted"))


CASE_NUMBERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND len(k) <= 4 THEN 'T ' || lpad(k, greatest(4, len(k))::INT, '0') || '/' || strftime(o_orderdate, '%y') END AS parsed,
       'G ' || lpad(k, greatest(4, len(k))::INT, '0') || '/' || strftime(o_orderdate, '%y') AS formatted FROM (SELECT *, o_orderkey::VARCHAR AS k FROM orders)
"""


def inline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("see t "), F.col("o_orderkey").cast("string"), F.lit("/16, G 1/2019 and XT 5/12"))
    return o.select("o_orderkey", F.array_join(casenum.inline_cases(text), "|").alias("found"))


INLINE_CASES = "SELECT o_orderkey, CASE WHEN o_orderkey < 10000 THEN 'T ' || lpad(o_orderkey::VARCHAR, 4, '0') || '/16|' ELSE '' END || 'G 0001/19' AS found FROM orders"


def legal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of several eras made from line items; the third kind isn't a code and stays."""
    l = spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")  # noqa: E741
    key, p = F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")
    short = F.lpad(key, 3, "0")  # cuts longer keys, as SQL's does
    n = F.when(F.length(key) > 3, key).otherwise(short)
    raw = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("EPC2000_Art_"), n, F.lit("("), p, F.lit(")_(2007)")))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("VOBK_2020_R_"), n, F.lit("a_Sent_3")))
        .otherwise(F.concat(F.lit("EPC_Art_"), short, F.lit("_foo")))
    )
    return l.select("l_orderkey", "l_linenumber", legalref.normalise_raw(raw).alias("provision"))


LEGAL_REFS = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Art. ' || l_suppkey || '(' || l_linenumber || ') EPC' WHEN 1 THEN 'R. ' || l_suppkey || 'a RPBA'
  ELSE 'EPC_Art_' || lpad(l_suppkey::VARCHAR, 3, '0') || '_foo' END AS provision FROM lineitem
"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey").cast("string")
    rule = legalref.normalise_typed(F.concat(F.lit("rule "), n, F.lit("(1)(a)")))
    return s.select(
        "s_suppkey", legalref.normalise_typed(F.concat(F.lit(" Article "), n, F.lit(" RPBA 2020"))).alias("article"), rule.alias("rule"),
        F.array_join(legalref.prose_variants(rule), "|").alias("variants"), legalref.normalise_typed(F.col("s_name")).alias("other"),
    )


TYPED = "SELECT s_suppkey, 'Art. ' || s_suppkey || ' RPBA' AS article, 'R. ' || s_suppkey || '(1)(a) EPC' AS rule, 'R. ' || s_suppkey || '(1)(a)|Rule ' || s_suppkey || '(1)(a)' AS variants, trim(s_name) AS other FROM supplier"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, terms, essences and first values of text fields."""
    o = table(spark, sf_dir, "orders")
    digits = F.when(F.col("o_orderkey") % 4 == 0, F.lit("20191340")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    blank = F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    return o.select(
        "o_orderkey", iso_date(digits).alias("day"), F.array_join(query_terms(F.concat(F.lit("The the A b2 "), F.col("o_orderpriority"))), "|").alias("terms"),
        essence(F.col("o_orderstatus"), blank, F.lit(None).cast("string"), F.lit("end")).alias("essence"), F.array_join(first_values(F.concat_ws("\n", F.lit("a"), F.lit(""), F.col("o_orderstatus"), F.lit("c"), F.lit("d")), "\n"), "|").alias("firsts"),
    )


FIELDS = r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
  array_to_string(list_filter(['the', 'b2'] || regexp_extract_all(lower(o_orderpriority), '[\p{L}\p{Nd}]+'), lambda x: length(x) > 1), '|') AS terms,
  concat_ws(chr(10) || chr(10), o_orderstatus, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END, 'end') AS essence, 'a|' || o_orderstatus || '|c' AS firsts
FROM orders
"""

QUERIES = {
    "passage_budget_page": budget, "passage_lexical_score": lexical_score, "chunker": chunked, "chunker_bounds": chunk_bounds, "casenum_format_parse": case_numbers,
    "inline_casenum": inline_cases, "legalref_normalize": legal_refs, "legalref_typed_variants": typed, "text_fields": fields,
}
SQL = {
    "passage_budget_page": BUDGET, "passage_lexical_score": LEXICAL, "chunker": CHUNKED, "chunker_bounds": CHUNK_BOUNDS, "casenum_format_parse": CASE_NUMBERS,
    "inline_casenum": INLINE_CASES, "legalref_normalize": LEGAL_REFS, "legalref_typed_variants": TYPED, "text_fields": FIELDS,
}
