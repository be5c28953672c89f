"""The library's questions over a store made of the driver's tables.

Documents are decisions (their text the reasons, every fifth also with a French
version), turns of conversations are the passages of the decision of the same
id, embeddings the passages' vectors, pages the sections of two books.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions.casenum import format_case
from ..plans.library import Library
from ..store import Store
from .tables import made, table

#: Ids of the French versions begin here, so that they sort behind the others.
VERSIONS = 1_000_000_000_000
#: The vector that every question of a query by vector has.
QUERY_ID = 7
#: The driver's tables by name.
Tables = Callable[[str], DataFrame]


def _case(n) -> F.Column:
    return format_case(F.lit("T"), n.cast("string"), F.lit(2016))


def _documents(t: Tables) -> DataFrame:
    """Documents with the quality of their label. Titles are cut before the join, so that what needs no texts moves none."""
    d = t("documents").select(F.col("doc_id").alias("id"), "lang", "source", "text", F.substring_index("text", "\n", 1).alias("title"))
    return d.join(t("labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")


def _heads(title: Column) -> dict[str, Column]:
    """The fields of a decision that its texts are found by."""
    id = F.col("decision_id")
    return {"case_number": _case(id), "headword": F.concat(F.lit("head"), (id % 50).cast("string")), "keywords": F.concat_ws("\n", "lang", "source", F.lit("third"), F.lit("fourth")), "title": title}


def _and_versions(own: DataFrame) -> DataFrame:
    """Rows of texts and those of the French versions of every fifth; further columns are the decision's."""
    id, empty = F.col("decision_id"), F.lit("")
    fields = {
        "id": id + VERSIONS, "lang": F.lit("fr"), "is_original": F.lit(0), "headnote": empty, "catchwords": empty, "facts": empty,
        "reasons": F.concat(F.lit("version licensed under "), id.cast("string")), "orders": empty,
    }
    return own.unionAll(own.filter("decision_id % 5 = 0").select(*[fields[c].alias(c) if c in fields else F.col(c) for c in own.columns]))


def _decisions(store: Store, t: Tables) -> None:
    d = _documents(t).withColumn("decision_id", F.col("id"))
    none, heads = F.lit(None).cast("string"), _heads(F.col("title"))
    day = F.concat(F.lit("20"), F.lpad((F.col("id") % 20).cast("string"), 2, "0"), F.lit("-03-1"), (F.col("id") % 7).cast("string"))
    decisions = d.select(
        "id", heads["case_number"].alias("case_number"), F.lit("T").alias("code"), F.col("id").cast("string").alias("appeal_num"), F.lit(2016).alias("year"), F.concat(F.lit("ECLI:"), F.col("id").cast("string")).alias("ecli"), F.col("source").alias("board"),
        day.alias("decision_date"), F.col("lang").alias("language"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("distribution"), "title",
        none.alias("application_number"), F.concat(F.lit("A61K"), (F.col("id") % 5).cast("string"), F.lit("/00 H04L1/02")).alias("ipc"), heads["headword"].alias("headword"),
        heads["keywords"].alias("keywords"), none.alias("oj_reference"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("has_headnote"), F.col("lang").alias("available_languages"),
    )
    store.replace("decisions", decisions.sortWithinPartitions("id"))


def _texts(store: Store, t: Tables) -> None:
    """Texts are written where their documents are read, each file sorted by id: the texts themselves aren't shuffled for it."""
    note = F.when(F.col("quality") == 1, F.concat(F.lit("note on "), "source")).otherwise("")
    own = _documents(t).select("id", F.col("id").alias("decision_id"), "lang", F.lit(1).alias("is_original"), note.alias("headnote"), F.lit("").alias("catchwords"), F.lit("").alias("facts"), F.col("text").alias("reasons"), F.concat(F.lit("order of "), "source").alias("orders"), "source")
    store.replace("decision_texts", _and_versions(own).sortWithinPartitions("id"))


def _references(store: Store, t: Tables) -> None:
    d = _documents(t)
    provisions = d.select(F.col("id").alias("decision_id"), F.explode(F.array(F.concat(F.lit("Art. "), (F.col("id") % 37).cast("string"), F.lit(" EPC")), F.concat(F.lit("R. "), (F.col("id") % 11).cast("string"), F.lit(" EPC")), F.concat(F.lit("R. "), (F.col("id") % 3).cast("string"), F.lit(" EPC")))).alias("provision"))
    citations = d.select(F.col("id").alias("citing_id"), F.explode(F.array(_case(F.col("id") % 40), _case(F.col("id") * 3 + 1))).alias("cited_case_number"))
    for name, rows in {"decision_provisions": provisions.withColumn("raw", F.col("provision")), "decision_citations": citations}.items():
        store.replace(name, rows, jobs.CLUSTERED[name])


def _passages(store: Store, t: Tables) -> None:
    """Chunks are written where they are joined, as texts are; vectors are joined to digests, so no text moves for them."""
    turns = t("conversations").select(F.col("conv_id").alias("decision_id"), F.col("turn").cast("int").alias("seq"), "text")
    of = _documents(t).select(F.col("id").alias("decision_id"), "lang")
    id, kind = (F.col("decision_id") * 1000 + F.col("seq")).alias("id"), F.lit("reasons").alias("kind")
    chunks = turns.join(of, "decision_id").select(id, kind, "decision_id", F.lit(None).cast("long").alias("book_section_id"), "lang", "seq", "text")
    store.replace("chunks", chunks.sortWithinPartitions("id"))
    first = turns.filter("seq = 0").select("decision_id", "seq", F.xxhash64("text").alias("digest")).join(of.select("decision_id"), "decision_id")
    vectors = first.join(t("embeddings").filter("embedding is not null").select(F.col("vec_id").alias("decision_id"), "embedding"), "decision_id")
    store.replace("vectors", vectors.select(id, "digest", kind, "embedding"), ["id"], "kind")


def _sections(store: Store, t: Tables) -> None:
    p = t("pages").withColumn("n", F.col("page_id") + 1)
    sections = p.select(
        F.col("n").alias("id"), F.when(F.col("n") % 2 == 0, "clb").otherwise("gl").alias("source"), F.concat(F.lit("A-"), F.floor(F.col("n") / 4).cast("string")).alias("section_id"), F.col("url").alias("title"), F.concat(F.lit("Part > "), "url").alias("breadcrumb"),
        F.col("n").cast("int").alias("page_from"), (F.col("n") + 1).cast("int").alias("page_to"), (F.col("n") % 4).cast("int").alias("part"), F.concat(F.col("html"), F.lit(" see Rule "), (F.col("n") % 11).cast("string"), F.lit(" and Art. 5")).alias("body"),
    )
    store.replace("book_sections", sections)


def _index_decisions(store: Store, t: Tables) -> None:
    """Index the store's texts as they lie: they hold what their decision's fields are made of, so nothing is joined."""
    own = store.read("decision_texts").filter("is_original = 1")
    own = own.select(*own.columns, *[c.alias(n) for n, c in _heads(F.substring_index("reasons", "\n", 1)).items()])
    jobs.rebuild_text_index(store, _and_versions(own).select("id", *jobs.DECISION_INDEX))
    store.set_meta(indexed_at="now")


def _index_sections(store: Store, t: Tables) -> None:
    jobs.update_index(store, "section", store.read("book_sections"), jobs.SECTION_INDEX)


#: What a store is made of; an index after what it is of.
PARTS = {"decisions": _decisions, "texts": _texts, "references": _references, "passages": _passages, "sections": _sections, "decision index": _index_decisions, "section index": _index_sections}


def _build(spark: SparkSession, sf_dir: str, path: str, parts: Sequence[str] = tuple(PARTS)) -> None:
    for part in parts:
        PARTS[part](Store(spark, path), lambda name: table(spark, sf_dir, name))


def library(spark: SparkSession, sf_dir: str, *parts: str) -> Library:
    """The library over the store of an application and table state; parts are made, each once, when a question first reads them."""
    tables = ["documents", "labels", "embeddings", "conversations", "pages"]
    path = made(spark, sf_dir, tables, "library", lambda path: None)
    for part in (p for p in PARTS if p in parts):
        made(spark, sf_dir, tables, f"library {part}", lambda _, part=part: _build(spark, sf_dir, path, [part]))
    v = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_ID).select("embedding").first()[0]
    return Library(Store(spark, path), lambda q: list(v))


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_D = """
WITH d AS (SELECT doc_id AS id, 'T ' || lpad(doc_id::VARCHAR, greatest(4, len(doc_id::VARCHAR))::INT, '0') || '/16' AS case_number, 'ECLI:' || doc_id AS ecli, source AS board,
  '20' || lpad((doc_id % 20)::VARCHAR, 2, '0') || '-03-1' || (doc_id % 7) AS date, lang AS language, ['A', 'B', 'C'][doc_id % 3 + 1] AS distribution, string_split(text, chr(10))[1] AS title,
  'head' || (doc_id % 50) AS headword, concat_ws(chr(10), lang, source, 'third', 'fourth') AS keywords, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS has_headnote, CASE WHEN quality = 1 THEN 'note on ' || source ELSE '' END AS note, text
  FROM documents LEFT JOIN labels USING (doc_id)),
x AS (SELECT id, id AS decision_id, language AS lang, note AS headnote, text AS reasons, 'order of ' || board AS orders FROM d UNION ALL
  SELECT id + 1000000000000, id, 'fr', '', 'version licensed under ' || id, '' FROM d WHERE id % 5 = 0)
"""
_WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_SEARCHED = [("case_number", 10), ("headword", 8), ("keywords", 8), ("headnote", 8), ("title", 4), ("reasons", 2), ("orders", 1)]


def _hits(word: str) -> str:
    return " + ".join(f"{w} * len(list_filter({c}, lambda y: starts_with(y, '{word}')))" for c, w in _SEARCHED)


_SCORED = _D + (
    ", w AS (SELECT x.id, decision_id, lang, " + ", ".join(f"{_WORDS.format(c)} AS {c}" for c, _ in _SEARCHED) + " FROM x JOIN d ON d.id = x.decision_id), "
    "n AS (SELECT id, decision_id, lang, " + " + ".join(f"len({c})" for c, _ in _SEARCHED) + f" AS n, ({_hits('licensed')})::DOUBLE AS f0, ({_hits('under')})::DOUBLE AS f1 FROM w), "
    "c AS (SELECT count(*)::DOUBLE AS r, avg(n) AS mean, count(*) FILTER (f0 > 0)::DOUBLE AS n0, count(*) FILTER (f1 > 0)::DOUBLE AS n1 FROM n), "
    "s AS (SELECT id, decision_id, lang, -(" + " + ".join(f"greatest(1e-6, ln((r - n{i} + 0.5) / (n{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in (0, 1)) + ") AS score FROM n, c WHERE f0 > 0 AND f1 > 0)"
)
SEARCH = "mode string, total long, place int, case_number string, ecli string, date string, board string, language string, headword string, keywords string"


def _found(spark: SparkSession, answer: dict) -> DataFrame:
    rows = [(answer["mode"], answer["total"], i, r["case_number"], r["ecli"], r["date"], r["board"], r["language"], r["headword"], "|".join(r["keywords"])) for i, r in enumerate(answer["results"])]
    return _frame(spark, rows, SEARCH)


def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 by words, with filters: of the text's language, the provision, the dates, the classes."""
    return _found(spark, library(spark, sf_dir, "decisions", "texts", "references", "decision index").search_decisions("licensed under", mode="lexical", limit=25, date_from="2003", date_to="2017-03-12", language="fr", provision="Rule 0", ipc_prefix="a61k_/", type_code="t"))


_SHOWN = "case_number, ecli, date, board, {0} AS language, headword, array_to_string(string_split(keywords, chr(10))[1:3], '|') AS keywords"
SEARCH_LEXICAL = _SCORED + (
    ", m AS (SELECT s.* FROM s JOIN d ON d.id = decision_id WHERE lang = 'fr' AND date >= '2003' AND date <= '2017-03-12' AND (decision_id % 11 = 0 OR decision_id % 3 = 0)), "
    "b AS (SELECT decision_id, count(*) OVER () AS total, row_number() OVER (ORDER BY min(score), decision_id) - 1 AS place FROM m GROUP BY decision_id) "
    "SELECT 'lexical' AS mode, total::BIGINT AS total, place::INT AS place, " + _SHOWN.format("'fr'") + " FROM b JOIN d ON d.id = decision_id WHERE place < 25"
)


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 by words and by vector, fused; the second page, of documents with a headnote."""
    return _found(spark, library(spark, sf_dir, "decisions", "texts", "references", "passages", "decision index").search_decisions("licensed under", limit=10, offset=5, only_with_headnote=True))


SEARCH_HYBRID = _SCORED + (
    ", m AS (SELECT decision_id, lang, id, score, row_number() OVER (PARTITION BY decision_id ORDER BY score, s.id) AS k FROM s WHERE decision_id IN (SELECT id FROM d WHERE has_headnote = 1)), "
    "l AS (SELECT decision_id, lang, row_number() OVER (ORDER BY score, decision_id) AS r1 FROM m WHERE k = 1 ORDER BY score, decision_id LIMIT 100), "
    "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), "
    "v AS (SELECT c.conv_id AS decision_id, list_distance(embedding::DOUBLE[], q) AS distance FROM (SELECT conv_id FROM conversations WHERE turn = 0) c JOIN documents ON doc_id = conv_id JOIN embeddings ON vec_id = conv_id, q ORDER BY distance, conv_id LIMIT 100), "
    "z AS (SELECT decision_id, row_number() OVER (ORDER BY distance, decision_id) AS r2 FROM v WHERE decision_id IN (SELECT id FROM d WHERE has_headnote = 1)), "
    "f AS (SELECT coalesce(l.decision_id, z.decision_id) AS decision_id, lang, r1, r2, coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) AS score FROM l FULL JOIN z ON l.decision_id = z.decision_id), "
    "g AS (SELECT *, row_number() OVER (ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) AS p FROM f) "
    "SELECT 'hybrid' AS mode, greatest((SELECT count(DISTINCT decision_id) FROM m), (SELECT count(*) FROM f))::BIGINT AS total, (p - 6)::INT AS place, " + _SHOWN.format("coalesce(g.lang, d.language)") + " FROM g JOIN d ON d.id = decision_id WHERE p BETWEEN 6 AND 15"
)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 by words, in one book."""
    found = library(spark, sf_dir, "sections", "section index").search_legal_texts('"rule 7"', source="guidelines", mode="lexical", limit=25)
    return _frame(spark, [(i, r["source"], r["section_id"], r["title"], r["pages"]["from"], r["pages"]["to"]) for i, r in enumerate(found["results"])], "place int, source string, section_id string, title string, page_from int, page_to int")


_P = "WITH p AS (SELECT page_id + 1 AS n, CASE WHEN page_id % 2 = 1 THEN 'clb' ELSE 'gl' END AS source, 'A-' || ((page_id + 1) // 4) AS section_id, url AS title, 'Part > ' || url AS breadcrumb, html || ' see Rule ' || ((page_id + 1) % 11) || ' and Art. 5' AS body FROM pages)"
_SECTION_TOKENS = [_WORDS.format(c) for c in ("section_id", "title", "breadcrumb", "body")]


def _phrases(words: str) -> str:
    """Places of a phrase in each of a section's columns."""
    n = len(words.split())
    return " + ".join(f"len(list_filter(generate_series(1, len({t}) - {n - 1}), lambda i: array_to_string({t}[i : i + {n - 1}], ' ') = '{words}'))" for t in ("a", "b", "c", "e"))


_SECTION_SCORES = _P + (
    f", k AS (SELECT n, source, section_id, title, breadcrumb, {_SECTION_TOKENS[0]} AS a, {_SECTION_TOKENS[1]} AS b, {_SECTION_TOKENS[2]} AS c, {_SECTION_TOKENS[3]} AS e FROM p)"
)
SECTIONS = _SECTION_SCORES + (
    f", h AS (SELECT n, source, section_id, title, len(a) + len(b) + len(c) + len(e) AS size, ({_phrases('rule 7')})::DOUBLE AS f FROM k), s AS (SELECT count(*)::DOUBLE AS r, avg(size) AS mean, count(*) FILTER (f > 0)::DOUBLE AS m FROM h), "
    "g AS (SELECT h.*, row_number() OVER (ORDER BY -(greatest(1e-6, ln((r - m + 0.5) / (m + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), n) - 1 AS place FROM h, s WHERE f > 0 AND source = 'gl') "
    "SELECT place::INT AS place, source, section_id, title, n::INT AS page_from, (n + 1)::INT AS page_to FROM g WHERE place < 25"
)
ASKED = ("T 42/16", "t 0043 / 2016", "ECLI:45", "T 0050/16", "G 9/99")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2: summaries of decisions named in several ways, in French where there is a version; one isn't there."""
    lib, rows = library(spark, sf_dir, "decisions", "texts"), []
    for key in ASKED:
        a = lib.get_decision(key, "summary", "fr")
        rows.append((key, "error" in a, a.get("case_number"), a.get("lang"), a.get("headword"), "|".join(a.get("keywords", [])), "|".join(a.get("ipc", [])), a.get("headnote"), a.get("order"), a.get("decision_date")))
    return _frame(spark, rows, "asked string, error boolean, case_number string, lang string, headword string, keywords string, ipc string, headnote string, orders string, date string")


DECISIONS = _D + """,
a(asked, id) AS (VALUES ('T 42/16', 42), ('t 0043 / 2016', 43), ('ECLI:45', 45), ('T 0050/16', 50), ('G 9/99', -1))
SELECT asked, d.id IS NULL AS error, case_number, CASE WHEN d.id % 5 = 0 THEN 'fr' ELSE language END AS lang, headword, coalesce(replace(keywords, chr(10), '|'), '') AS keywords, CASE WHEN d.id IS NULL THEN '' ELSE 'A61K' || (d.id % 5) || '/00|H04L1/02' END AS ipc,
  CASE WHEN d.id % 5 = 0 THEN '' ELSE note END AS headnote, CASE WHEN d.id % 5 = 0 THEN '' ELSE 'order of ' || board END AS orders, date FROM a LEFT JOIN d ON d.id = a.id
"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3: pages of passages within a budget of characters."""
    lib, rows = library(spark, sf_dir, "decisions", "texts", "passages"), []
    for n, offset in ((3, 0), (3, 2), (8, 1), (1, 50)):
        a = lib.get_passages(f"T {n}/16", "reason", offset=offset, limit=4, max_chars=1200)
        rows += [(n, offset, a["total_chunks"], a["next_offset"], c["seq"], c["chars"], c["text"]) for c in a["chunks"]] or [(n, offset, a["total_chunks"], a["next_offset"], None, None, None)]
    return _frame(spark, rows, "n int, offset int, total int, next_offset int, seq int, chars int, text string")


PASSAGES = """
WITH a(n, o) AS (VALUES (3, 0), (3, 2), (8, 1), (1, 50)),
r AS (SELECT a.*, turn::INT AS seq, length(text)::INT AS chars, text, count(*) OVER (PARTITION BY n, o)::INT AS total, row_number() OVER (PARTITION BY n, o ORDER BY turn) AS p FROM a JOIN conversations ON conv_id = n),
s AS (SELECT *, sum(chars) OVER (PARTITION BY n, o ORDER BY p) AS sofar FROM r WHERE p > o),
k AS (SELECT *, max(p) OVER (PARTITION BY n, o) AS last FROM s WHERE p <= o + 4 AND (p = o + 1 OR sofar <= 1200)),
t AS (SELECT n, o, any_value(total) AS total FROM r GROUP BY n, o)
SELECT t.n::INT AS n, t.o::INT AS "offset", t.total, CASE WHEN last < t.total THEN last END::INT AS next_offset, seq, chars, text FROM t LEFT JOIN k USING (n, o)
"""


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 by words; the words' passages of three decisions."""
    lib, rows = library(spark, sf_dir, "decisions", "texts", "passages"), []
    for n in (3, 5, 8):
        a = lib.search_passages(f"T {n}/16", "The thing of", mode="lexical", limit=5)
        rows += [(n, a["mode"], i, r["seq"], float(r["score"]), r["chars"]) for i, r in enumerate(a["results"])]
    return _frame(spark, rows, "n int, mode string, place int, seq int, score double, chars int")


_TERM = "(length(text) - length(replace(lower(text), '{0}', ''))) // {1}"
PASSAGE_SEARCH = (
    "WITH s AS (SELECT conv_id, turn, length(text)::INT AS chars, (CASE WHEN contains(lower(text), 'the thing of') THEN 10 ELSE 0 END + " + " + ".join(_TERM.format(w, len(w)) for w in ("the", "thing", "of")) + ")::DOUBLE AS score FROM conversations WHERE conv_id IN (3, 5, 8)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) - 1 AS place FROM s WHERE score > 0) "
    "SELECT conv_id::INT AS n, 'lexical' AS mode, place::INT AS place, turn::INT AS seq, score, chars FROM r WHERE place < 5"
)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 both ways; of what a decision cites, a part isn't there."""
    lib, rows = library(spark, sf_dir, "decisions", "references"), []
    for n, direction in ((7, "cites"), (190, "cites"), (3, "cited_by")):
        for r in lib.citations(f"T {n}/16", direction)["results"]:
            rows.append((n, direction, r["case_number"], r.get("in_corpus"), r["ecli"], r["date"], r["board"]))
    return _frame(spark, rows, "n int, direction string, case_number string, in_corpus boolean, ecli string, date string, board string")


CITATIONS = _D + """,
e AS (SELECT id AS citing_id, 'T ' || lpad(c::VARCHAR, greatest(4, len(c::VARCHAR))::INT, '0') || '/16' AS cited FROM (SELECT id, unnest([id % 40, id * 3 + 1]) AS c FROM d)),
b AS (SELECT d.* FROM e JOIN d ON d.id = citing_id WHERE cited = 'T 0003/16' ORDER BY date DESC, d.id LIMIT 50)
SELECT citing_id::INT AS n, 'cites' AS direction, cited AS case_number, d.id IS NOT NULL AS in_corpus, ecli, date, board FROM e LEFT JOIN d ON case_number = cited WHERE citing_id IN (7, 190)
UNION ALL SELECT 3, 'cited_by', case_number, NULL, ecli, date, board FROM b
"""


def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7: sections with their parts and neighbours, named exactly, in another case and by a prefix; one isn't there."""
    lib, rows = library(spark, sf_dir, "sections"), []
    for source, wanted in (("clb", "A-10"), ("guidelines", "a-11"), ("gl", "A-5%")):
        a = lib.get_section(source, wanted)
        near = lambda side: "|".join(x["title"] for x in a.get(side, []))  # noqa: B023, E731
        rows.append((wanted, "error" in a, a.get("section_id"), a.get("pages", {}).get("from"), a.get("pages", {}).get("to"), "|".join(str(p["part"]) for p in a.get("parts", [])), near("previous"), near("next")))
    return _frame(spark, rows, "asked string, error boolean, section_id string, page_from int, page_to int, parts string, previous string, following string")


SECTION = _P + """,
a(asked, source, id) AS (VALUES ('A-10', 'clb', 'A-10'), ('a-11', 'gl', 'A-11'), ('A-5%', 'gl', 'none')),
o AS (SELECT asked, a.source, a.id, min(n) AS lo, max(n) AS hi, string_agg((n % 4)::VARCHAR, '|' ORDER BY n % 4, n) AS parts, arg_min(n, (n % 4, n)) AS first FROM a LEFT JOIN p ON p.source = a.source AND section_id = a.id GROUP BY ALL),
x AS (SELECT asked, title, n, CASE WHEN n < lo THEN 'p' ELSE 'n' END AS side, row_number() OVER (PARTITION BY asked, n < lo ORDER BY abs(n - lo)) AS k FROM o JOIN p ON p.source = o.source AND section_id <> id AND (n < lo OR n > hi))
SELECT asked, lo IS NULL AS error, CASE WHEN lo IS NOT NULL THEN id END AS section_id, first::INT AS page_from, (hi + 1)::INT AS page_to, coalesce(parts, '') AS parts,
  coalesce((SELECT string_agg(title, '|' ORDER BY n) FROM x WHERE x.asked = o.asked AND side = 'p' AND k <= 3), '') AS previous, coalesce((SELECT string_agg(title, '|' ORDER BY n) FROM x WHERE x.asked = o.asked AND side = 'n' AND k <= 3), '') AS following FROM o
"""


def provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8: decisions, the latest, those with most rows, and sections of a provision typed in prose."""
    a = library(spark, sf_dir, "decisions", "references", "sections", "section index").lookup_provision("Rule 1")
    rows = [("count", str(a["decision_count"]), 0)]
    rows += [("recent", r["case_number"], 0) for r in a["recent_decisions"]]
    rows += [("top", r["case_number"], r["provision_row_count"]) for r in a["top_decisions_by_provision_rows"]]
    rows += [("section", f"{r['source']} {r['title']}", i) for i, r in enumerate(a["book_sections"])]
    return _frame(spark, rows, "kind string, value string, n long")


PROVISION = (
    _SECTION_SCORES.replace("WITH p AS", _D.rstrip() + ", p AS", 1)
    + f""",
b AS (SELECT id, unnest([id % 11, id % 3]) AS r FROM d), g AS (SELECT id, count(*) AS k FROM b WHERE r = 1 GROUP BY id),
h AS (SELECT n, source, title, len(a) + len(b) + len(c) + len(e) AS size, ({_phrases('r 1')})::DOUBLE AS f0, ({_phrases('rule 1')})::DOUBLE AS f1 FROM k),
s AS (SELECT count(*)::DOUBLE AS r, avg(size) AS mean, count(*) FILTER (f0 > 0)::DOUBLE AS m0, count(*) FILTER (f1 > 0)::DOUBLE AS m1 FROM h),
z AS (SELECT h.*, row_number() OVER (ORDER BY -({" + ".join(f"greatest(1e-6, ln((r - m{i} + 0.5) / (m{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in (0, 1))}), n) - 1 AS place FROM h, s WHERE f0 > 0 OR f1 > 0)
SELECT 'count' AS kind, count(*)::VARCHAR AS value, 0::BIGINT AS n FROM g
UNION ALL (SELECT 'recent', case_number, 0 FROM g JOIN d USING (id) ORDER BY date DESC, case_number, ecli LIMIT 10)
UNION ALL (SELECT 'top', case_number, k FROM g JOIN d USING (id) ORDER BY CASE WHEN has_headnote = 1 THEN 0 ELSE 1 END, CASE WHEN distribution IN ('A', 'B') THEN 0 ELSE 1 END, k DESC, id LIMIT 5)
UNION ALL SELECT 'section', source || ' ' || title, place FROM z WHERE place < 5
"""
)

QUERIES = {
    "answer_search_lexical": search_lexical, "answer_search_hybrid": search_hybrid, "answer_search_sections": sections, "answer_decision": decisions, "answer_passages": passages,
    "answer_search_passages": passage_search, "answer_citations": citations, "answer_section": section, "answer_provision": provision,
}
SQL = {
    "answer_search_lexical": SEARCH_LEXICAL, "answer_search_hybrid": SEARCH_HYBRID, "answer_search_sections": SECTIONS, "answer_decision": DECISIONS, "answer_passages": PASSAGES,
    "answer_search_passages": PASSAGE_SEARCH, "answer_citations": CITATIONS, "answer_section": SECTION, "answer_provision": PROVISION,
}
