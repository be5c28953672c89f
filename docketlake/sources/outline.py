"""Sections of outlined page text: pages(source, page, text) and outline(source, node_id, parent_id, ord, title, page).

A PDF adapter only has to deliver these two tables; ``pdf.extract`` is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.casenum import strip
from ..functions.chunker import chunks
from ..functions.text import clean_title
from ..operators.ranking import numbered
from ..shared import cut, drop_cut

#: A running header and the bounds of lines and bodies (fixed values).
HEADER, HEADER_LENGTH, SHORT_LINE, LEAST_BODY, TITLE_WORDS = "guidelines for examination in the epo", 120, 2, 40, 8
#: A word broken at a line's end, and lines that are page numbers (fixed values).
BROKEN, PAGE_NUMBER = r"(?U)(\w+)-\s*\n\s*(\w+)", "^[0-9]+$|^[ivxlc]+$|^[IVXLC]+$"
#: Numbers of titles, and the parts and chapters that breadcrumbs name (fixed values).
NUMBER = r"^(\d+(?:\.\d+)*)\.?\s"
ROMAN_PART, LETTER_PART = r"^([IVXLC]+)\.\s", r"^([A-Z])\.\s"
LETTERED, CHAPTER, GENERAL = r"^Part\s+([A-H])\b", r"^Chapter\s+([IVXLC]+)\b", "general part"


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, BROKEN, "$1$2")


def clean_page(text: Column) -> Column:
    """Lines joined again: hyphens at line ends closed, page numbers, headers and stray characters dropped."""
    noise = lambda x: (F.length(x) <= SHORT_LINE) | x.rlike(PAGE_NUMBER) | (F.contains(F.lower(x), F.lit(HEADER)) & (F.length(x) < HEADER_LENGTH))
    lines = F.transform(F.split(join_hyphens(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: ~noise(x)), "\n")


def heading_offset(text: Column, title: Column) -> Column:
    """Where a title's first words begin in a text (from 0, any case and spacing), or -1."""
    parts = F.slice(F.filter(F.split(clean_title(title), " "), lambda w: w != ""), 1, TITLE_WORDS)
    # \Q..\E around each word; an \E inside a word ends and reopens the quote
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(parts, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "\\s+"))
    return F.when(F.size(parts) == 0, -1).otherwise(F.regexp_instr(text, pattern) - 1)


def breadcrumbs(outline: DataFrame) -> DataFrame:
    """source, node_id and the titles from a node's first ancestor to itself, at any depth.

    Each round joins every node's path with that of the node which it ends
    below, so paths double: a depth of d takes log2(d) rounds, each written
    once. A parent that isn't there ends a path; parents in a circle are an error.
    """
    now = cut(outline.select("source", "node_id", F.array(clean_title(F.col("title"))).alias("breadcrumb"), F.col("parent_id").alias("up")))
    most = outline.groupBy("source").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    reach = 1
    while not now.filter("up is not null").isEmpty():
        if reach > most:
            raise ValueError("parents of the outline run in a circle")
        above = now.select(F.col("source").alias("as"), F.col("node_id").alias("aid"), F.col("breadcrumb").alias("before"), F.col("up").alias("aup"))
        # paths compress to a small part of their size in files, so neither side may be taken for small and sent to all tasks
        joined = now.filter("up is not null").join(above.hint("merge"), (F.col("source") == F.col("as")) & (F.col("up") == F.col("aid")), "left")
        longer = joined.select("source", "node_id", F.when(F.col("before").isNull(), F.col("breadcrumb")).otherwise(F.concat("before", "breadcrumb")).alias("breadcrumb"), F.col("aup").alias("up"))
        further = cut(now.filter("up is null").unionByName(longer))  # whole paths stay as they are: without a key to join by, all of them would be one task's
        drop_cut(now)
        now, reach = further, 2 * reach
    return now.drop("up")


def leaves(outline: DataFrame) -> DataFrame:
    """Leaf nodes on a page: source, ord (by page, then outline order), breadcrumb array, title, page."""
    nodes = outline.select("source", "node_id", "parent_id", "ord", "title", "page")
    parents = nodes.select(F.col("source").alias("ps"), F.col("parent_id").alias("pid")).filter("pid is not null").distinct()
    found = nodes.join(parents, (F.col("source") == F.col("ps")) & (F.col("node_id") == F.col("pid")), "left_anti").filter("page > 0")
    place = F.row_number().over(Window.partitionBy("source").orderBy("page", "ord"))
    return found.join(breadcrumbs(nodes), ["source", "node_id"]).select("source", "ord", "title", "page", "breadcrumb", place.alias("place"))


def _number(title: Column) -> Column:
    return F.regexp_extract(title, NUMBER, 1)


def clb_id(crumb: Column) -> Column:
    """``II.A.3.1`` of a breadcrumb that opens with a roman part; null with fewer than two parts."""
    roman = F.regexp_extract(F.get(crumb, F.lit(0)), ROMAN_PART, 1)
    letter = F.coalesce(F.regexp_extract(F.get(crumb, F.lit(1)), LETTER_PART, 1), F.lit(""))
    number = F.when(F.size(crumb) > 2, _number(F.element_at(crumb, -1))).otherwise("")
    parts = F.filter(F.array(roman, letter, number), lambda x: x != "")
    return F.when((roman != "") & (F.size(parts) > 1), F.array_join(parts, "."))


def gl_id(crumb: Column) -> Column:
    """``A-II, 1.1`` or ``Gen, 1.1``: the last part and chapter of the breadcrumb and the leaf's number."""
    named = lambda pattern: lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))
    parts = F.array_compact(F.transform(crumb, lambda x: named(LETTERED)(x).when(F.lower(x).startswith(GENERAL), F.lit("Gen"))))
    chapters = F.array_compact(F.transform(crumb, named(CHAPTER)))
    part, chapter, number = F.try_element_at(parts, F.lit(-1)), F.try_element_at(chapters, F.lit(-1)), _number(F.element_at(crumb, -1))
    return F.when(part.isNotNull() & (number != ""), F.concat_ws(", ", F.concat_ws("-", part, chapter), number))


def suffixed(rows: DataFrame, source: str, key: str, order: str) -> Column:
    """key, key (2), key (3) ... for repeats in a source, ignoring case."""
    n = F.row_number().over(Window.partitionBy(source, F.lower(key)).orderBy(order))
    return F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(" ("), n.cast("string"), F.lit(")")))


def sections(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """book_sections: each leaf's text, from its heading to the next leaf's, over pages.

    Where a heading isn't found on its page the cut is the page's edge; a leaf
    whose successor's heading stands above its own on the same page has no text.
    Bodies under 40 characters are dropped before repeated ids are numbered.
    """
    text = pages.select("source", "page", clean_page(F.col("text")).alias("text"))
    at = leaves(outline).join(text, ["source", "page"], "left").withColumn("offset", F.coalesce(heading_offset(F.col("text"), F.col("title")), F.lit(-1))).drop("text")
    by = Window.partitionBy("source").orderBy("place")
    at = at.withColumn("next_page", F.lead("page").over(by)).withColumn("next_offset", F.lead("offset").over(by))
    ends = text.groupBy("source").agg(F.max("page").alias("last_page"))
    at = at.join(ends, "source").withColumn("begin", F.greatest("offset", F.lit(0)))
    # a next leaf without a found heading takes its whole page, unless that is this leaf's own
    until = F.when(F.col("next_page").isNull(), F.col("last_page")).when((F.col("next_offset") > 0) | (F.col("next_page") == F.col("page")), F.col("next_page")).otherwise(F.col("next_page") - 1)
    at = at.withColumn("page_to", F.greatest("page", until))
    spread = at.withColumn("p", F.explode(F.sequence("page", "page_to")))
    joined = spread.join(text.select(F.col("source").alias("ts"), F.col("page").alias("p2"), "text"), (F.col("source") == F.col("ts")) & (F.col("p") == F.col("p2")))
    start = F.when(F.col("p") == F.col("page"), F.col("begin")).otherwise(0)
    cut_here = (F.col("p") == F.col("next_page")) & (F.col("next_offset") >= 0)
    stop = F.when(cut_here, F.col("next_offset")).otherwise(F.length("text"))
    piece = F.substr(F.col("text"), (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    bodies = joined.groupBy("source", "place", "title", "breadcrumb", "page", "page_to").agg(F.array_sort(F.collect_list(F.struct("p", piece.alias("t")))).alias("parts"))
    body = F.array_join(F.filter(F.transform("parts", lambda x: strip(x["t"])), lambda x: x != ""), "\n")
    made = bodies.withColumn("body", body).filter(F.length("body") >= LEAST_BODY)
    made = cut(made.withColumn("k", F.struct("source", "place")))
    own = F.coalesce(F.when(F.col("source") == "clb", clb_id(F.col("breadcrumb"))).otherwise(gl_id(F.col("breadcrumb"))), clean_title(F.col("title")))
    # ids are numbered on keys alone; bodies are joined to them once
    keys = made.select("k", "source", "place", own.alias("plain_id"))
    keys = numbered(keys.withColumn("section_id", suffixed(keys, "source", "plain_id", "place")).select("k", "section_id"), "k", "id")
    return made.join(keys, "k").select(
        "id", "source", "section_id", clean_title(F.col("title")).alias("title"), F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.col("page").alias("page_from"), "page_to", F.lit(1).alias("part"), "body"
    )


def section_chunks(rows: DataFrame) -> DataFrame:
    """chunks of kind book: the breadcrumb and a blank line before each section's text."""
    pieces = rows.select("id", "breadcrumb", F.posexplode(chunks(F.col("body"))).alias("seq", "piece"))
    return pieces.select(
        F.xxhash64(F.lit("book"), "id", "seq").alias("id"), F.lit("book").alias("kind"), F.lit(None).cast("long").alias("decision_id"), F.col("id").alias("book_section_id"), F.lit("en").alias("lang"),
        "seq", F.concat("breadcrumb", F.lit("\n\n"), "piece").alias("text"), F.lit(None).cast("array<float>").alias("embedding"),
    )


def read_pdf(spark: SparkSession, path: str, source: str, extract: Callable[[bytes], tuple[list[str], list[tuple]]]) -> tuple[DataFrame, DataFrame]:
    """pages and outline of PDF files by an extractor: bytes to (page texts, [(node_id, parent_id, ord, title, page)])."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame([(source, i + 1, t) for i, t in enumerate(extract(content)[0])], columns=["source", "page", "text"])

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame([(source, *n) for n in extract(content)[1]], columns=["source", "node_id", "parent_id", "ord", "title", "page"])

    return files.mapInPandas(pages, "source string, page int, text string"), files.mapInPandas(nodes, "source string, node_id long, parent_id long, ord long, title string, page int")
