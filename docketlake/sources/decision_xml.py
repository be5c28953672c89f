"""Decisions from XML: documents, and the five tables derived from them.

The reader takes every field as text; section bodies and the few multi-valued
fields are read from a document's own XML in an Arrow-batched function, since
mixed content can't be expressed by a schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import casenum, legalref
from ..functions.chunker import chunks
from ..functions.text import essence, ipc_code, iso_date, journal_reference
from ..operators.ranking import numbered
from ..shared import cut, file_system
from .pieces import OPAQUE, documents

ROW_TAG = "ep-appeal-decision"
CLOSING = f"</{ROW_TAG}>"
#: Comments, CDATA sections and instructions, whole or open, and a document's opening tag.
OPENING = re.compile("|".join([*(f"{re.escape(o)}(?:.*?{re.escape(e)})?" for o, e in OPAQUE.items()), rf"<{ROW_TAG}(?=[\s/>])"]), re.DOTALL)
#: Section elements by the column of their body (fixed values).
BODIES = {"headnote": "ep-headnote", "catchwords": "ep-catchword", "facts": "ep-summary-of-facts", "reasons": "ep-reasons-for-decision", "orders": "ep-appeal-order"}

DOCUMENT = (
    "lang string, procedure_lang string, ecli string, volume string, code string, appeal_num string, year string, board string, date string, distribution string, title string, "
    "application_number string, ipc string, headword string, keywords string, oj_reference string, any_headnote boolean, "
    + ", ".join(f"{c} string" for c in BODIES)
    + ", legal_refs array<string>, cited array<struct<code:string,num:string,year:string>>"
)

#: Types of a document's fields in Arrow, of those that aren't text.
ARROW = {"boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "cited_type": pa.list_(pa.struct({"code": pa.string(), "num": pa.string(), "year": pa.string()}))}


def _local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :]


def _by_name(element) -> dict[str, list]:
    """What stands inside an element, in order, by local name: one walk, however many names are asked for."""
    found: dict[str, list] = {}
    inside = element.iter()
    next(inside)  # the element itself
    for e in inside:
        found.setdefault(_local(e.tag), []).append(e)
    return found


def read_document(xml: str, keep_inline: bool = False) -> dict:
    """The fields of one document."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(xml)
    every, sections = _by_name(root), {_local(e.tag): e for e in reversed(root)}
    text = lambda e: None if e is None else "".join(e.itertext()).strip()

    def first(name: str, among=every):
        return next(iter(among.get(name, ())), None)

    def body(name: str) -> str:
        section = sections.get(name)
        if section is None:
            return ""
        own = lambda p: "".join(p.itertext()) if keep_inline else (p.text or "") + "".join(c.tail or "" for c in p)
        parts = [own(p).strip() for p in section.iter() if _local(p.tag) == "p"]
        return "\n\n".join(p for p in parts if p) or text(section)

    bib = first("ep-appeal-bib-data")
    inner = {} if bib is None else _by_name(bib)
    of = lambda name, among=inner: text(first(name, among))
    case = first("ep-case-num", inner)
    decided = first("ep-date-of-decision", inner)
    application, journal = first("application-reference", inner), first("ep-official-journal", inner)
    codes = []
    for c in inner.get("classification-ipcr", ()):
        within = _by_name(c)
        codes.append(ipc_code(*[of(k, within) for k in ("section", "class", "subclass", "main-group", "subgroup")]))
    within = {} if journal is None else _by_name(journal)
    number = of("ep-official-journal-num", within)
    cited = []
    for c in every.get("ep-cited-decision", ()):
        inside = _by_name(c)
        other = first("ep-case-num", inside)
        cited.append({"code": c.get("code") or (other.get("code") if other is not None else None), "num": of("ep-appeal-num", inside), "year": of("ep-year", inside)})
    procedure = root.get("procedure-lang") or root.get("lang") or "en"
    return {
        "lang": root.get("lang") or procedure, "procedure_lang": procedure, "ecli": of("ep-ecli") or None, "volume": bib.get("volume") if bib is not None else None,
        "code": (case.get("code") if case is not None else None) or "T", "appeal_num": of("ep-appeal-num") or "0000", "year": of("ep-year"), "board": of("ep-board-of-appeal-code"),
        "date": of("date", _by_name(decided)) if decided is not None else of("date"), "distribution": of("ep-distribution-code"), "title": of("invention-title"),
        "application_number": of("doc-number", _by_name(application)) if application is not None else None, "ipc": " ".join(filter(None, codes)), "headword": of("ep-headword", every),
        "keywords": "\n".join(k for k in (text(e) for e in every.get("keyword", ())) if k),
        "oj_reference": journal_reference(number, of("ep-year", within)),
        "any_headnote": any(text(e) for e in every.get("ep-headnote", ())), **{c: body(n) for c, n in BODIES.items()},
        "legal_refs": ["".join(e.itertext()) for e in every.get("ep-legal-ref-presentation", ())], "cited": cited,
    }


def _element(piece: str) -> str | None:
    """The element of a piece of a file that ends before its close tag; None after the last one."""
    start = None
    for m in OPENING.finditer(piece):
        if m[0] in OPAQUE:
            raise ValueError("a comment, a CDATA section or an instruction is not closed")
        if start is None and not m[0].startswith(("<!", "<?")):
            start = m.start()
    return None if start is None else piece[start:] + CLOSING


def scan(spark: SparkSession, path: str, keep_inline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """One row a document: ord (file, place in it) and its fields.

    A file of any size is dealt to as many tasks as it has splits, and a
    document is the largest value, see pieces.py. ord follows the order of the
    documents in their files. Tags inside comments, CDATA sections and
    instructions are none, wherever a file is split; one of these that is never
    closed is an error. The files' texts lie in the shared folder until
    drop_cut() of the result.
    """
    pieces = documents(spark, path, CLOSING[:-1], encoding)
    docs = pieces.filter(F.contains("value", F.lit("<" + ROW_TAG)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements = [_element(x) for x in b.column("value").to_pylist()]
            read = [read_document(x, keep_inline) for x in elements if x is not None]
            there = pa.array([x is not None for x in elements])
            held = {c: b.column(c).filter(there) for c in ("path", "block", "place")}
            held |= {c: pa.array([d[c] for d in read], ARROW.get(kind, pa.string())) for c, kind in (x.split() for x in _columns())}
            yield pa.RecordBatch.from_arrays(list(held.values()), list(held))

    rows = docs.select("path", "block", "place", "value").mapInArrow(parse, "path string, block long, place long, " + DOCUMENT)
    out = rows.select(F.struct("path", "block", "place").alias("ord"), *[c.split()[0] for c in _columns()])
    out._docketlake_path = pieces._docketlake_path
    return out


def _columns() -> list[str]:
    return [c for c in DOCUMENT.replace("array<struct<code:string,num:string,year:string>>", "cited_type").split(", ")]


def first_per_key(docs: DataFrame) -> DataFrame:
    """ord, ecli and lang of documents with a key: whether each comes first for its key, and first for its language. No texts are moved for it."""
    keyed = docs.filter("ecli is not null").select("ord", "ecli", "lang")
    by_key, by_lang = Window.partitionBy("ecli"), Window.partitionBy("ecli", "lang")
    return keyed.withColumns({"is_first": F.row_number().over(by_key.orderBy("ord")) == 1, "first_text": F.row_number().over(by_lang.orderBy("ord")) == 1})


def merged_fields(rows: DataFrame) -> DataFrame:
    """What all documents of a key say together: originals override headword (even by an empty one), keywords (if not empty) and has_headnote (only to 1)."""
    original = F.col("is_original") == 1
    return rows.groupBy("ecli").agg(
        F.max_by("headword", F.when(original & F.col("headword").isNotNull(), F.col("ord"))).alias("new_headword"),
        F.max_by("keywords", F.when(original & (F.col("keywords") != ""), F.col("ord"))).alias("new_keywords"),
        F.max(F.when(original & (F.col("headnote") != ""), 1)).alias("new_headnote"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "lang"))), lambda x: x["lang"])), ",").alias("new_languages"),
    )


def tables(docs: DataFrame, held: DataFrame | None = None, last_id: int = 0, last_text_id: int = 0) -> dict[str, DataFrame]:
    """decisions, decision_texts, decision_provisions, decision_citations, chunks and keys of scanned documents.

    A key's first document gives its metadata, provisions and citations; later
    ones add their language and override fields, see merged_fields(). held:
    (ecli, decision_id) of keys that are there already; these get no decision
    again, but ``updates``, by which updated() changes theirs. New ids follow
    the last ones given. Keys compress so well that their files' size says little
    of their rows, so none of the joins sends a side to all tasks.
    """
    rows = cut(first_per_key(docs))
    docs = docs.filter("ecli is not null").withColumn("is_original", (F.lower("lang") == F.lower("procedure_lang")).cast("int"))
    original = F.col("is_original") == 1
    merged = merged_fields(docs)
    year = F.coalesce(F.when(F.trim("year").rlike("^[+-]?[0-9]{1,9}$"), F.trim("year").cast("int")), F.lit(0))
    first_rows = rows.filter("is_first") if held is None else rows.filter("is_first").join(held.select("ecli").hint("merge"), "ecli", "left_anti")
    # ids follow the order of documents; only keys are sorted for that, and texts are joined to them by hashing
    ids = numbered(first_rows.select("ecli", "ord"), "ord", "id").select("ord", "ecli", (F.col("id") + last_id).alias("id"))
    owned = docs.drop("ecli").join(ids.withColumnRenamed("id", "decision_id").hint("shuffle_hash"), "ord")
    first = owned.withColumnRenamed("decision_id", "id").join(merged.hint("merge"), "ecli")
    decisions = first.select(
        "id", casenum.format_case(F.col("code"), F.col("appeal_num"), year).alias("case_number"), "code", "appeal_num", year.alias("year"), "ecli", "board", iso_date(F.col("date")).alias("decision_date"),
        F.col("procedure_lang").alias("language"), "distribution", "title", "application_number", "ipc", F.coalesce("new_headword", "headword").alias("headword"), F.coalesce("new_keywords", "keywords").alias("keywords"),
        "oj_reference", F.greatest(F.col("any_headnote").cast("int"), F.coalesce("new_headnote", F.lit(0))).alias("has_headnote"), F.col("new_languages").alias("available_languages"),
    )
    new_owners = ids.select("ecli", F.col("id").alias("decision_id"))
    owners = new_owners if held is None else new_owners.unionByName(held)
    kept = rows.filter("first_text").select("ord", "ecli", "lang").join(owners.hint("merge"), "ecli")
    text_ids = numbered(kept, "ord", "id").withColumn("id", F.col("id") + last_text_id)
    texts = docs.drop("ecli", "lang").join(text_ids.hint("shuffle_hash"), "ord")
    bodies = texts.select("id", "decision_id", "lang", "is_original", *BODIES)
    raw = owned.select("decision_id", F.explode("legal_refs").alias("raw"))
    provisions = raw.select("decision_id", legalref.normalise_raw(F.col("raw")).alias("provision"), casenum.strip(F.col("raw")).alias("raw")).filter("provision <> ''")
    cite = owned.select("decision_id", F.explode("cited").alias("c")).filter("c.code is not null and c.num is not null and c.year rlike '^ *[+-]?[0-9]{1,9} *$'")
    citations = cite.select(F.col("decision_id").alias("citing_id"), casenum.format_case(F.col("c.code"), F.col("c.num"), F.trim("c.year").cast("int")).alias("cited_case_number"))
    originals = texts.filter(original).select("decision_id", "lang", essence(F.col("headword"), F.col("keywords"), F.col("catchwords"), F.col("headnote")).alias("essence"), "reasons")
    parts = originals.select("decision_id", "lang", F.explode(F.array(F.struct(F.lit("essence").alias("kind"), F.col("essence").alias("body")), F.struct(F.lit("reasons").alias("kind"), F.col("reasons").alias("body")))).alias("p"))
    pieces = parts.select("p.kind", "decision_id", F.lit(None).cast("long").alias("book_section_id"), "lang", F.posexplode(chunks(F.col("p.body"))).alias("seq", "text"))
    chunk_rows = pieces.select(F.xxhash64("kind", "decision_id", "lang", "seq").alias("id"), "*", F.lit(None).cast("array<float>").alias("embedding"))
    made = {"decisions": decisions, "decision_texts": bodies, "decision_provisions": provisions, "decision_citations": citations, "chunks": chunk_rows, "keys": text_ids.select("ecli", "lang", "decision_id")}
    return made if held is None else made | {"updates": held.join(merged.hint("merge"), "ecli").withColumnRenamed("decision_id", "id").drop("ecli")}


def updated(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """decisions with what later documents of their keys say."""
    both = decisions.join(updates.hint("merge"), "id", "left")
    change = {
        "headword": F.coalesce("new_headword", "headword"), "keywords": F.coalesce("new_keywords", "keywords"), "has_headnote": F.greatest("has_headnote", "new_headnote"),
        "available_languages": F.when(F.col("new_languages").isNull(), F.col("available_languages")).otherwise(F.array_join(F.array_union(F.split("available_languages", ","), F.split("new_languages", ",")), ",")),
    }
    return both.select(*[change[c].alias(c) if c in change else F.col(c) for c in decisions.columns])


def newest_source(spark: SparkSession, folder: str, pattern: str = "EPDecisions_*.xml", parents: bool = True) -> str | None:
    """The latest matching file of a folder by time, then by name; without one there, of the nearest parent that has one."""
    p, fs = file_system(spark, folder)
    p = fs.makeQualified(p)
    while p is not None:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, pattern))
        if found:
            return str(max(found, key=lambda f: (f.getModificationTime(), f.getPath().getName().lower())).getPath())
        p = p.getParent() if parents else None
    return None


def facts() -> list[Column]:
    """Aggregates of scanned documents that a job stores: their number, and the volume of the first."""
    return [F.count(F.lit(1)).alias("documents_parsed"), F.min_by("volume", F.when(F.col("volume").isNotNull(), F.col("ord"))).alias("volume")]
