"""The engine's questions over a store: search, reading, citations, sections, provisions.

Each answer is composed as one lazy DataFrame and read once; results are pages
of bounded size, returned as dictionaries. Errors are data: {"error": ...}.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legalref
from ..functions.chunker import chunks
from ..functions.text import PARTS, SOURCES, assembled, first_values, passage_score
from ..functions.vectors import dot, literal
from ..jobs import DECISION_INDEX, SECTION_INDEX, chunk_vectors, embedded_chunks, index_rows
from ..operators import lookups
from ..operators.filters import metadata_filters
from ..operators.match import DECISION_WEIGHTS, Or, Phrase, bm25, compile_query
from ..operators.ranking import best_per_key, budget_page, clamp, fallback, fuse, fused_order, knn, pool_size, ranked, top
from ..operators.snippet import snippet
from ..functions.text import tokens_of
from ..segments import exists, searched
from ..shared import cut, drop_cut
from ..store import Store

log = logging.getLogger(__name__)
#: Limits of pages (fixed values).
MOST_RESULTS, MOST_OFFSET, MOST_PASSAGES, PREVIEW, EXCERPT = 25, 1000, 10, (3, 6000), 240
FILTERS = ("board", "type_code", "date_from", "date_to", "language", "ipc_prefix", "only_with_headnote")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Library:
    def __init__(self, store: Store, embed_query: Callable[[str], list[float]] | None = None):
        self.store, self.embed_query = store, embed_query

    # search

    def search_decisions(self, query: str, *, mode: str = "auto", limit: int = 10, offset: int = 0, provision: str | None = None, **filters) -> dict:
        """Decisions by text, and by vectors too where there are any and mode isn't 'lexical'. All that match are counted."""
        unknown = set(filters) - set(FILTERS)
        if unknown:
            raise TypeError(f"unknown filters {sorted(unknown)}")
        if not self.store.is_indexed():
            return {"error": "the store is not indexed"}
        if not query.strip():
            return {"error": "the query is blank"}
        if not 0 <= offset < MOST_OFFSET:
            return {"error": f"offset must be from 0 to {MOST_OFFSET - 1}"}
        limit = clamp(limit, 1, MOST_RESULTS)
        pool, tree = pool_size(offset, limit), compile_query(query)
        decisions, rows = self.store.read("decisions"), index_rows(self.store)
        provisions = self.store.read("decision_provisions")
        wanted = None if provision is None else self.normalised(provision)
        passing = lambda df: metadata_filters(df, **filters, provision=wanted, provisions=provisions, key="decision_id")
        known = decisions.select(F.col("id").alias("decision_id"), "board", "code", "decision_date", "ipc", "has_headnote")
        if tree is None:
            matched = rows.limit(0).select("decision_id", "lang", F.col("id").alias("row_id"), F.lit(0.0).alias("score"))
        else:
            scored = bm25(*searched(self.store, "decision"), tree, DECISION_WEIGHTS)
            texts = self.store.read("decision_texts").select("id", "decision_id", "lang")
            matched = passing(scored.join(texts, F.col("row_id") == F.col("id")).drop("id").join(known, "decision_id")).select("decision_id", "lang", "row_id", "score")
        matched = cut(matched)
        near, used, count = None, "lexical", matched.select("decision_id").distinct().count()
        try:
            vectors = self._decision_vectors(query, mode, pool)
            if vectors is not None:
                own = passing(vectors.join(known, "decision_id").join(decisions.select(F.col("id").alias("decision_id"), F.col("language").alias("lang")), "decision_id"))
                own = best_per_key(own.select("decision_id", "lang", "distance", "chunk_id", "text"), "decision_id", F.col("distance"), F.col("chunk_id"))
                near = cut(top(own, pool, F.col("distance"), F.col("decision_id")))  # at most a pool of rows
        except Exception as e:  # whatever fails there, words still answer
            log.warning("search goes on by words: %s", e)
        # lists that are fused are cut to their pools; words alone are ranked as far as the page goes
        lexical = top(best_per_key(matched, "decision_id", F.col("score"), F.col("row_id")), offset + limit if near is None else pool, F.col("score"), F.col("decision_id"))
        first = ranked(lexical, "decision_id", F.col("score"), F.col("decision_id"))
        if near is not None:
            fused, used = fuse(first, ranked(near, "decision_id", F.col("distance"), F.col("decision_id")), "decision_id"), "hybrid"
            count = max(count, fused.count())
        else:
            fused = fuse(first, first.limit(0), "decision_id")
        page = fused.orderBy(*fused_order()).offset(offset).limit(limit).withColumnRenamed("score", "fused")
        page = cut(page.join(lexical.select("decision_id", "row_id", F.col("lang").alias("text_lang")), "decision_id", "left"))
        ids = page.select("decision_id", "row_id").collect()  # one page, so that only its rows are read from the tables clustered by id
        own = rows.filter(F.col("id").isin([r.row_id for r in ids]) & F.col("decision_id").isin([r.decision_id for r in ids]))
        place = page.join(own.select(F.col("id").alias("row_id"), *[c for c in DECISION_INDEX if c in ("catchwords", "headnote", "facts", "reasons", "orders")]), "row_id", "left")
        heads = decisions.filter(F.col("id").isin([r.decision_id for r in ids]))
        place = place.join(heads.select(F.col("id").alias("decision_id"), "case_number", "ecli", F.col("decision_date").alias("date"), "board", "language", "headword", "keywords", "title"), "decision_id")
        shown = snippet([c for c in DECISION_INDEX], tree) if tree is not None else F.lit("")
        if near is not None:
            place = place.join(near.select("decision_id", F.substring("text", 1, EXCERPT).alias("excerpt")), "decision_id", "left")
        else:
            place = place.withColumn("excerpt", F.lit(None).cast("string"))
        results = place.select(
            "fused", "first_rank", "second_rank", "case_number", "ecli", "date", "board", F.coalesce("text_lang", "language").alias("language"), "headword", first_values(F.col("keywords"), "\n").alias("keywords"),
            F.when(F.col("row_id").isNotNull(), shown).otherwise(F.col("excerpt")).alias("snippet"),
        ).orderBy(F.desc("fused"), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last()).drop("fused", "first_rank", "second_rank")
        out = {"mode": used, "total": count, "total_is_capped": False, "offset": offset, "limit": limit, "results": _rows(results)}
        drop_cut(matched, page, *([near] if near is not None else []))
        return out

    def _vector(self, query: str) -> list[float] | None:
        """The query's vector; None without a model, or where it fails."""
        try:
            return None if self.embed_query is None else self.embed_query("query: " + query)
        except Exception as e:
            log.warning("search goes on by words: %s", e)
            return None

    def _has_vectors(self, kinds: tuple[str, ...]) -> bool:
        return self.embed_query is not None and chunk_vectors(self.store, kinds) is not None

    def _decision_vectors(self, query: str, mode: str, pool: int) -> DataFrame | None:
        """The pool of nearest chunks; those of sections also count, and filters come after."""
        if mode == "lexical" or not self._has_vectors(("essence", "reasons")):
            return None
        vector = self._vector(query)
        if vector is None:
            return None
        near = knn(embedded_chunks(self.store), "id", "embedding", vector, pool)
        return near.filter("decision_id is not null").select("decision_id", "distance", F.col("id").alias("chunk_id"), "text")

    def search_legal_texts(self, query: str, *, source: str = "both", mode: str = "auto", limit: int = 10) -> dict:
        """Sections of books; an unknown source means all."""
        if not query.strip():
            return {"error": "the query is blank"}
        limit, name = clamp(limit, 1, MOST_RESULTS), SOURCES.get(source.lower())
        sections, tree = self.store.read("book_sections"), compile_query(query)
        if name is not None:
            sections = sections.filter(F.col("source") == name)
        ids = sections.select("id")
        if tree is None:
            lexical = ids.limit(0).select("id", F.lit(0.0).alias("score"))
        else:
            scored = bm25(*searched(self.store, "section"), tree).withColumnRenamed("row_id", "id")
            lexical = top(scored.join(ids, "id", "left_semi"), pool_size(0, limit), F.col("score"), F.col("id"))
        first, used = ranked(lexical, "id", F.col("score"), F.col("id")), "lexical"
        second = first.limit(0)
        vector = self._vector(query) if mode != "lexical" and self._has_vectors(("book",)) else None
        if vector is not None:
            near = knn(embedded_chunks(self.store), "id", "embedding", vector, pool_size(0, limit)).filter("book_section_id is not null")
            near = best_per_key(near.select(F.col("book_section_id").alias("section"), "distance", F.col("id").alias("chunk")), "section", F.col("distance"), F.col("chunk")).withColumnRenamed("section", "id").join(ids, "id", "left_semi")
            second, used = ranked(near, "id", F.col("distance"), F.col("id")), "hybrid"
        page = fuse(first, second, "id").orderBy(*fused_order()).limit(limit)
        rows = page.join(sections, "id").withColumn("snippet", snippet(list(SECTION_INDEX), tree) if tree is not None else F.lit("")).orderBy(*fused_order())
        shown = rows.select("source", "section_id", "title", "breadcrumb", F.struct(F.col("page_from").alias("from"), F.col("page_to").alias("to")).alias("pages"), "snippet")
        return {"mode": used, "results": _rows(shown)}

    # reading

    def _decision(self, key: str, lang: str | None):
        found = lookups.resolve_decision(self.store.read("decisions"), key)
        texts = self.store.read("decision_texts").join(found.select(F.col("id").alias("decision_id")), "decision_id", "left_semi")
        decision = found.first()
        return decision, None if decision is None else fallback(texts, "decision_id", lang or "", version_first=True).first()

    def get_decision(self, case_number: str, part: str = "summary", lang: str | None = None) -> dict:
        if part not in ("summary", "facts", "reasons", "order", "full"):
            return {"error": f"unknown part {part}"}
        decision, text = self._decision(case_number, lang)
        if decision is None or text is None:
            return {"error": f"no decision {case_number}"}
        head = {"case_number": decision.case_number, "ecli": decision.ecli, "lang": text.lang}
        if part == "summary":
            keys = ("decision_date", "board", "language", "title", "headword", "oj_reference", "application_number", "available_languages")
            lists = {"keywords": [k for k in (decision.keywords or "").split("\n") if k], "ipc": [k for k in (decision.ipc or "").split(" ") if k]}
            return head | {k: decision[k] for k in keys} | lists | {"headnote": text.headnote, "catchwords": text.catchwords, "order": text.orders}
        if part == "full":
            return head | {"lengths": {c: len(text[c] or "") for c in ("headnote", "catchwords", "facts", "reasons", "orders")}}
        if part == "reasons":
            return head | self._page(self._part_chunks(decision.id, text, "reasons"), 0, *PREVIEW)
        return head | {part: text["orders" if part == "order" else part]}

    def _part_chunks(self, decision_id: int, text, part: str) -> DataFrame:
        """seq, text and embedding: the stored chunks of reasons, else the part split now."""
        own = (F.col("decision_id") == decision_id) & (F.col("kind") == "reasons") & (F.col("lang") == text.lang)
        stored = self.store.read("chunks").filter(own)
        if part == "reasons" and not stored.isEmpty():
            vectors = embedded_chunks(self.store, ("reasons",))
            if vectors is None:
                return stored.select("seq", "text", F.lit(None).cast("array<float>").alias("embedding"))
            return stored.select("id", "seq", "text").join(vectors.filter(own).select("id", "embedding"), "id", "left").drop("id")
        row = self.store.read("decision_texts").filter(F.col("id") == text.id)
        columns = {c: F.col(c) for c in ("headnote", "catchwords", "facts", "reasons", "orders")}
        body = assembled(columns) if part == "full" else columns["orders" if part == "order" else part]
        return row.select(F.posexplode(chunks(body)).alias("seq", "text")).withColumn("embedding", F.lit(None).cast("array<float>"))

    @staticmethod
    def _page(rows: DataFrame, offset: int, limit: int, max_chars: int) -> dict:
        total = rows.count()
        page = _rows(budget_page(rows.withColumn("g", F.lit(0)), ["g"], "seq", "text", offset=offset, limit=limit, max_chars=max_chars).orderBy("seq"))
        return {"total_chunks": total, "next_offset": page[0]["next_offset"] if page else None, "chunks": [{"seq": r["seq"], "chars": len(r["text"]), "text": r["text"]} for r in page]}

    def get_passages(self, case_number: str, part: str = "reasons", lang: str | None = None, *, offset: int = 0, limit: int = 3, max_chars: int = 6000) -> dict:
        name = PARTS.get(part.lower())
        decision, text = self._decision(case_number, lang)
        if name in (None, "summary") or decision is None or text is None:
            return {"error": f"unknown part {part}" if name in (None, "summary") else f"no decision {case_number}"}
        page = self._page(self._part_chunks(decision.id, text, name), offset, clamp(limit, 1, MOST_PASSAGES), clamp(max_chars, 1000, 20000))
        return {"case_number": decision.case_number, "part": name, "lang": text.lang, "offset": offset} | page

    def search_passages(self, case_number: str, query: str, part: str = "reasons", lang: str | None = None, *, mode: str = "auto", limit: int = 5) -> dict:
        """Passages of one decision by words, by vector, or both fused; lists are cut to limit before."""
        name = PARTS.get(part.lower())
        decision, text = self._decision(case_number, lang)
        if name in (None, "summary") or decision is None or text is None or not query.strip():
            return {"error": "the query is blank" if not query.strip() else f"no such decision or part: {case_number}, {part}"}
        limit, rows = clamp(limit, 1, MOST_PASSAGES), self._part_chunks(decision.id, text, name)
        lexical = top(rows.withColumn("score", passage_score(F.col("text"), query).cast("double")).filter("score > 0"), limit, F.desc("score"), F.col("seq"))
        with_vectors = rows.filter("embedding is not null")
        vector = self._vector(query) if mode != "lexical" and self.embed_query is not None and not with_vectors.isEmpty() else None
        has = vector is not None
        near = top(with_vectors.withColumn("score", dot(F.col("embedding"), literal(vector))), limit, F.desc("score"), F.col("seq")) if has else None
        if mode == "vector":
            used, found = ("vector", near) if has else ("vector_unavailable", lexical.limit(0))
        elif mode in ("hybrid", "auto") and has:
            fused = fuse(ranked(lexical, "seq", F.desc("score"), F.col("seq")), ranked(near, "seq", F.desc("score"), F.col("seq")), "seq").orderBy(F.desc("score"), "seq").limit(limit)
            used, found = "hybrid", fused.join(rows.select("seq", "text"), "seq")
        else:
            used, found = "lexical", lexical
        shown = found.select("seq", "score", F.length("text").alias("chars"), "text").orderBy(F.desc("score"), "seq")
        return {"case_number": decision.case_number, "part": name, "lang": text.lang, "mode": used, "results": _rows(shown)}

    # graph, sections, provisions

    def citations(self, case_number: str, direction: str = "cites") -> dict:
        decision = lookups.resolve_decision(self.store.read("decisions"), case_number).first()
        if decision is None:
            return {"error": f"no decision {case_number}"}
        edges, decisions = self.store.read("decision_citations"), self.store.read("decisions")
        shown = decisions.select("id", "case_number", "ecli", F.col("decision_date").alias("date"), "board", "headword")
        if direction == "cited_by":
            rows = lookups.cited_by(edges, shown, "citing_id", "cited_case_number", decision.case_number, "id", "date").select("case_number", "ecli", "date", "board", "headword")
            return {"case_number": decision.case_number, "direction": "cited_by", "results": _rows(rows)}
        own = edges.filter(F.col("citing_id") == decision.id)
        rows = lookups.cites(own, shown.withColumn("order", F.col("id")), "citing_id", "cited_case_number", "case_number", "order")
        return {"case_number": decision.case_number, "direction": "cites", "results": _rows(rows.select(F.col("cited_case_number").alias("case_number"), "in_corpus", "ecli", "date", "board", "headword"))}

    def get_section(self, source: str, section_id: str) -> dict:
        name, sections = SOURCES.get(source.lower(), source), self.store.read("book_sections")
        found = lookups.resolve_section(sections, name, section_id).first()
        if found is None:
            return {"error": f"no section {section_id} in {source}"}
        rows = sections.filter((F.col("source") == name) & (F.col("section_id") == found.section_id)).orderBy("part", "id").collect()
        near = lookups.neighbours(sections, name, found.section_id).orderBy("id").collect()
        side = lambda d: [{"section_id": r.section_id, "title": r.title} for r in near if r.direction == d]
        return {
            "source": name, "section_id": found.section_id, "title": rows[0].title, "breadcrumb": rows[0].breadcrumb, "pages": {"from": rows[0].page_from, "to": max(r.page_to for r in rows)},
            "parts": [{"part": r.part, "body": r.body} for r in rows], "previous": side("previous"), "next": side("next"),
        }

    def normalised(self, provision: str) -> str:
        """A typed provision in canonical form."""
        return self.store.spark.range(1).select(legalref.normalise_typed(F.lit(provision))).first()[0]

    def lookup_provision(self, provision: str) -> dict:
        wanted = self.normalised(provision)
        bag, decisions = self.store.read("decision_provisions"), self.store.read("decisions")
        shown = ["case_number", "ecli", "decision_date", "board", "headword"]
        recent = lookups.recent_with_provision(bag, decisions, wanted, column="provision", key="decision_id", id="id", date="decision_date", shown=shown)
        first = [F.when(F.col("has_headnote") == 1, 0).otherwise(1), F.when(F.col("distribution").isin("A", "B"), 0).otherwise(1)]
        best = lookups.top_with_provision(bag, decisions, wanted, column="provision", key="decision_id", id="id", priority=first, shown=shown)
        out = {
            "provision": wanted, "decision_count": lookups.provision_count(bag, wanted).first()[0], "recent_decisions": _rows(recent),
            "top_decisions_by_provision_rows": _rows(best), "book_sections": [],
        }
        if exists(self.store, "section"):
            variants = self.store.spark.range(1).select(legalref.prose_variants(F.lit(wanted))).first()[0]
            phrases = [Phrase(t) for t in (tuple(tokens_of(v)) for v in variants) if t]
            if phrases:
                tree = Or(tuple(phrases)) if len(phrases) > 1 else phrases[0]
                scored = top(bm25(*searched(self.store, "section"), tree), 5, F.col("score"), F.col("row_id"))
                rows = scored.join(self.store.read("book_sections"), F.col("row_id") == F.col("id")).orderBy("score", "row_id").select("source", "section_id", "title", "breadcrumb")
                out["book_sections"] = _rows(rows)
        return out


def to_json(answer: dict) -> str:
    return json.dumps(answer, ensure_ascii=False)
