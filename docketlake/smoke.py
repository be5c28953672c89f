"""Checks of a store that should answer: what is asked is taken from the store itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.library import MOST_OFFSET, Library


def smoke(library: Library) -> list[str]:
    """The checks that failed."""
    store, failed = library.store, []

    def check(name: str, passed: bool) -> None:
        if not passed:
            failed.append(name)

    if not store.is_indexed():
        return ["the store is indexed"]
    decision = store.read("decisions").orderBy("id").first()
    if decision is None:
        return ["the store holds a decision"]
    case = decision.case_number
    by_case = library.search_decisions(case, mode="lexical", limit=5)
    check("results have snippets", all(r["snippet"] for r in by_case["results"]) and bool(by_case["results"]))
    inline = library.search_decisions(f"admissibility of appeal {case}", mode="lexical", limit=3)["results"]
    check("a case number inside a query comes first", bool(inline) and inline[0]["case_number"] == case)
    if by_case["total"] > 1:
        check("a second page has results", bool(library.search_decisions(case, mode="lexical", limit=1, offset=1)["results"]))
    check("a blank query is an error", "error" in library.search_decisions(" ", mode="hybrid"))
    check("an offset beyond the pool is an error", "error" in library.search_decisions(case, offset=MOST_OFFSET))
    other = library.search_decisions(case, mode="lexical", language=decision.language)["results"]
    check("a language filter holds", all(r["language"] == decision.language for r in other))
    check("a decision can be read", "error" not in library.get_decision(case))
    check("another language falls back", "error" not in library.get_decision(case, "summary", "xx"))
    preview = library.get_decision(case, "reasons")
    check("reasons come as a preview", "chunks" in preview and "next_offset" in preview)
    page = library.get_passages(case, "reasons", limit=1)
    check("passages come in pages", page.get("total_chunks", 0) == 0 or len(page["chunks"]) == 1)
    if page.get("chunks"):
        word = max(page["chunks"][0]["text"].split(), key=len)
        check("a word of a passage finds it", bool(library.search_passages(case, word, mode="lexical")["results"]))
    provision = store.read("decision_provisions").agg(F.min("provision")).first()[0]
    if provision is not None:
        check("a provision has decisions", library.lookup_provision(provision)["decision_count"] > 0)
    if store.exists("book_sections"):
        section = store.read("book_sections").orderBy("id").first()
        check("a blank question to the books is an error", "error" in library.search_legal_texts(" "))
        if section is not None:
            check("a section can be read", "error" not in library.get_section(section.source, section.section_id))
            check("a title finds sections", bool(library.search_legal_texts(section.title, mode="lexical")["results"]))
            check("wildcards are plain text", "error" in library.get_section(section.source, "A_II%"))
    if library.embed_query is not None:
        near, far = (_cosine(library.embed_query("query: " + case), library.embed_query("passage: " + t)) for t in (case, "the restaurant serves pasta on Tuesdays"))
        check("vectors tell texts apart", near - far >= 0.03)
        check("hybrid search answers", "error" not in library.search_decisions(case, mode="hybrid", limit=5))
    return failed


def _cosine(a: list[float], b: list[float]) -> float:
    norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0
