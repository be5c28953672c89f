"""Tokens, passages' scores, and small text fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .casenum import strip

#: Section titles of an assembled document, by text column (fixed values).
SECTION_TITLES = {"headnote": "HEADNOTE", "catchwords": "CATCHWORDS", "facts": "FACTS AND SUBMISSIONS", "reasons": "REASONS", "orders": "ORDER"}
PARTS = {"fact": "facts", "facts": "facts", "reason": "reasons", "reasons": "reasons", "order": "order", "orders": "order", "headnote": "headnote", "headnotes": "headnote", "catchword": "catchwords", "catchwords": "catchwords", "summary": "summary", "full": "full"}
SOURCES = {"case_law_book": "clb", "clb": "clb", "guidelines": "gl", "gl": "gl"}


def _base_letters() -> tuple[str, str]:
    """Letters with diacritics of the basic plane and their base letters, from Unicode's decompositions."""
    found = {}
    for i in range(0xC0, 0x2000):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.combining(x) for x in base[1:]):
            found[c] = base[0]
    return "".join(found), "".join(found.values())


_FROM, _TO = _base_letters()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{M}", "")


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of the folded text."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def tokens_in(text: Column) -> Column:
    """How many tokens() a text has: removing diacritics neither parts nor joins runs of letters, so they are counted without it."""
    return F.size(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0)), F.array().cast("array<string>")))


def tokens_of(text: str) -> list[str]:
    """tokens() of a Python string, for queries."""
    import regex

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return regex.findall(r"[\p{L}\p{N}]+", plain)


def query_terms(text: Column) -> Column:
    """Distinct terms of a passage query: runs of letters or digits of two characters or more, in order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: F.length(x) > 1))


def passage_score(text: Column, query: str) -> Column:
    """10 if the text contains the whole query, plus the number of times each term occurs in it."""
    import regex

    t, whole = F.lower(text), query.strip().lower()
    terms = list(dict.fromkeys(w for w in regex.findall(r"[\p{L}\p{Nd}]+", whole) if len(w) > 1))
    score = F.when(F.contains(t, F.lit(whole)), 10).otherwise(0) if whole else F.lit(0)
    for w in terms:
        score += ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return score.cast("long")


def present(text: Column) -> Column:
    """The text itself, null where it is blank."""
    return F.when(text.rlike(r"\S"), text)


def essence(headword: Column, keywords: Column, catchwords: Column, headnote: Column) -> Column:
    return F.concat_ws("\n\n", *[present(x) for x in (headword, keywords, catchwords, headnote)])


def assembled(columns: dict[str, Column]) -> Column:
    """The sections that aren't blank, each under its title."""
    return F.concat_ws("\n\n", *[F.when(columns[c].rlike(r"\S"), F.concat(F.lit(title + "\n\n"), columns[c])) for c, title in SECTION_TITLES.items() if c in columns])


def iso_date(digits: Column) -> Column:
    """yyyy-MM-dd of eight digits that are a date, else null."""
    t = strip(digits)
    return F.when(t.rlike("^[0-9]{8}$"), F.date_format(F.try_to_date(t, "yyyyMMdd"), "yyyy-MM-dd"))


def ipc_code(section: str | None, cls: str | None, subclass: str | None, main: str | None, sub: str | None) -> str:
    """A class of the classification; empty without a section."""
    return f"{section}{cls or ''}{subclass or ''}{main or ''}/{sub or ''}" if section else ""


def journal_reference(number: str | None, year: str | None) -> str | None:
    return None if number is None else f"OJ EPO {year or ''} {number}"


def clean_title(title: Column) -> Column:
    return F.regexp_replace(strip(title), r"\s+", " ")


def first_values(joined: Column, sep: str, n: int = 3) -> Column:
    """The first n values of a joined field that aren't empty."""
    return F.slice(F.filter(F.split(joined, sep), lambda x: x != ""), 1, n)


def ordered_join(order: Column, value: Column, sep: str) -> Column:
    """Aggregate: values joined in the order given."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def fold_any(text: Column) -> Column:
    """fold() for scripts beyond the table, by full decomposition."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)))

    return run(text)
