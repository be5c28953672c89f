"""Match expressions: phrases, prefixes, columns, AND, OR; evaluation and BM25.

A query compiles to a small tree. All its phrases are looked up in one pass over
the postings of its terms, and one aggregation per row gives each phrase's
weighted hits; the tree is then a plain Boolean expression over them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casenum import INLINE, WHOLE
from ..functions.text import tokens_of

#: Weights of the columns of decisions in ranking (fixed values).
DECISION_WEIGHTS = {"case_number": 10.0, "headword": 8.0, "keywords": 8.0, "catchwords": 8.0, "headnote": 8.0, "title": 4.0, "facts": 1.0, "reasons": 2.0, "orders": 1.0}
#: Parameters of BM25 and the least inverse document frequency (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Least length of a word that also matches as a prefix (fixed value).
PREFIX_LENGTH = 4


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None

    def to_match_string(self) -> str:
        text = '"' + " ".join(self.tokens).replace('"', '""') + '"' + "*" * self.prefix
        return f"{self.column} : {text}" if self.column else text


@dataclass(frozen=True)
class And:
    items: tuple

    def to_match_string(self) -> str:
        return " ".join(f"({x.to_match_string()})" if isinstance(x, Or) else x.to_match_string() for x in self.items)


@dataclass(frozen=True)
class Or:
    items: tuple

    def to_match_string(self) -> str:
        return " OR ".join(f"({x.to_match_string()})" if isinstance(x, (Or, And)) else x.to_match_string() for x in self.items)


def canonical_case(text: str) -> str | None:
    m = re.match(WHOLE.replace("(?iu)", "(?i)"), text.strip())
    return f"{m[1].upper()} {m[2].zfill(4)}/{int(m[3]) % 100:02d}" if m else None


def compile_query(text: str):
    """The tree of a user's query, or None if nothing in it can match."""
    text = text.strip()
    case = canonical_case(text)
    if case:
        return Phrase(tuple(tokens_of(case)), column="case_number")
    if len(text) > 1 and text[0] == text[-1] == '"':
        inside = tuple(tokens_of(text))
        return Phrase(inside) if inside else None
    inline = re.compile(INLINE.replace("(?iu)", "(?i)"))
    cases = [tuple(tokens_of(c)) for c in filter(None, (canonical_case(m[0]) for m in inline.finditer(text)))]
    rest = inline.sub(" ", text) if cases else text
    terms = [Phrase(t, prefix=len(w) >= PREFIX_LENGTH) for w in rest.split() if (t := tuple(tokens_of(w)))]
    words = [And(tuple(terms))] if len(terms) > 1 else terms
    either = [*words, *[Or((Phrase(c), Phrase(c, column="case_number"))) for c in cases]]
    return None if not either else either[0] if len(either) == 1 else Or(tuple(either))


def phrases_of(tree) -> list[Phrase]:
    """The distinct phrases of a tree, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(p for x in tree.items for p in phrases_of(x)))


def condition(tree, phrases: list[Phrase]) -> Column:
    """Whether the hits f0, f1, ... satisfy the tree."""
    if isinstance(tree, Phrase):
        return F.col(f"f{phrases.index(tree)}") > 0
    parts = [condition(x, phrases) for x in tree.items]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(tree, And) else out | p
    return out


def phrase_hits(index: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """row_id, n_tokens, col, phrase, places: where phrases occur; a column of a row may have several rows, to be added up.

    A phrase's terms vote for the position where it would begin; it occurs
    where all of them vote. Where all phrases are single terms their
    frequencies tell, and no positions are read.
    """
    wanted, votes = F.lit(False), []
    for p, phrase in enumerate(phrases):
        for i, token in enumerate(phrase.tokens):
            last = i == len(phrase.tokens) - 1
            fits = F.col("term").startswith(token) if phrase.prefix and last else F.col("term") == token
            fits = fits & (F.col("col") == phrase.column) if phrase.column else fits
            wanted |= fits
            votes.append(F.when(fits, F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("i"), F.lit(len(phrase.tokens)).alias("n"))))
    single = all(len(p.tokens) == 1 for p in phrases)
    found = index.filter(wanted & F.col("row_id").isNotNull()).select("row_id", "n_tokens", "col", "tf" if single else "positions", F.explode(F.array_compact(F.array(*votes))).alias("v"))
    if single:
        return found.select("row_id", "n_tokens", "col", F.col("v.phrase").alias("phrase"), F.col("tf").alias("places"))
    found = found.select("row_id", "n_tokens", "col", "v", F.explode("positions").alias("pos"))
    starts = found.select("row_id", "n_tokens", "col", F.col("v.phrase").alias("phrase"), (F.col("pos") - F.col("v.i")).alias("start"), F.col("v.n").alias("n"))
    # a place holds one term, so each of a phrase's places votes once for a start
    whole = starts.groupBy("row_id", "col", "phrase", "start", "n").agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("k"))
    return whole.filter("k = n").select("row_id", "n_tokens", "col", "phrase", F.lit(1).alias("places"))


def matches(index: DataFrame, tree, weights: Mapping[str, float] | None = None) -> DataFrame:
    """row_id, n_tokens and the weighted hits f0, f1, ... of each phrase, for the rows that have any."""
    phrases, weight = phrases_of(tree), weight_of(weights)
    hits = phrase_hits(index, phrases)
    sums = [F.coalesce(F.sum(F.when(F.col("phrase") == i, weight * F.col("places"))), F.lit(0.0)).alias(f"f{i}") for i in range(len(phrases))]
    return hits.groupBy("row_id").agg(F.max("n_tokens").alias("n_tokens"), *sums)


def weight_of(weights: Mapping[str, float] | None) -> Column:
    """The weight of the column that a posting is of; columns without one weigh nothing."""
    if weights is None:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))])
    return F.coalesce(F.try_element_at(table, F.col("col")), F.lit(0.0))


def matching_rows(index: DataFrame, tree) -> DataFrame:
    return matches(index, tree).filter(condition(tree, phrases_of(tree))).select("row_id")


def relevance(figures: Sequence[tuple[Column, Column, Column]], rows: Column, mean: Column) -> Column:
    """The sum over phrases, given as (rows that have it, weighted hits, tokens of the row): grows with hits, falls with tokens."""
    score = F.lit(0.0)
    for n, f, n_tokens in figures:
        idf = F.greatest(F.lit(LEAST_IDF), F.log((rows - n + 0.5) / (n + 0.5)))
        score += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n_tokens / mean))
    return score


def bm25(index: DataFrame, shape: DataFrame, tree, weights: Mapping[str, float] | None = None) -> DataFrame:
    """row_id and score (lower is better) of the rows that the tree matches; all phrases count.

    shape: rows and tokens of the whole index, one row. Postings are read once:
    the counts ask for the same columns as the scores, so Spark reuses the
    exchange by row.
    """
    phrases = phrases_of(tree)
    hits = matches(index, tree, weights)
    counts = hits.agg(*[F.count(F.when((F.col(f"f{i}") > 0) & F.col("n_tokens").isNotNull(), 1)).cast("double").alias(f"n{i}") for i in range(len(phrases))])
    whole = shape.select(F.col("rows").cast("double").alias("rows"), (F.col("tokens") / F.col("rows")).alias("mean"))
    facts = F.broadcast(whole.join(F.broadcast(counts)))  # one row of figures
    rows = hits.filter(condition(tree, phrases)).join(facts)
    score = relevance([(F.col(f"n{i}"), F.col(f"f{i}"), F.col("n_tokens")) for i in range(len(phrases))], F.col("rows"), F.col("mean"))
    return rows.select("row_id", (-score).alias("score"))


def capped_count(rows: DataFrame, key: str, cap: int = 10_000) -> DataFrame:
    """total and total_is_capped of the distinct keys, reading no more than it must."""
    few = rows.select(key).distinct().limit(cap + 1)
    n = F.count(F.lit(1))
    return few.agg(F.least(n, F.lit(cap)).alias("total"), (n > cap).alias("total_is_capped"))
