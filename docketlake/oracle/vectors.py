"""Nearest neighbours and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import passage_score
from ..functions.vectors import cosine
from ..operators.match import Phrase, bm25
from ..operators.ranking import best_per_key, fuse, fused_order, knn, ranked, top
from .tables import spread, table, text_index

QUERY_ID = 7


def _query(vectors: DataFrame) -> list[float]:
    return list(vectors.filter(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = table(spark, sf_dir, "embeddings")
        return knn(v, "vec_id", "embedding", _query(v), 20, metric).select("vec_id", F.round("distance", 6).alias("distance"))

    return run


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, label, {0} AS distance FROM embeddings, q) "
_DOT, _L2 = "list_inner_product(embedding::DOUBLE[], q)", "list_distance(embedding::DOUBLE[], q)"


def best_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    near = knn(v, "vec_id", "embedding", _query(v), 100).withColumn("distance", F.round("distance", 8))
    best = best_per_key(near.select("label", "distance", "vec_id"), "label", F.col("distance"), F.col("vec_id"))
    return best.select("label", "vec_id", F.round("distance", 6).alias("distance"))


def postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the cut to k, so fewer rows may be left."""
    v = table(spark, sf_dir, "embeddings")
    return knn(v, "vec_id", "embedding", _query(v), 100).filter("label in (1, 3)").select("vec_id", "label", F.round("distance", 6).alias("distance"))


def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return knn(v.filter("label in (1, 3)"), "vec_id", "embedding", _query(v), 20).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def cosine_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine to the query's vector by label: the query's own label stands out."""
    v = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(x) for x in _query(v)])
    return v.groupBy("label").agg(F.round(F.avg(cosine(F.col("embedding"), q)), 6).alias("mean_cosine"))


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text and, with the vector of the same id, by vector; fused, second page."""
    v = table(spark, sf_dir, "embeddings")
    index, stats = text_index(spark, sf_dir, "documents", "documents-text", lambda: spread(spark, sf_dir, "documents"), "doc_id", ["text"])
    scored = bm25(index, stats, Phrase(("license",)))
    lexical = top(scored.select(F.col("row_id").alias("id"), F.round("score", 8).alias("score")), 100, F.col("score"), F.col("id"))
    near = knn(v, "vec_id", "embedding", _query(v), 100).select(F.col("vec_id").alias("id"), F.round("distance", 8).alias("distance"))
    fused = fuse(ranked(lexical, "id", F.col("score"), F.col("id")), ranked(near, "id", F.col("distance"), F.col("id")), "id")
    return fused.orderBy(*fused_order()).offset(10).limit(20).select("id", F.round("score", 9).alias("score"), "first_rank", "second_rank")


RRF_HYBRID = r"""
WITH k AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, len(w) AS n FROM k),
h AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'license'))::DOUBLE AS f FROM k), s AS (SELECT count(*)::DOUBLE AS r, avg(n) AS mean FROM t), c AS (SELECT count(*) FILTER (f > 0)::DOUBLE AS n0 FROM h),
b AS (SELECT h.doc_id AS id, round(-(greatest(1e-6, ln((r - n0 + 0.5) / (n0 + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * t.n / mean))), 8) AS score FROM h JOIN t USING (doc_id), s, c WHERE f > 0),
l AS (SELECT id, row_number() OVER (ORDER BY score, id) AS first_rank FROM b ORDER BY score, id LIMIT 100),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], q) AS x FROM embeddings, q),
v AS (SELECT id, row_number() OVER (ORDER BY round(x, 8), id) AS second_rank FROM (SELECT * FROM d ORDER BY x, id LIMIT 100)),
f AS (SELECT coalesce(l.id, v.id) AS id, first_rank::INT AS first_rank, second_rank::INT AS second_rank, coalesce(1.0::DOUBLE / (60 + first_rank), 0) + coalesce(1.0::DOUBLE / (60 + second_rank), 0) AS score FROM l FULL JOIN v ON l.id = v.id)
SELECT id, round(score, 9) AS score, first_rank, second_rank FROM f ORDER BY f.score DESC, first_rank NULLS LAST, second_rank NULLS LAST LIMIT 20 OFFSET 10
"""


def rrf_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of one conversation by text score and by length, fused; both lists are cut before."""
    rows = table(spark, sf_dir, "conversations").filter("conv_id = 3")
    scored = rows.select("turn", passage_score(F.col("text"), "de la").alias("score"), F.length("text").alias("n"))
    lexical = top(scored.filter("score > 0"), 5, F.desc("score"), F.col("turn"))
    other = top(scored, 5, F.desc("n"), F.col("turn"))
    fused = fuse(ranked(lexical, "turn", F.desc("score"), F.col("turn")), ranked(other, "turn", F.desc("n"), F.col("turn")), "turn")
    return fused.orderBy(F.desc("score"), "turn").limit(5).select("turn", F.round("score", 9).alias("score"))


_SCORE = "(CASE WHEN contains(lower(text), 'de la') THEN 10 ELSE 0 END + (length(text) - length(replace(lower(text), 'de', ''))) // 2 + (length(text) - length(replace(lower(text), 'la', ''))) // 2)::BIGINT"
RRF_PASSAGES = f"""
WITH s AS (SELECT turn, {_SCORE} AS score, length(text) AS n FROM conversations WHERE conv_id = 3),
a AS (SELECT turn, row_number() OVER (ORDER BY score DESC, turn) AS r FROM s WHERE score > 0 ORDER BY score DESC, turn LIMIT 5),
b AS (SELECT turn, row_number() OVER (ORDER BY n DESC, turn) AS r FROM s ORDER BY n DESC, turn LIMIT 5)
SELECT turn, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY turn ORDER BY score DESC, turn LIMIT 5
"""

QUERIES = {
    "knn_dot": _knn("dot"), "knn_l2": _knn("l2"), "knn_best_per_parent": best_per_parent, "knn_postfilter": postfilter, "knn_prefilter": prefilter,
    "cosine_discrimination": cosine_discrimination, "rrf_hybrid": rrf_hybrid, "rrf_passages": rrf_passages,
}
SQL = {
    "knn_dot": _Q.format(_DOT) + "SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance DESC, vec_id LIMIT 20",
    "knn_l2": _Q.format(_L2) + "SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 20",
    "knn_best_per_parent": _Q.format(_L2) + "SELECT label, arg_min(vec_id, (round(distance, 8), vec_id)) AS vec_id, round(min(distance), 6) AS distance FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 100) GROUP BY label",
    "knn_postfilter": _Q.format(_L2) + "SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 100) WHERE label IN (1, 3)",
    "knn_prefilter": _Q.format(_L2) + "SELECT vec_id, label, round(distance, 6) AS distance FROM d WHERE label IN (1, 3) ORDER BY d.distance, vec_id LIMIT 20",
    "cosine_discrimination": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT label, round(avg(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS mean_cosine FROM embeddings, q GROUP BY label",
    "rrf_hybrid": RRF_HYBRID,
    "rrf_passages": RRF_PASSAGES,
}
