"""Phrases asked as a table, long phrases, breadcrumbs of any depth, neighbours by clusters: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators.asked import first_rows, phrase_places
from docketlake.operators.clustered import clustered, nearest, share_read
from docketlake.operators.match import Phrase, matching_rows
from docketlake.operators.postings import postings
from docketlake.sources import outline

from .test_ingest import rows

TERMS = "query int, phrase int, n int, i int, term string, prefix boolean"


def test_phrases_of_any_length_and_prefixes(spark):
    r = random.Random(4)
    texts = [[r.choice(["the", "of", "theta", "a", "b", "ab"]) for _ in range(r.randrange(0, 300))] for _ in range(40)]
    index = postings(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, body string"), "id", ("body",))
    asked = [(texts[n][k : k + size], prefix) for n, t in enumerate(texts) for size, prefix in ((1, True), (2, False), (2, True), (65, False), (200, False)) for k in [r.randrange(0, 20)] if len(t) >= k + size]
    asked += [(["the", "missing"], False), (["th"], True), (["of", "th"], True)]
    terms = [(q, 0, len(p), i, w, prefix and i == len(p) - 1) for q, (p, prefix) in enumerate(asked) for i, w in enumerate(p)]
    fits = lambda x, y, prefix: x[:-1] == y[:-1] and (x[-1].startswith(y[-1]) if prefix else x[-1] == y[-1])
    want = {}
    for q, (p, prefix) in enumerate(asked):
        for n, t in enumerate(texts):
            places = sum(fits(t[k : k + len(p)], p, prefix) for k in range(len(t) - len(p) + 1))
            if places:
                want[q, n] = places
    found = phrase_places(index, spark.createDataFrame(terms, TERMS))
    assert {(x.query, x.row_id): x.places for x in found.collect()} == want
    best = [(q, n) for q, _ in enumerate(asked) for n in sorted((n for k, n in want if k == q), key=lambda n: (-want[q, n], n))[:2]]
    assert sorted((x.query, x.row_id) for x in first_rows(found, 2).collect()) == sorted(best)
    for size in (64, 65, 80, 200):
        n = next(i for i, t in enumerate(texts) if len(t) > size + 5)
        assert (n,) in rows(matching_rows(index, Phrase(tuple(texts[n][3 : 3 + size]))))


NODES = "source string, node_id long, parent_id long, ord long, title string, page int"


@pytest.mark.parametrize("depth", [1, 20, 500])
def test_breadcrumbs_of_any_depth(spark, depth):
    nodes = [("s", i, i - 1 if i else None, i, f"t{i}", 1) for i in range(depth)] + [("s", 9000, depth - 1, 9000, "leaf", 2), ("other", 0, 77, 0, "its parent isn't there", 1)]
    found = {(r.source, r.title): r.breadcrumb for r in outline.leaves(spark.createDataFrame(nodes, NODES)).collect()}
    assert found == {("s", "leaf"): [*[f"t{i}" for i in range(depth)], "leaf"], ("other", "its parent isn't there"): ["its parent isn't there"]}


def test_a_circle_is_an_error(spark):
    nodes = [("s", 1, 2, 1, "a", 1), ("s", 2, 3, 2, "b", 1), ("s", 3, 1, 3, "c", 1)]
    with pytest.raises(ValueError, match="circle"):
        outline.breadcrumbs(spark.createDataFrame(nodes, NODES))
    assert outline.breadcrumbs(spark.createDataFrame([], NODES)).collect() == []


def test_neighbours_by_clusters(spark):
    r = random.Random(8)
    vectors = [(i, [r.gauss(c, 0.2) for c in (i % 7, i % 3, 0)]) for i in range(400)] + [(400 + i, [1.0, 2.0, 3.0]) for i in range(30)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    held = {i: v for i, v in [(x.id, x.v) for x in df.collect()] if v is not None and len(v) == 3}
    queries = df.filter("id % 20 = 0 or id > 890")
    made = clustered(df, "id", "v")
    got = {(x.query, x.rank): x.id for x in nearest(made, queries, "id", "v", 5).collect()}
    for q in [i for i in held if i % 20 == 0]:
        d = lambda i: sum((a - b) ** 2 for a, b in zip(held[q], held[i])) ** 0.5  # noqa: E731, B023
        want = sorted(held, key=lambda i: (d(i), i))[:5]
        assert [got[q, n] for n in range(1, 6)] == want
    assert len(got) == 5 * len([i for i in held if i % 20 == 0])
    assert share_read(made, queries, "id", "v", 5) < 0.5
    assert nearest(clustered(df.limit(0), "id", "v"), queries, "id", "v", 5).collect() == []
    few = nearest(clustered(df.filter("id < 3"), "id", "v"), queries.filter("id = 20"), "id", "v", 5)
    assert few.count() == 3 and few.agg(F.max("rank")).first()[0] == 3


def test_questions_that_repeat_are_looked_up_once_and_all_answered(spark):
    from docketlake.operators.asked import FIRST_HELD, distinct_phrases, phrase_terms

    words = [f"w{i}" for i in range(FIRST_HELD + 3)]
    texts = [words + ["x"] + words, words[:-1] + ["y"], words, ["w1", "w1", "w2"]]
    index = postings(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, body string"), "id", ("body",))
    asked = [(1, words), (2, words), (3, words[:FIRST_HELD]), (4, ["w1"]), (5, ["w1", "w1"]), (6, words[::-1])]
    terms = phrase_terms(spark.createDataFrame([(q, " ".join(t)) for q, t in asked], "q long, t string"), "q", "t")
    assert distinct_phrases(terms)[1].select("same").distinct().count() == 5
    want = {(q, r): n for q, t in asked for r, x in enumerate(texts) if (n := sum(x[i : i + len(t)] == t for i in range(len(x))))}
    assert {(x.query, x.row_id): x.places for x in phrase_places(index, terms).collect()} == want


def test_a_task_keeps_k_of_each_query_and_never_all_pairs(spark, monkeypatch):
    """Groups are of bounded sizes; what leaves each is at most k rows a query, also where all vectors are equal or nothing can be left out."""
    from docketlake.operators import clustered as made

    monkeypatch.setattr(made, "GROUP_MEMBERS", 100)
    monkeypatch.setattr(made, "GROUP_QUERIES", 10)
    monkeypatch.setattr(made, "LEAST_MEMBERS", 1000)
    r = random.Random(5)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(600)] + [(600 + i, [0.5] * 8) for i in range(400)]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    queries, k = df.filter("id % 25 = 0"), 5
    found = clustered(df, "id", "v", 10)
    asked = made._asked(found, queries, "id", "v")
    assert made._read(found, asked.withColumn("kth", F.lit(None).cast("double")), 40, k).groupBy("query").count().agg(F.max("count")).first()[0] <= k * 11
    held = dict(vectors)
    got = {(x.query, x.rank): (x.id, round(x.distance, 9)) for x in nearest(found, queries, "id", "v", k).collect()}
    for q in range(0, 1000, 25):
        d = lambda i: sum((a - b) ** 2 for a, b in zip(held[q], held[i])) ** 0.5  # noqa: E731, B023
        want = sorted(held, key=lambda i: (d(i), i))[:k]
        assert [got[q, n] for n in range(1, k + 1)] == [(i, round(d(i), 9)) for i in want]
    assert len(got) == 40 * k
