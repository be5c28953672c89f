"""The first rows by bounds are those of scoring every match, fewer postings are read, and each table is read once."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators.bounded import _facts, bm25_first, reading
from docketlake.operators.match import And, Or, Phrase, bm25
from docketlake.operators.postings import bounds, read_index, write_index

BLOCK = 16
WORDS = ["the"] * 30 + ["of"] * 12 + ["law"] * 3 + ["rare"] + ["theta"] * 4
TREES = {
    "one": Phrase(("law",)),
    "frequent": Phrase(("the",)),
    "either": Or((Phrase(("the",)), Phrase(("of",)), Phrase(("rare",)))),
    "both": And((Phrase(("rare",)), Phrase(("law",)))),
    "column": And((Phrase(("the",), column="title"), Phrase(("law",)))),
    "absent": Phrase(("nowhere",)),
    "prefix": Phrase(("the",), prefix=True),
    "phrase": Phrase(("the", "law")),
    "half absent": Or((Phrase(("nowhere",)), Phrase(("rare",)))),
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(3)
    # nulls, empty texts, equal rows, negative ids, and a few rows that say one word often
    data = [(i, " ".join(r.choices(WORDS, k=r.randrange(0, 5))), " ".join(r.choices(WORDS, k=r.randrange(20, 120)) + ["law", "rare"] * (9 if i % 577 == 0 else 0))) for i in range(-60, 2500)]
    data += [(3000, None, None), (3001, "", ""), (3002, "the law", "the law"), (3003, "the law", "the law"), (3100, "rare", "of " * 5000)]
    path = str(tmp_path_factory.mktemp("index"))
    write_index(spark.createDataFrame(data, "id long, title string, body string"), "id", ("title", "body"), path, BLOCK)
    return *read_index(spark, path), spark.read.parquet(path + "/bounds"), data


def first(df, k):
    return [(x.row_id, round(x.score, 8)) for x in df.orderBy(F.round("score", 8), "row_id").limit(k).collect()]


BOTH, CASES = {"title": 4.0, "body": 1.0}, [(x, None, 10) for x in TREES]
CASES += [("either", BOTH, 1), ("either", BOTH, 100), ("column", BOTH, 10), ("one", {"title": 4.0}, 10), ("either", {"title": 4.0, "body": 0.0}, 10)]


def test_equal_to_scoring_all(index):
    postings, shape, held, _ = index
    for name, weights, k in CASES:
        assert first(bm25_first(postings, shape, held, TREES[name], k, BLOCK, weights), k) == first(bm25(postings, shape, TREES[name], weights), k), (name, weights, k)


def test_by_a_plain_version(index):
    """Scores by their formula, over all rows, in Python."""
    import math

    postings, shape, held, data = index
    rows = {i: ((a or "").split(), (b or "").split()) for i, a, b in data}
    mean = sum(len(a) + len(b) for a, b in rows.values()) / len(rows)
    hits = {i: 4 * a.count("law") + b.count("law") for i, (a, b) in rows.items() if "law" in a + b}
    idf = max(1e-6, math.log((len(rows) - len(hits) + 0.5) / (len(hits) + 0.5)))
    score = {i: round(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(map(len, rows[i])) / mean)), 8) for i, f in hits.items()}
    want = sorted(score.items(), key=lambda x: (x[1], x[0]))[:20]
    assert first(bm25_first(postings, shape, held, TREES["one"], 20, BLOCK, {"title": 4.0, "body": 1.0}), 20) == want


def test_runs_that_cannot_reach_the_kth_score_are_not_read(index):
    postings, shape, held, _ = index
    for name, share in (("both", 0.5), ("half absent", 0.5)):
        tree = TREES[name]
        facts = _facts(held, shape, tree, None)
        found = reading(postings, held, tree, 5, None, facts, BLOCK)
        terms = postings.filter(F.col("term").isin([p.tokens[0] for p in tree.items]))
        read = terms.filter(found.seeds | found.rest if found.rest is not None else found.seeds).count()
        assert 0 < read < share * terms.count(), (name, read, terms.count())


def test_bounds_count_rows_once(index):
    postings, _, held, _ = index
    want = {x.term: x.n for x in postings.groupBy("term").agg(F.countDistinct("row_id").alias("n")).collect()}
    assert {x.term: x.n for x in held.filter("col = ''").groupBy("term").agg(F.sum("rows").alias("n")).collect()} == want


def test_postings_are_read_once(index):
    """Two uses of the hits share one exchange; lengths and figures need no second table of rows."""
    postings, shape, _, _ = index
    df = bm25(postings, shape, TREES["either"], {"title": 4.0, "body": 1.0})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1 and "positions" not in final, final


def test_empty_index(spark, index):
    postings, shape, held, _ = index
    nothing = shape.limit(0).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    assert bounds(postings.limit(0), BLOCK).count() == 0
    assert bm25_first(postings.limit(0), nothing, held.limit(0), TREES["either"], 5, BLOCK).count() == 0


def test_postings_are_put_together_without_a_shuffle(spark, monkeypatch):
    from docketlake.operators import postings as made

    monkeypatch.setattr(made, "TOKENS_AT_ONCE", 3)
    rows = spark.createDataFrame([(1, "b a b", "b"), (2, None, ""), (None, "a", None), (3, "c c c c", "a c")], "id long, x string, y string")
    index = made.postings(rows, "id", ("x", "y"))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = {(r.row_id, r.col, r.term, r.n_tokens, r.tf, tuple(r.positions)) for r in index.collect()}
    assert got == {
        (1, "x", "a", 4, 1, (1,)), (1, "x", "b", 4, 2, (0, 2)), (1, "y", "b", 4, 1, (0,)), (None, "x", "a", 1, 1, (0,)),
        (3, "x", "c", 6, 4, (0, 1, 2, 3)), (3, "y", "a", 6, 1, (0,)), (3, "y", "c", 6, 1, (1,)),
    }


def test_postings_are_written_in_sorted_runs_where_their_rows_are_read(spark, tmp_path):
    """No range of terms is put together from all rows, so what a task sorts doesn't grow with the table."""
    from docketlake import segments
    from docketlake.store import Store

    rows = spark.range(0, 4000, 1, 4).select("id", F.format_string("w%04d of the law", F.col("id") % 50).alias("x"))
    write_index(rows, "id", ["x"], str(tmp_path / "plain"))
    segments.build(Store(spark, str(tmp_path)), "t", rows, ["x"])
    for path in (str(tmp_path / "plain/postings"), f"{tmp_path}/t_postings/*/_slice=1"):
        written = spark.read.parquet(path).select("term", "row_id", F.input_file_name().alias("file"))
        assert written.count() == 16_000
        spans = sorted((r.low, r.high) for r in written.groupBy("file").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high")).collect())
        assert spans == [(i, i + 999) for i in range(0, 4000, 1000)]
        for f in {r.file for r in written.select("file").distinct().collect()}:
            terms = [r.term for r in spark.read.parquet(f).coalesce(1).collect()]
            assert terms == sorted(terms)


def test_ranges_that_are_sorted_follow_the_size_of_their_files(spark, tmp_path, monkeypatch):
    from docketlake import store

    spark.range(0, 50_000, 1, 2).select((F.col("id") * 7919 % 50_000).alias("id")).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(store, "RANGE_BYTES", 10_000)
    out = store.ranged(spark.read.parquet(str(tmp_path / "in")), "id")
    assert out.rdd.getNumPartitions() > 10
    assert [r.id for r in out.collect()] == list(range(50_000))


def test_small_batches_make_one_run(monkeypatch):
    """Batches below TOKENS_AT_ONCE are put together, so that runs are long and a term is in few of their pages; longer ones are cut."""
    import pyarrow as pa

    from docketlake.operators import postings as made

    batch = lambda i, words: pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["x"]), pa.array([len(words)]), pa.array([words], pa.list_(pa.string()))], names=["row_id", "col", "n_tokens", "words"])
    batches = [batch(1, ["c", "a"]), batch(2, []), batch(3, ["b", "a", "b"]), batch(4, ["a"] * 9)]
    monkeypatch.setattr(made, "TOKENS_AT_ONCE", 8)
    runs = [[(r["term"], r["row_id"], r["positions"]) for r in run.to_pylist()] for run in made._gathered(iter(batches))]
    assert runs == [[("a", 1, [1]), ("a", 3, [1]), ("b", 3, [0, 2]), ("c", 1, [0])], [("a", 4, list(range(9)))]]


def test_postings_take_each_columns_words_once(spark):
    """No generator copies the lists of words; a row's n_tokens are those of all columns."""
    from docketlake.operators.postings import postings

    rows = spark.createDataFrame([(1, "b a b", "b", None), (2, None, "", " "), (None, "a", None, "c d")], "id long, x string, y string, z string")
    index = postings(rows, "id", ("x", "y", "z"))
    assert "Generate" not in index._jdf.queryExecution().executedPlan().toString()
    want = {(1, "x", "a", 4, 1, (1,)), (1, "x", "b", 4, 2, (0, 2)), (1, "y", "b", 4, 1, (0,)), (None, "x", "a", 3, 1, (0,)), (None, "z", "c", 3, 1, (0,)), (None, "z", "d", 3, 1, (1,))}
    assert {(r.row_id, r.col, r.term, r.n_tokens, r.tf, tuple(r.positions)) for r in index.collect()} == want
    assert postings(rows.limit(0), "id", ("x", "y")).count() == 0
