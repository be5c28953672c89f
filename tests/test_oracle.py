"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [k for k in entry.queries() if k in entry.oracle_sql()]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[columns.index(c)] for c in order]) for r in want)


def test_all_of_the_reference_side_has_sql():
    from docketlake import oracle

    assert oracle.queries().keys() == oracle.oracle_sql().keys()


def test_made_once_and_again_for_other_files(spark, tmp_path):
    from docketlake.oracle import tables

    calls = []
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    for _ in range(2):
        tables.made(spark, str(tmp_path), ["documents"], "test", calls.append)
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    tables.made(spark, str(tmp_path), ["documents"], "test", calls.append)
    assert len(calls) == 2 == len(set(calls))


def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "source", "score"]


def test_store_of_answers_is_indexed_without_moving_its_texts_again(spark, tmp_path, monkeypatch):
    """The index is made of rows at hand, not of the store's texts joined anew, and is the one that a rebuild makes."""
    from docketlake import jobs, segments
    from docketlake.operators.postings import postings, row_stats
    from docketlake.oracle import answers
    from docketlake.store import Store

    with monkeypatch.context() as m:
        m.setattr(jobs, "index_rows", lambda *a, **b: pytest.fail("texts are joined again"))
        answers._build(spark, FOLDER, str(tmp_path))
    store = Store(spark, str(tmp_path))
    index, stats = segments.live(store, "decision")
    rows = jobs.index_rows(store)
    for made, want in ((index.drop("seg"), postings(rows, "id", jobs.DECISION_INDEX)), (stats.drop("seg"), row_stats(rows, "id", jobs.DECISION_INDEX))):
        want = want.select(*made.columns)
        assert made.count() == want.count() > 0 and made.exceptAll(want).isEmpty()


def test_texts_of_answers_are_written_where_their_documents_are_read(spark, tmp_path, monkeypatch):
    """Texts aren't shuffled to be sorted by id, nor staged for the index: each of their files is sorted, which look-ups by id read a few pages of."""
    from docketlake import jobs, shared, store
    from docketlake.oracle import answers

    ranged, cut, moved = store.ranged, shared.cut, []
    with monkeypatch.context() as m:
        m.setattr(store, "ranged", lambda rows, *order: (moved.append(rows.columns), ranged(rows, *order))[1])
        for module in (answers, jobs):
            m.setattr(module, "cut", lambda rows: (moved.append(rows.columns), cut(rows))[1], raising=False)
        answers._build(spark, FOLDER, str(tmp_path))
    assert moved and not [c for c in moved if {"reasons", "text", "html", "body"} & set(c) and "seq" not in c]
    texts = store.Store(spark, str(tmp_path)).read("decision_texts")
    assert texts.count() == texts.select("id").distinct().count() > 200
    for f in texts.inputFiles():
        ids = [r.id for r in spark.read.parquet(f).select("id").coalesce(1).collect()]
        assert ids == sorted(ids)


def test_parts_of_the_store_are_made_when_a_question_reads_them(spark, monkeypatch):
    """Passages of a decision need no text index; a search makes it later, of the texts that are there."""
    from docketlake import segments
    from docketlake.oracle import answers, tables

    monkeypatch.setattr(tables, "_made", {})
    with monkeypatch.context() as m:
        m.setattr(segments, "build", lambda *a: pytest.fail("a text index is made"))
        first = answers.passage_search(spark, FOLDER).collect()
        m.setattr(answers, "_build", lambda *a: pytest.fail("a part is made twice"))
        assert answers.passage_search(spark, FOLDER).collect() == first != []
    made, build = [], answers._build
    monkeypatch.setattr(answers, "_build", lambda spark, sf_dir, path, parts: (made.extend(parts), build(spark, sf_dir, path, parts)))
    assert answers.search_lexical(spark, FOLDER).count() > 0
    assert made == ["references", "decision index"]


def test_words_alone_count_and_page_all_that_match(spark, tmp_path):
    """more than 10,000 matches are counted, and pages beyond the 1,000th place are whole."""
    from docketlake.oracle import answers
    from docketlake.plans.library import Library
    from docketlake.store import Store

    n = 10_030
    docs = spark.range(n).selectExpr("id as doc_id", "'en' as lang", "'web' as source", "concat('licensed under ', id) as text")
    given = {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int")}
    store = Store(spark, str(tmp_path))
    for part in ("decisions", "texts", "references", "decision index"):
        answers.PARTS[part](store, given.__getitem__)
    found = Library(store).search_decisions("licensed under", mode="lexical", offset=990, limit=25)
    assert (found["total"], found["total_is_capped"], len(found["results"])) == (n, False, 25)
