"""What a small change to a store reads and writes, and that the result is that of a full run."""

import pytest
from pyspark.sql import functions as F

from docketlake import jobs, segments
from docketlake.operators.match import And, Phrase, bm25, matching_rows
from docketlake.plans.library import Library
from docketlake.store import Store

from .test_ingest import CITE, book, document, rows


def files(store, table):
    """Slices of a table and the files that each lies in."""
    root = store.path + "/" + table
    return {r[0].removeprefix(root) for r in store.read(table).select(F.input_file_name()).distinct().collect()}


def many(numbers, lang="en", procedure="en", word="text"):
    return [document(lang, procedure, f"E{i}", "T", str(i), "2019", f"head {word} {i}", [f"k{i}"], "note" if i % 3 == 0 else "", f"<p>{word} of decision {i}</p>", ["EPC_Art_056"], CITE.format("T", i + 1, 2019)) for i in numbers]


def written(path, documents):
    path.write_text("<root>" + "".join(documents) + "</root>")
    return str(path)


def contents(store):
    """All tables by key, without ids of their own."""
    keys = store.read("decisions").select(F.col("id").alias("decision_id"), "ecli")
    text = store.read("decision_texts").select("decision_id", "lang", "is_original", "headnote", "reasons")
    return {
        "decisions": rows(store.read("decisions").drop("id", "slice")),
        **{t: rows(df.join(keys, "decision_id").drop("decision_id")) for t, df in {
            "texts": text, "provisions": store.read("decision_provisions"), "citations": store.read("decision_citations").withColumnRenamed("citing_id", "decision_id"),
            "chunks": store.read("chunks").drop("id", "slice"), "keys": store.read("keys").drop("slice", "ecli"),
        }.items()},
    }


BATCHES = [many(range(40)), many(range(5, 7), "de", "de", "anders") + many([40, 41]), many([5], "fr", "en", "autre") + many([5], "fr", "fr", "again")]
#: Documents whose key and language are there already, which an incremental run leaves.
REPEATS = many([41, 6], word="not taken")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 8)


def test_an_incremental_run_equals_a_full_one_and_touches_little(spark, tmp_path, monkeypatch, small_blocks):
    whole = jobs.index(spark, written(tmp_path / "all.xml", BATCHES[0] + BATCHES[1] + BATCHES[2]), str(tmp_path / "whole"))
    path = str(tmp_path / "store")
    store = jobs.index(spark, written(tmp_path / "0.xml", BATCHES[0]), path)
    read = []
    original = Store.read

    def reading(self, table, slices=None):
        found = original(self, table, slices)
        if self.path == path and table in ("decisions", "decision_texts", "keys", "decision_postings"):
            read.append((table, slices, found))
        return found

    for n, batch in enumerate(BATCHES[1:], 1):
        before, held = files(store, "decisions"), store.read("decisions").count()
        monkeypatch.setattr(Store, "read", reading)
        read.clear()
        jobs.merge_documents(store, jobs.decision_xml.scan(spark, written(tmp_path / f"{n}.xml", batch + REPEATS * (n == 2))))
        monkeypatch.setattr(Store, "read", original)
        # decisions 5 and 6, and the new ones', lie in one block of 8 each; tables read whole are read for a bound of ids only
        assert max(df.count() for t, s, df in read if t == "decisions" and s is not None) <= 16 < held
        assert max(df.count() for t, s, df in read if t == "keys") < 12
        assert not any(t == "decision_postings" and s is None for t, s, _ in read)
        after = files(store, "decisions")
        assert len(before - after) <= 2 and len(before & after) >= 4  # blocks that aren't touched keep their files
    assert contents(store) == contents(whole)
    index = lambda s: sorted((r.ecli, r.lang, r.col, r.term, r.tf, r.positions) for r in named(s).collect())
    named = lambda s: segments.live(s, "decision")[0].join(s.read("decision_texts").select(F.col("id").alias("row_id"), "decision_id", "lang"), "row_id").join(s.read("decisions").select(F.col("id").alias("decision_id"), "ecli"), "decision_id")
    assert index(store) == index(whole)
    assert Library(store).search_decisions("anders", mode="lexical")["total"] == Library(whole).search_decisions("anders", mode="lexical")["total"] == 2


def test_an_interrupted_merge_is_made_good(spark, tmp_path, monkeypatch, small_blocks):
    whole = jobs.index(spark, written(tmp_path / "all.xml", BATCHES[0] + BATCHES[1]), str(tmp_path / "whole"))
    store = jobs.index(spark, written(tmp_path / "0.xml", BATCHES[0]), str(tmp_path / "store"))
    source = written(tmp_path / "1.xml", BATCHES[1])
    for lost_at in ("chunks", "keys"):
        append = Store.append

        def failing(self, table, *a, **k):
            if table == lost_at:
                raise RuntimeError("lost")
            return append(self, table, *a, **k)

        monkeypatch.setattr(Store, "append", failing)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.index(spark, source, store.path, incremental=True)
        monkeypatch.setattr(Store, "append", append)
    jobs.index(spark, source, store.path, incremental=True)
    assert contents(store) == contents(whole)
    assert rows(segments.live(store, "decision")[1].select("n_tokens")) == rows(segments.live(whole, "decision")[1].select("n_tokens"))


def test_segments(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    texts = {i: f"word{i % 3} common and row {i}" for i in range(30)}
    frame = lambda ids=None: spark.createDataFrame([(i, t) for i, t in texts.items() if ids is None or i in ids], "id long, body string")
    segments.build(store, "t", frame(), ("body",))

    def same():
        other = Store(spark, str(tmp_path / f"other{len(texts)}-{store._current('t_segments')[0]}"))
        segments.build(other, "t", frame(), ("body",))
        for tree in (Phrase(("common",)), And((Phrase(("wor",), prefix=True), Phrase(("row", "7")))), Phrase(("changed",))):
            found = [rows(bm25(*segments.searched(s, "t"), tree).select("row_id", F.round("score", 9))) for s in (store, other)]
            assert found[0] == found[1]
            assert rows(matching_rows(segments.live(store, "t")[0], tree)) == rows(matching_rows(segments.live(other, "t")[0], tree))

    old = files(store, "t_postings")
    texts[7] = "changed row 7"
    segments.change(store, "t", frame({7}), ("body",), frame({7}).select(F.col("id").alias("row_id")))
    assert files(store, "t_postings") >= old and store.read("t_postings", [2]).count() == 3 and store.read("t_deletes").count() == 1
    del texts[8]
    segments.change(store, "t", frame(set()), ("body",), spark.createDataFrame([(8,)], "row_id long"))
    same()
    for i in range(100, 104):
        texts[i] = f"common row {i}"
        segments.change(store, "t", frame({i}), ("body",))
    assert len(segments.segments(store, "t")) < 6  # small ones were merged, the first is as it was
    assert files(store, "t_postings") >= old
    texts[9] = "common once more"
    jobs.update_index(store, "t", frame(), ("body",))
    same()


def test_an_interrupted_change_isn_t_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda *x: spark.createDataFrame(list(x), "id long, body string")
    segments.build(store, "t", frame((1, "one"), (2, "two")), ("body",))
    store.append("t_deletes", spark.createDataFrame([(1, 2)], "row_id long, seg long"), ["row_id"], "seg")
    segments._add(store, "t", 2, *[df.limit(0).drop("seg") for df in segments.live(store, "t")])
    assert segments.live(store, "t")[1].count() == 2
    segments.change(store, "t", frame((3, "three")), ("body",))
    assert sorted(r.row_id for r in segments.live(store, "t")[1].collect()) == [1, 2, 3]


def test_vectors_are_made_once_though_a_run_is_killed(spark, tmp_path):
    store = jobs.index(spark, written(tmp_path / "0.xml", many(range(30))), str(tmp_path / "store"))
    pages, nodes = book(spark)
    jobs.index_sections(store, pages, nodes)
    log, plain = tmp_path / "log", jobs.hashing_embedder(8)
    log.mkdir()

    def embedder(texts, most=10**9):
        import os
        import uuid

        if len(os.listdir(log)) >= most:
            raise RuntimeError("killed")
        (log / uuid.uuid4().hex).write_text("\x1e".join(texts))
        return plain(texts)

    jobs.embed(store, plain, "m", "book")
    books = files(store, "vectors")
    assert jobs.pending(store, "essence").count() == 30
    with pytest.raises(Exception, match="killed"):
        jobs.embed(store, lambda t: embedder(t, 3), "m", "reasons", batch_rows=6)
    made = store.read("vectors", ["reasons"]).count()
    assert 0 < made < 30
    jobs.embed(store, embedder, "m", batch_rows=6)
    committed = [t for f in log.iterdir() for t in f.read_text().split("\x1e")]
    assert all(jobs.pending(store, k).isEmpty() for k in jobs.STAGES) and store.read("vectors").select("id").distinct().count() == store.read("vectors").count()
    assert set(committed) >= {"passage: " + r.text for r in store.read("chunks").filter("kind <> 'book'").collect()} and len(committed) <= 60 + 6  # the batch that was lost is made again
    assert files(store, "vectors") >= books
    n = len(list(log.iterdir()))
    jobs.embed(store, embedder, "m")
    assert len(list(log.iterdir())) == n


def test_a_book_is_exchanged_alone(spark, tmp_path):
    store, (pages, nodes) = Store(spark, str(tmp_path)), book(spark)
    jobs.index_sections(store, pages, nodes)
    one = jobs.book_slice(F.lit("gl"))
    gl, before = spark.range(1).select(one).first()[0], {t: files(store, t) for t in ("chunks", "book_sections")}
    jobs.index_sections(store, pages.filter("source = 'gl'"), nodes.filter("source = 'gl'"))
    for t, old in before.items():
        kept = {f for f in old if gl not in f}
        assert kept and kept <= files(store, t) and not (old - kept) & files(store, t)
    store.set_meta(embedded_book_at="then")
    with pytest.raises(LookupError, match="vectors"):
        jobs.index_sections(store, pages, nodes)


def test_slices(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.range(100).withColumn("k", F.col("id") % 4)
    store.replace("t", df, ["id"], "k")
    assert store.slices("t") == {"0", "1", "2", "3"} and store.read("t", [2]).count() == 25 and store.read("t", []).count() == 0
    old = files(store, "t")
    store.replace_slices("t", df.filter("k = 1 and id > 50"), "k", ["id"], gone=[3])
    assert store.slices("t") == {"0", "1", "2"} and store.read("t").count() == 50 + df.filter("k = 1 and id > 50").count()
    assert len(old & files(store, "t")) == len([f for f in old if "_slice=0" in f or "_slice=2" in f])
    assert not store.append("t", df.limit(0), ["id"], "k") and store.append("t", df.filter("id = 3"), ["id"], "k")
    assert store.read("t", [3]).count() == 1 and store.read("t").columns == ["id", "k"]


def test_a_batch_that_adds_to_all_decisions_sends_none_of_their_ids_to_all_tasks(spark, tmp_path, monkeypatch):
    jobs.index(spark, written(tmp_path / "0.xml", many(range(6))), str(tmp_path / "store"))
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    store = jobs.index(spark, written(tmp_path / "1.xml", many(range(6), "de", "de", "anders")), str(tmp_path / "store"), incremental=True)
    assert not [c for c in sent if "decision_id" in c]
    monkeypatch.setattr(segments, "MANY_GONE", 0)
    plan = segments.live(store, "decision")[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_merge_sends_no_keys_to_all_tasks(spark, tmp_path, monkeypatch):
    """what a second batch is held against has small files and many rows."""
    from docketlake import store as stores
    from docketlake.sources import decision_xml

    from .test_ingest import sent_to_all

    store = jobs.index(spark, written(tmp_path / "0.xml", many(range(40))), str(tmp_path / "store"))
    docs = jobs.cut(decision_xml.scan(spark, written(tmp_path / "1.xml", many(range(5, 7), "de", "de", "anders") + many([40]))))
    planned, write = [], stores.Store._write
    for module in (jobs, decision_xml):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (planned.append(df), cut(df))[1])
    monkeypatch.setattr(stores.Store, "_write", lambda self, table, rows, *a, **b: (planned.append(rows), write(self, table, rows, *a, **b))[1])
    jobs.merge_documents(store, docs)
    assert len(planned) > 10 and not [x for df in planned for x in sent_to_all(df)]
