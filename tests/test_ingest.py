"""Ingest of small XML and outline fixtures, jobs, streaming and the library's answers."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake import jobs, segments
from docketlake.plans.library import Library
from docketlake.shared import cut
from docketlake.sources import decision_xml, outline
from docketlake.store import Store
from docketlake.streaming.incremental import ingest_new

BIB = '<ep-appeal-bib-data volume="v7"><ep-distribution-code>{dist}</ep-distribution-code><ep-case-num code="{code}"><country>EP</country><ep-appeal-num>{num}</ep-appeal-num><ep-year>{year}</ep-year></ep-case-num><ep-board-of-appeal-code>3.3.01</ep-board-of-appeal-code>{ecli}<application-reference><document-id><doc-number>99</doc-number><date>19990101</date></document-id></application-reference><ep-date-of-decision><date>20191121</date></ep-date-of-decision></ep-appeal-bib-data>'


def document(lang, procedure, ecli, code, num, year, headword="", keywords=(), headnote="", reasons="", refs=(), cited="", dist="A"):
    bib = BIB.format(code=code, num=num, year=year, dist=dist, ecli=f"<ep-ecli>{ecli}</ep-ecli>" if ecli else "")
    head = f"<ep-headword>{headword}</ep-headword>" if headword else ""
    keys = "<ep-keywords>" + "".join(f"<keyword>{k}</keyword>" for k in keywords) + "</ep-keywords>"
    refs = "<ep-legal-refs>" + "".join(f"<ep-legal-citation><ep-legal-ref-presentation>{r}</ep-legal-ref-presentation></ep-legal-citation>" for r in refs) + "</ep-legal-refs>"
    note = f"<ep-headnote><p>{headnote}</p></ep-headnote>" if headnote else ""
    return f'<ep-appeal-decision lang="{lang}" procedure-lang="{procedure}">{bib}{head}{refs}{keys}<ep-cited-decisions>{cited}</ep-cited-decisions>{note}<ep-reasons-for-decision>{reasons}</ep-reasons-for-decision></ep-appeal-decision>'


CITE = '<ep-cited-decision code="{0}"><ep-appeal-num>{1}</ep-appeal-num><ep-year>{2}</ep-year></ep-cited-decision>'
DOCUMENTS = [
    document("en", "de", "A", "T", "0664", "2016", "HW-en", ["k1-en"], "", "<p>one <b>bold</b> two</p><p>three</p>", ["EPC2000_Art_123(2)_(2007)", "EPC1973_R_057a"], CITE.format("T", 1, 2015) * 2 + "<ep-cited-decision><text>T 9/99</text></ep-cited-decision>"),
    document("de", "de", "A", "T", "0664", "2016", "HW-de", ["k1-de", "k2-de"], "Leitsatz", "<p>eins</p>", ["EPC_Art_056"], CITE.format("G", 1, 2019)),
    document("en", "en", "B", "G", "1", "2019", "HW-g", refs=["Guidelines only"], dist="C"),
    document("en", "en", "", "T", "2", "2020"),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("xml")
    (folder / "EPDecisions_1.xml").write_text("<root>\n" + "\n".join(DOCUMENTS) + "\n</root>", encoding="utf-8")
    assert decision_xml.newest_source(spark, str(folder)).endswith("EPDecisions_1.xml")
    made = jobs.index(spark, str(folder / "EPDecisions_1.xml"), str(tmp_path_factory.mktemp("store")))
    pages, nodes = book(spark)
    jobs.index_sections(made, pages, nodes)
    jobs.embed(made, jobs.hashing_embedder(), "hashing")
    return made


def book(spark):
    long = "This paragraph speaks of Rule 57a and of other matters at length. "
    pages = [
        ("clb", 10, "II. PATENTABILITY\nA. Inventions\nIntro text that belongs to nobody else here, in full sentences.\n1. First\nBody of the exam-\nple section. " + long + "\n2. Second\nOther text follows here. " + long * 2 + "\n10"),
        ("clb", 11, "xiv\nContinued text of the second. " + long),
        ("clb", 12, "3.1 Third\n" + long + "\n3.1 Third\nshort"),
        ("gl", 1, "1.1 Scope\n" + long + "\nGuidelines for Examination in the EPO March 2024\nab\n" + long),
        ("gl", 2, "1.1 General\n" + long * 2),
    ]
    nodes = [
        ("clb", 1, None, 1, "II. PATENTABILITY", 10), ("clb", 2, 1, 2, "A. Inventions", 10), ("clb", 3, 2, 3, "1. First", 10), ("clb", 4, 2, 4, "2. Second", 10), ("clb", 5, 2, 5, "3.1 Third", 12),
        ("clb", 6, 2, 6, "3.1 Missing heading", 12), ("gl", 1, None, 1, "Part A Formalities", 1), ("gl", 2, 1, 2, "Chapter II Filing", 1), ("gl", 3, 2, 3, "1.1 Scope", 1), ("gl", 4, None, 4, "General Part", 2), ("gl", 5, 4, 5, "1.1 General", 2),
    ]
    return spark.createDataFrame(pages, "source string, page int, text string"), spark.createDataFrame(nodes, "source string, node_id long, parent_id long, ord long, title string, page int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tables(store):
    d = {r.ecli: r for r in store.read("decisions").collect()}
    assert len(d) == 2 and (d["A"].case_number, d["A"].language, d["A"].available_languages, d["A"].headword, d["A"].keywords, d["A"].has_headnote) == ("T 0664/16", "de", "en,de", "HW-de", "k1-de\nk2-de", 1)
    assert (d["B"].case_number, d["B"].keywords, d["B"].ipc, d["B"].has_headnote, d["B"].appeal_num, d["B"].decision_date) == ("G 0001/19", "", "", 0, "1", "2019-11-21")
    a, b = d["A"].id, d["B"].id
    assert rows(store.read("decision_texts").select("decision_id", "lang", "is_original")) == [(a, "de", 1), (a, "en", 0), (b, "en", 1)]
    assert rows(store.read("decision_texts").filter(F.col("decision_id") == a).select("lang", "reasons")) == [("de", "eins"), ("en", "one  two\n\nthree")]
    assert rows(store.read("decision_provisions")) == sorted([(a, "Art. 123(2) EPC", "EPC2000_Art_123(2)_(2007)"), (a, "R. 57a EPC", "EPC1973_R_057a"), (b, "Guidelines only", "Guidelines only")], key=repr)
    assert rows(store.read("decision_citations")) == [(a, "T 0001/15")] * 2
    held = store.read("chunks").filter("kind <> 'book'").select("decision_id", "kind", "lang", "text")
    assert rows(held) == sorted([(a, "essence", "de", "HW-de\n\nk1-de\nk2-de\n\nLeitsatz"), (a, "reasons", "de", "eins"), (b, "essence", "en", "HW-g")], key=repr)
    meta = store.meta()
    assert meta["documents_parsed"] == "4" and meta["data_version"] == "v7" and store.is_indexed()


def test_inline_text_can_be_kept():
    assert decision_xml.read_document(DOCUMENTS[0], keep_inline=True)["reasons"] == "one bold two\n\nthree"


def test_sections(store):
    s = {r.section_id: r for r in store.read("book_sections").collect()}
    assert set(s) == {"II.A.1", "II.A.2", "II.A.3.1", "II.A.3.1 (2)", "A-II, 1.1", "Gen, 1.1"}
    assert "example section" in s["II.A.1"].body and "Other text" not in s["II.A.1"].body
    assert "Continued text" in s["II.A.2"].body and s["II.A.2"].page_to == 11 and "xiv" not in s["II.A.2"].body
    assert "Guidelines for Examination" not in s["A-II, 1.1"].body
    chunk = store.read("chunks").filter("kind = 'book'").orderBy("book_section_id").first()
    assert chunk.text.startswith("II. PATENTABILITY > A. Inventions > 1. First\n\n") and chunk.lang == "en"


def test_a_heading_above_leaves_no_text(spark):
    long = "Words that fill more than forty characters of a page."
    pages = spark.createDataFrame([("gl", 1, f"Beta\n{long}\nAlpha\n{long}")], "source string, page int, text string")
    nodes = spark.createDataFrame([("gl", 1, None, 1, "Alpha", 1), ("gl", 2, None, 2, "Beta", 1)], "source string, node_id long, parent_id long, ord long, title string, page int")
    assert [(r.section_id, r.body) for r in outline.sections(pages, nodes).collect()] == [("Beta", f"Beta\n{long}\nAlpha\n{long}")]


def test_sections_are_loaded_again_or_left(spark, tmp_path):
    store, (pages, nodes) = Store(spark, str(tmp_path)), book(spark)
    jobs.index_sections(store, pages, nodes)
    ids = rows(store.read("book_sections").select("id", "section_id"))
    jobs.index_sections(store, pages, nodes, skip_present=True)
    assert rows(store.read("book_sections").select("id", "section_id")) == ids
    jobs.index_sections(store, pages, nodes)
    assert sorted(x[1] for x in rows(store.read("book_sections").select("id", "section_id"))) == sorted(x[1] for x in ids)
    index, stats = segments.live(store, "section")
    held = {r.row_id for r in stats.collect()}
    assert held == {r.row_id for r in index.select("row_id").distinct().collect()} == {r.id for r in store.read("book_sections").collect()}


def test_scan_splits_files_and_ignores_comments(spark, tmp_path):
    texts = [document("en", "en", f"E{i}", "T", str(i), "2019", headword=f"h{i}" + "x" * (i % 90), reasons=f"<p>first\nline {i} <![CDATA[<ep-appeal-decision a> & ]]></p>") for i in range(300)]
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<!-- <ep-appeal-decision lang='en'> -->\n<root>\n" + "\n".join(texts) + "\n</root>\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        docs = decision_xml.scan(spark, str(tmp_path / "a.xml"))
        assert docs.rdd.getNumPartitions() > 5
        found = docs.orderBy("ord").select("ecli", "reasons").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ecli, r.reasons) for r in found] == [(f"E{i}", f"first\nline {i} <ep-appeal-decision a> &") for i in range(300)]


def test_close_tags_are_read_as_a_parser_reads_them(spark, tmp_path):
    from xml.etree import ElementTree

    r = random.Random(5)
    close = "</ep-appeal-decision>"
    odd = [f"<!-- {close} <ep-appeal-decision> -->", f"<![CDATA[{close} <!-- <? ]] >]]>", f"<?x {close} <![CDATA[ ?>", f"<q-ep>{'y' * 400}</q-ep>", "<ep-appeal-decisions/><ep-appeal-decisions></ep-appeal-decisions>", f"<!--{(close + chr(10) + 'z' * 70) * 12}-->", "", "-->", "?&gt; ]]"]
    texts = []
    for i in range(400):
        inside = "".join(r.choice(odd) for _ in range(r.randrange(4)))
        made = document("en", "en", f"E{i}", "T", str(i), "2019", reasons=f"<p>a{i} {inside} b</p>")
        texts.append(r.choice(["", "\n", odd[0], odd[2], odd[5]]) + made[: -len(">")] + r.choice(["", " ", "\n\t"]) + ">")
    parsed = {}
    for n in range(3):
        whole = "<?xml version='1.0'?><!-- " + close + " -->\n<root>" + "".join(texts[n::3]) + f"<!-- {close} --></root>" + odd[0]
        (tmp_path / f"{n}.xml").write_text(whole, encoding="utf-8")
        for d in ElementTree.fromstring(whole).iter("ep-appeal-decision"):
            parsed[d.find(".//ep-ecli").text] = decision_xml.read_document(ElementTree.tostring(d, encoding="unicode"))["reasons"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("6000", "65536"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = decision_xml.scan(spark, str(tmp_path / "*.xml")).select("ord.path", "ecli", "reasons", "ord").orderBy("ord").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(found) == 400 and {x.ecli: x.reasons for x in found} == parsed
        for n in range(3):
            assert [x.ecli for x in found if x.path.endswith(f"/{n}.xml")] == [f"E{i}" for i in range(n, 400, 3)]
    (tmp_path / "b.xml").write_text(texts[0] + "<!-- <ep-appeal-decision> " + close)
    with pytest.raises(Exception, match="not closed"):
        decision_xml.scan(spark, str(tmp_path / "b.xml")).collect()


def test_newest_source_looks_upwards(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "EPDecisions_1.xml").write_text("<root/>")
    assert decision_xml.newest_source(spark, str(tmp_path / "a" / "b")).endswith("EPDecisions_1.xml")
    assert decision_xml.newest_source(spark, str(tmp_path / "a" / "b"), parents=False) is None


def test_the_index_follows_added_and_changed_documents(spark, tmp_path):
    path = str(tmp_path / "store")
    (tmp_path / "1.xml").write_text("<root>" + DOCUMENTS[0] + "</root>")
    store = jobs.index(spark, str(tmp_path / "1.xml"), path)
    before = rows(store.read("decision_texts").select("id", "decision_id", "lang"))
    (tmp_path / "0.xml").write_text("<root>" + DOCUMENTS[2] + "</root>")
    jobs.index(spark, str(tmp_path / "0.xml"), path, incremental=True)  # only added
    now = rows(store.read("decision_texts").select("id", "decision_id", "lang"))
    assert len(now) == 2 and now[0] == before[0] and store.meta()["documents_parsed"] == "1"
    jobs.index(spark, str(tmp_path / "1.xml"), path, incremental=True)  # nothing new
    (tmp_path / "2.xml").write_text("<root>" + DOCUMENTS[1] + "</root>")
    jobs.index(spark, str(tmp_path / "2.xml"), path, incremental=True)  # the original changes the headword of a text that was there
    index = lambda: [rows(t.drop("seg")) for t in segments.live(store, "decision")]
    kept = index()
    jobs.rebuild_text_index(store)
    assert kept == index() and len(segments.segments(store, "decision")) == 1
    assert Library(store).search_decisions("HW-de", mode="lexical")["total"] == 1


def test_a_change_keeps_what_readers_planned_on(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.range(3))
    planned = store.read("t")
    assert store.append("t", spark.range(3, 5)) and not store.append("t", spark.range(0))
    assert planned.count() == 3 and store.read("t").count() == 5
    store.append("t", spark.range(1).withColumn("more", F.lit("x")))
    assert rows(store.read("t").filter("more is not null")) == [(0, "x")] and store.read("t").count() == 6
    store.replace("t", spark.range(1))
    store.replace("t", spark.range(2))
    left = sorted(x.name for x in (tmp_path / "t").iterdir() if not x.name.startswith("."))
    assert [x for x in left if x.startswith("_")] == ["_current-4", "_current-5"] and len(left) == 4
    (tmp_path / "t" / "_current-6").write_text("{")  # a writer that was lost
    assert store.read("t").count() == 2


def test_command_line(store, spark, tmp_path, monkeypatch):
    from docketlake import __main__ as cli
    from docketlake.smoke import smoke

    embed = jobs.hashing_embedder()
    assert smoke(Library(store, lambda q: embed([q])[0])) == []
    assert smoke(Library(Store(spark, str(tmp_path / "none")))) == ["the store is indexed"]
    pages, nodes = book(spark)
    pages.write.parquet(str(tmp_path / "pages"))
    nodes.write.parquet(str(tmp_path / "nodes"))
    (tmp_path / "EPDecisions_9.xml").write_text("<root>" + "".join(DOCUMENTS) + "</root>")
    books = ["--pages", str(tmp_path / "pages"), "--outline", str(tmp_path / "nodes")]
    cli.main(["index", str(tmp_path / "s"), "--source", str(tmp_path), *books])
    made = Store(spark, str(tmp_path / "s"))
    assert made.read("decisions").count() == 2 and made.read("book_sections").count() == 6
    cli.main(["index", str(tmp_path / "s"), "--books", *books])
    cli.main(["embed", str(tmp_path / "s")])
    with pytest.raises(SystemExit) as end:
        cli.main(["smoke", str(tmp_path / "s")])
    assert end.value.code == 0
    (tmp_path / "book.pdf").write_bytes(b"%PDF")
    monkeypatch.setattr("docketlake.jobs.extract_for_test", lambda content: (["Alpha\n" + "word " * 20], [(1, None, 1, "Alpha", 1)]), raising=False)
    cli.main(["index", str(tmp_path / "s"), "--books", "--gl", str(tmp_path / "book.pdf")])  # nothing in it
    assert made.read("book_sections").count() == 6
    cli.main(["index", str(tmp_path / "s"), "--books", "--gl", str(tmp_path / "book.pdf"), "--extractor", "docketlake.jobs:extract_for_test"])
    assert [r.section_id for r in made.read("book_sections").filter("source = 'gl'").collect()] == ["Alpha"]


def test_leaves(spark):
    found = outline.leaves(book(spark)[1])
    assert rows(found.filter("source = 'clb'").select("place", "title")) == [(1, "1. First"), (2, "2. Second"), (3, "3.1 Third"), (4, "3.1 Missing heading")]


def test_library(store):
    embed = jobs.hashing_embedder()
    lib = Library(store, lambda q: embed([q])[0])
    for mode in ("lexical", "auto"):
        found = lib.search_decisions("T 664/16", mode=mode)
        assert found["results"][0]["case_number"] == "T 0664/16" and found["mode"] == ("lexical" if mode == "lexical" else "hybrid")
    found = lib.search_decisions("leitsatz", mode="lexical", language="de", date_from="2019", date_to="2019-12-31", provision="Rule 57a", only_with_headnote=True)
    assert found["total"] == 1 and "[[Leitsatz]]" in found["results"][0]["snippet"] and found["results"][0]["keywords"] == ["k1-de", "k2-de"]
    assert lib.search_decisions("leitsatz", mode="lexical", language="en")["results"] == []
    assert "error" in lib.search_decisions("  ") and "error" in lib.search_decisions("x", offset=1000) and "error" in lib.search_legal_texts(" ")
    summary = lib.get_decision("t664/2016")
    assert summary["lang"] == "de" and summary["headnote"] == "Leitsatz" and "error" in lib.get_decision("T 1/01") and "error" in lib.get_decision("A", "orders")
    assert lib.get_decision("A", "full", "en")["lengths"]["reasons"] == 15 and lib.get_decision("A", "reasons", "fr")["chunks"][0]["text"] == "eins"
    page = lib.get_passages("A", "fact", "en")
    assert page["total_chunks"] == 0 and page["next_offset"] is None and lib.get_passages("A", "full", "de", limit=1)["chunks"][0]["text"].startswith("HEADNOTE")
    assert lib.search_passages("A", "three", lang="en")["results"][0]["score"] == 11 and lib.search_passages("A", "eins")["mode"] == "hybrid"
    assert lib.search_passages("A", "three", lang="en", mode="vector")["mode"] == "vector_unavailable"
    assert [(r["case_number"], r["in_corpus"]) for r in lib.citations("A")["results"]] == [("T 0001/15", False)] * 2 and lib.citations("G 1/19", "cited_by")["results"] == []
    section = lib.get_section("case_law_book", "ii.a.2")
    assert section["section_id"] == "II.A.2" and [x["section_id"] for x in section["previous"]] == ["II.A.1"] and section["next"][0]["section_id"] == "II.A.3.1"
    assert "error" in lib.get_section("clb", "A_II%") and lib.get_section("gl", "Gen")["section_id"] == "Gen, 1.1"
    provision = lib.lookup_provision("Rule 57a")
    assert provision["decision_count"] == 1 and provision["top_decisions_by_provision_rows"][0]["provision_row_count"] == 1 and provision["book_sections"]
    assert lib.search_legal_texts("paragraph speaks", source="guidelines")["results"][0]["source"] == "gl"


def test_library_without_a_model_that_loads(store):
    def broken(query):
        raise jobs.NoModel("gone")

    for failing in (lambda q: 1 / 0, lambda q: ["not", "numbers"]):  # no answer, and one that the search can't use
        assert Library(store, failing).search_decisions("T 664/16")["mode"] == "lexical"
    lib = Library(store, broken)
    assert lib.search_decisions("T 664/16")["mode"] == "lexical" and lib.search_legal_texts("paragraph speaks")["mode"] == "lexical"
    assert lib.search_passages("A", "eins")["mode"] == "lexical" and lib.search_passages("A", "eins", mode="vector")["mode"] == "vector_unavailable"


def test_reruns_add_nothing_and_repair_keeps(spark, store):
    before = {t: store.read(t).count() for t in ("decisions", "decision_texts", "chunks", "decision_provisions", "decision_citations")}
    jobs.index(spark, store.meta()["decisions_xml"], store.path, incremental=True)
    assert before == {t: store.read(t).count() for t in before}
    assert all(jobs.pending(store, kind).isEmpty() for kind in jobs.STAGES)
    held = rows(store.read("decision_provisions"))
    jobs.fix_provisions(store)
    assert rows(store.read("decision_provisions")) == held
    pages, nodes = book(spark)
    n = store.read("book_sections").count()
    jobs.index_sections(store, pages.filter("source = 'gl'"), nodes.filter("source = 'gl'"))
    assert store.read("book_sections").count() == n
    with pytest.raises(ValueError):
        jobs.embed(store, jobs.hashing_embedder(), "hashing", "nonsense")
    with pytest.raises(ValueError):
        jobs.embed(store, jobs.hashing_embedder(), "another model")
    jobs.embed(store, jobs.hashing_embedder(), "hashing", "book")
    assert jobs.pending(store, "book").isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).select((F.col("id") % 17).alias("k"), "id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("v"))
    events.repartitionByRange(5, "id").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    ingest_new(spark, str(tmp_path / "in"), events.schema, store, "t", ["k"], ["id"], str(tmp_path / "check"), files_at_once=10)
    assert rows(store.read("t")) == sorted([(k, k, f"e{k}") for k in range(17)], key=repr)
    ingest_new(spark, str(tmp_path / "in"), events.schema, store, "t", ["k"], ["id"], str(tmp_path / "check"))
    assert store.read("t").count() == 17


def test_unreadable_store_is_not_indexed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.is_indexed() and "error" in Library(store).search_decisions("x")
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "_current-1").write_text('{"parts": ["v-gone"], "schema": {"type": "struct", "fields": []}}')
    assert not store.is_indexed()


def test_the_registered_ingests_read_documents_that_were_parsed_once(spark):
    from docketlake.oracle import structure

    plan = structure._scanned(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan


def sent_to_all(df):
    """Joins of a plan that send a side to all tasks, but for that of ranges' sizes, a row each (see numbered())."""
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "shiftright(_place" not in x]


def test_no_keys_of_ingested_documents_are_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    """files of keys are small beside their rows, which filled the driver's memory where they were taken by their files' size."""
    from docketlake.oracle import structure
    from docketlake.sources import pieces

    planned = []
    with monkeypatch.context() as m:
        m.setattr(pieces, "cut", lambda df: (planned.append(df), cut(df))[1])
        made = decision_xml.tables(structure._scanned(spark, "/root/testdata/sf0.001"))
    planned += [*made.values(), structure.texts(spark, "/root/testdata/sf0.001"), structure.references(spark, "/root/testdata/sf0.001")]
    assert len(planned) > 8 and not [x for df in planned for x in sent_to_all(df)]


def test_fields_are_found_in_one_walk(monkeypatch):
    """a document's elements are looked through once, and those of its bibliographic data once more, however many fields are read."""
    named = []
    local = decision_xml._local
    monkeypatch.setattr(decision_xml, "_local", lambda tag: (named.append(tag), local(tag))[1])
    decision_xml.read_document(DOCUMENTS[0])
    assert len(named) < 5 * DOCUMENTS[0].count("</")


def test_paths_of_an_outline_are_not_sent_to_all_tasks(spark, monkeypatch):
    """F8: files of long paths are small beside their rows; whole paths aren't joined again, all in one task."""
    planned = []
    monkeypatch.setattr(outline, "cut", lambda df: (planned.append(df), cut(df))[1])
    nodes = spark.range(40).selectExpr("'clb' as source", "id as node_id", "if(id % 20 = 0, null, id - 1) as parent_id", "concat('t', id) as title")
    found = {r.node_id: r.breadcrumb for r in outline.breadcrumbs(nodes).collect()}
    assert found == {n: [f"t{i}" for i in range(n // 20 * 20, n + 1)] for n in range(40)}
    assert len(planned) > 5 and not [x for df in planned for x in sent_to_all(df)]
