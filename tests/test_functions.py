"""Pure functions on fixed vectors and properties."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.functions import casenum, legalref
from docketlake.functions.chunker import SplitText, split_text
from docketlake.functions.text import assembled, fold, ipc_code, iso_date, journal_reference, tokens_of
from docketlake.functions.vectors import cosine, dot, from_float32, l2
from docketlake.operators.match import And, Or, Phrase, compile_query
from docketlake.operators.snippet import best_window

RAW = {
    "EPC2000_Art_123(2)_(2007)": "Art. 123(2) EPC", "RPBA_2020_Art_013(2)": "Art. 13(2) RPBA", "EPC1973_R_057a": "R. 57a EPC", "REE_Art_008(b)": "Art. 8(b) REE", "EPC1973_Art_000": "Art. 0 EPC",
    "VOBK_Art_012(4)_Sent_3": "Art. 12(4) RPBA", "EPC_Art_069_Protocol_Interpretation": "Art. 69 EPC", "PCT2003_Rule_4.10": "R. 4.10 PCT", "EPC2000_Art_123_foo": "EPC2000_Art_123_foo",
    " Guidelines only ": "Guidelines only", "": "", None: "",
}
TYPED = {
    "Rule 103(1)(a)": "R. 103(1)(a) EPC", "Art. 13(2) RPBA 2020": "Art. 13(2) RPBA", "Rule 4.10 PCT": "R. 4.10 PCT", "Article 112a(2)(c)": "Art. 112a(2)(c) EPC", "R 103": "R. 103 EPC",
    "inventive step": "inventive step",
}
CASES = {"T 0664/16": "T 0664/16", "t664/2016": "T 0664/16", " G 1 / 19 ": "G 0001/19", "T 1/123": "T 0001/23", "X 1/19": None, "T 12345/16": None, "": None, None: None}


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_codes(spark):
    assert column(spark, RAW, legalref.normalise_raw) == [*RAW.values()]
    assert column(spark, TYPED, legalref.normalise_typed) == [*TYPED.values()]
    assert column(spark, CASES, casenum.parse_case) == [*CASES.values()]
    assert column(spark, ["R. 103 EPC", "Art. 123(2) EPC"], legalref.prose_variants) == [["R. 103", "Rule 103"], ["Art. 123(2)"]]
    assert column(spark, ["see T 664/16 and g 1/2019; XT 1/12"], casenum.inline_cases) == [["T 0664/16", "G 0001/19"]]


def test_case_numbers_are_never_cut(spark):
    assert spark.range(1).select(casenum.format_case(F.lit("T"), F.lit("12345"), F.lit(2016))).first()[0] == "T 12345/16"


def test_fields(spark):
    assert column(spark, ["20191121", "2019112", "20191340", None], iso_date) == ["2019-11-21", None, None, None]
    assert column(spark, ["Ärger ÉCOLE ﬁ Straße"], fold) == ["arger ecole ﬁ straße"] and tokens_of("Ärger, Art.123(2)") == ["arger", "art", "123", "2"]
    lit = F.lit
    assert (ipc_code("A", "61", "K", "31", "00"), ipc_code(None, "61", "K", "31", "0"), ipc_code("A", None, "K", None, ""), journal_reference(None, "2019"), journal_reference("12", "2019"), journal_reference("12", None)) == ("A61K31/00", "", "AK/", None, "OJ EPO 2019 12", "OJ EPO  12")
    assert spark.range(1).select(assembled({"headnote": lit("h"), "facts": lit(" "), "reasons": lit("r")})).first()[0] == "HEADNOTE\n\nh\n\nREASONS\n\nr"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0])], "a array<double>, b array<double>")
    x = df.select(dot(F.col("a"), F.col("b")).alias("d"), l2(F.col("a"), F.col("b")).alias("l"), cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert (x.d, round(x.l, 9), round(x.c, 9)) == (4.0, round(6**0.5, 9), round(4 / (3 * 5**0.5), 9))
    blob = spark.createDataFrame([(b"\x00\x00\x80?\x00\x00\x00@",)], "b binary")
    assert blob.select(from_float32(F.col("b"))).first()[0] == [1.0, 2.0]


@pytest.mark.parametrize("sep", ["\n\n", "\n"])
def test_chunks_cover_the_text(sep):
    r = random.Random(5)
    for _ in range(200):
        text = sep.join(" ".join("w%d" % r.randrange(1000) for _ in range(r.choice([1, 20, 90, 700]))) for _ in range(r.randrange(1, 12)))
        pieces = split_text(text)
        assert all(0 < len(p) <= 1802 for p in pieces) and {w for p in pieces for w in p.split()} == set(text.split())
        assert pieces == [text] if len(text) <= 1600 else len(pieces) > 1
    assert split_text(None) == split_text(" \n ") == []


def test_chunker_as_table_function(spark):
    spark.udtf.register("split_text", SplitText)
    spark.createDataFrame([(1, "a " * 1500)], "id int, body string").createOrReplaceTempView("bodies")
    rows = spark.sql("select id, seq, piece from bodies, lateral split_text(body)").collect()
    assert [r.seq for r in rows] == [0, 1] and " ".join(r.piece for r in rows).split() == ["a"] * 1500


def test_query_trees():
    assert compile_query("T 664/16") == Phrase(("t", "0664", "16"), column="case_number")
    assert compile_query('"late filed - requests"') == Phrase(("late", "filed", "requests"))
    assert compile_query("Art. 123(2) is - x") == And((Phrase(("art",), prefix=True), Phrase(("123", "2"), prefix=True), Phrase(("is",)), Phrase(("x",))))
    case = Phrase(("t", "0664", "16"))
    assert compile_query("late T 664/16") == Or((Phrase(("late",), prefix=True), Or((case, Phrase(case.tokens, column="case_number")))))
    assert compile_query(" - ") is None and compile_query("") is None and compile_query('""') is None
    assert compile_query("late T 664/16").to_match_string() == '"late"* OR ("t 0664 16" OR case_number : "t 0664 16")'


def test_snippets():
    words = [f"x{i}" for i in range(40)]
    words[20], words[21] = "Späte", "Anträge"
    text = " ".join(words)
    found = best_window(["nothing", text], ["a", "b"], [Phrase(("spate", "antr"), prefix=True)])
    assert found.startswith("...") and found.endswith("...") and "[[Späte Anträge]]" in found
    assert best_window([None, ""], ["a", "b"], [Phrase(("x",))]) == ""


def test_embedder_of_model_files(monkeypatch, tmp_path):
    """Ids, mask, mean and length, with stand-ins for the libraries; a failed load is remembered, absent files aren't."""
    import sys
    import types

    import numpy as np

    from docketlake.jobs import NoModel, onnx_embedder

    calls, fail = [], [True]

    class Session:
        def __init__(self, path):
            calls.append(path)
            if fail[0]:
                raise OSError("broken")

        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def run(self, _, feeds):
            assert set(feeds) == {"input_ids", "attention_mask"}
            self.seen = feeds["input_ids"].tolist()
            return [np.stack([feeds["input_ids"], feeds["input_ids"] * 0 + 1], axis=2).astype(float)]

    pieces = types.SimpleNamespace(encode=lambda texts: [[0 if c == "?" else ord(c) - 96 for c in t] for t in texts])
    monkeypatch.setitem(sys.modules, "onnxruntime", types.SimpleNamespace(InferenceSession=Session))
    monkeypatch.setitem(sys.modules, "sentencepiece", types.SimpleNamespace(SentencePieceProcessor=lambda model_file: pieces))
    model, tokenizer = tmp_path / "m", tmp_path / "t"
    embed = onnx_embedder(str(model), str(tokenizer), most_tokens=4)
    with pytest.raises(NoModel, match="no model"):
        embed(["a"])
    model.touch(), tokenizer.touch()
    for _ in range(2):
        with pytest.raises(NoModel, match="broken"):
            embed(["a"])
    assert len(calls) == 1
    fail[0] = False
    a, b = onnx_embedder(str(model), str(tokenizer), most_tokens=4)(["ab?c", "a"])
    want = lambda ids: [np.mean(ids) / np.hypot(np.mean(ids), 1), 1 / np.hypot(np.mean(ids), 1)]
    assert np.allclose(a, want([0, 2, 3, 2])) and np.allclose(b, want([0, 2, 2]))


def test_provisions_of_keys_longer_than_three_digits_stay_whole(spark, tmp_path):
    from docketlake.oracle.passages import legal_refs

    rows = [(1, n, key) for n in (1, 2, 3) for key in (0, 42, 1234)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.provision for r in legal_refs(spark, str(tmp_path)).collect()}
    # the third kind is cut to three digits, as lpad() of its SQL does
    assert found == {"R. 0a RPBA", "R. 42a RPBA", "R. 1234a RPBA", "EPC_Art_000_foo", "EPC_Art_042_foo", "EPC_Art_123_foo", "Art. 0(3) EPC", "Art. 42(3) EPC", "Art. 1234(3) EPC"}


def test_a_version_in_the_language_asked_for_goes_before_an_original_in_it(spark):
    from docketlake.operators.ranking import fallback

    rows = spark.createDataFrame([(1, "d", "fr", 1), (2, "d", "fr", 0), (3, "e", "fr", 1), (4, "f", "de", 0), (5, "f", "de", 1)], "id long, k string, lang string, is_original int")
    got = lambda **x: {r.k: r.id for r in fallback(rows, "k", "fr", **x).collect()}
    assert got(version_first=True) == {"d": 2, "e": 3, "f": 5} and got() == {"d": 1, "e": 3, "f": 5}


def test_tokens_are_counted_as_they_are_cut(spark):
    """All characters, alone, inside words and after marks."""
    from docketlake.functions.text import tokens, tokens_in

    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    all_ = spark.range(0, 0x110000, 1, 4).filter("id < 55296 or id > 57343").select(F.explode(F.array(character, F.concat(F.lit("a"), character, F.lit("b́ ́")), F.concat(F.lit("́"), character, character))).alias("t"))
    assert all_.filter(~F.size(tokens(F.col("t"))).eqNullSafe(tokens_in(F.col("t")))).count() == 0
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("áb c",)], "t string").select(tokens_in(F.col("t"))).collect()] == [0, 0, 2]
