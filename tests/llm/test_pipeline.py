"""Each stage against a plain version on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from docketlake.llm.common import cut

from .frames import awkward, frame, prose
from .test_models import counts
from .test_near_dedup import expected

STAGES = dict(pipeline.STAGES)


def table(spark):
    rows = awkward() + [(100 + i, prose(90 + i % 30, i), "en", f"s{i % 3}", 1, "r", 1, "k", 1, 1, 0.1, "p", "s", 1) for i in range(80)]
    rows += [(500 + i, prose(90 + i % 30, i) + " tail", "en", "s1", 1, "r", 1, "k", 1, 1, 0.1, "p", "s", 1) for i in range(0, 80, 9)]
    return frame(spark, rows)


def key(r):
    return repr(tuple(r))


def test_quality_drops_what_fails_and_keeps_the_clean(spark):
    docs = table(spark)
    out = STAGES["quality_rules"](spark, docs, "")
    fails = lambda t: (n := counts(t))[0] < 10 or 100 * n[4] > 20 * n[0]
    assert out.columns == docs.columns
    kept = sorted(map(key, out.collect()))
    assert set(kept) <= {key(r) for r in docs.collect() if not fails(r.text)}
    assert {key(r) for r in docs.filter("doc_id >= 100").collect()} <= set(kept)


def test_one_of_each_group_stays(spark):
    docs = table(spark)
    out = STAGES["minhash_near_dedup"](spark, docs, "").collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    kept = {i for i, _, _, k in want if k and i is not None}
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert set(ids) == kept and ids.count(3) == 0 and ids.count(9) == 1
    assert sum(r.doc_id is None for r in out) == 2


def test_secrets_are_replaced(spark):
    out = {r.doc_id: r for r in STAGES["secret_scan"](spark, frame(spark), "").collect()}
    assert len(STAGES["secret_scan"](spark, frame(spark), "").collect()) == len(awkward())
    assert "0123456789abcdef" not in out[12].text and out[12].n_chars == len(out[12].text)
    assert out[4].text is None and out[5].text == ""


def test_mix_repeats_whole_rows(spark):
    docs = table(spark)
    out = STAGES["mix_sources"](spark, docs, "")
    assert out.columns == docs.columns and {key(r) for r in out.collect()} <= {key(r) for r in docs.collect()}


def test_mix_by_plain_streams(spark):
    """How often each document is taken, and in which order, from the schedules alone."""
    rows = [(i, None if i % 50 == 0 else prose(1 + i * 7 % 60, i), "en", ["a", "b", "b", "b", None][i % 5]) for i in range(400)]
    docs = spark.createDataFrame([(*r, 0, "r", 1, "k", 1, 1, 0.1, "p", "s", 1) for r in rows], frame(spark).schema)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    order = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:15], 16)
    total = {s: sum(size[i] for i in source if source[i] == s) for s in ("a", "b", None)}
    share = sum(total.values()) / 8
    target = {s: w * share for s, w in zip(("a", "b", None), (5, 2, 1))}
    if target["a"] > 3 * total["a"]:
        rest = sum(total.values()) - 3 * total["a"]
        target = {"a": 3.0 * total["a"], "b": rest * 2 / 3, None: rest / 3}
    assert all(target[s] <= 3 * total[s] for s in target)
    time = {"a": lambda q: 2 * q / (1.2 + (1.44 - 0.8 * q) ** 0.5), "b": lambda q: q, None: lambda q: q**0.5}
    want = []
    for s in total:
        begin, passes = 0, int(target[s] // total[s])
        for i in sorted((i for i in source if source[i] == s), key=order):
            middle = begin + size[i] / 2
            copies = passes + (middle < target[s] - passes * total[s])
            want += [(round(time[s](min(1.0, (j * total[s] + middle) / target[s])), 9), order(i), i) for j in range(copies)]
            begin += size[i]
    out = [r.doc_id for r in STAGES["mix_sources"](spark, docs, "").collect()]
    assert Counter(out) == Counter(i for _, _, i in want)
    place = {i: p for p, _, i in sorted(want, reverse=True)}  # the first of each
    firsts = list(dict.fromkeys(out))
    assert all(place[a] <= place[b] + 1e-8 for a, b in zip(firsts, firsts[1:]))


def test_tokens_of_every_row(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = STAGES["bpe_encode"](spark, frame(spark), "").collect()
    ids = lambda t: b"".join(i.to_bytes(4, "little") for i in library.encode(t or "", add_special_tokens=False).ids)
    assert len(out) == len(awkward()) and all(bytes(r.ids) == ids(r.text) and len(r.ids) == 4 * r.n_tokens for r in out)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_input(spark, name):
    assert STAGES[name](spark, frame(spark, []).limit(0), "").count() == 0


def test_whole_run(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = cut(spark.read.parquet(str(tmp_path / "documents.parquet")))
    for stage in STAGES.values():
        docs = cut(stage(spark, docs, str(tmp_path)))
    assert sorted(map(key, docs.select("doc_id", "ids").collect())) == sorted(map(key, pipeline.run(spark, str(tmp_path)).select("doc_id", "ids").collect()))
