"""op11 against plain counting."""

import random
import re
from collections import Counter

import pytest

from docketlake.llm.phrases import ROW_BITS, collocations, score

from .frames import awkward, frame

SCHEMA = "doc_id long, text string, lang string"


def expected(rows, least, longest, most):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p for p, a in f.items() if a >= least and len(p[1]) > 1}
    longer = {}  # the greatest count of the candidates that hold a phrase, of any greater length
    for lang, q in candidates:
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                longer[lang, q[i : i + k]] = max(longer.get((lang, q[i : i + k]), 0), f[lang, q])
    out = {}
    for lang, p in candidates:
        a = f[lang, p]
        if longer.get((lang, p), 0) < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def texts(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "a\0", "a", "a\1", "\1", "é", "É", "ÿ", "x\x0bz", "b-c", " ", "日本"]
    fixed = "one two three four five six"
    out = []
    for _ in range(120):
        parts = [r.choice([*words, fixed, "the of the of", "a a a a", "one two", "\t", ",", "\n", "  "]) for _ in range(r.randrange(0, 40))]
        out.append((" ".join(parts), r.choice(["en", "en", "en", "de", None, "und", ""])))
    return out + [(None, "en"), ("", "de"), (" \t ", None), (("w " * 3000) + "end", "en")]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_by_brute_force(spark, batch):
    rows = texts(3)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # small batches cut prefixes everywhere
    try:
        for least, longest, most in ((3, 5, 2000), (8, 3, 10)):
            got = sorted(map(tuple, collocations(df, least=least, longest=longest, most=most, bits=16).collect()))
            assert got == expected(rows, least, longest, most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_awkward_rows_many_copies_and_none(spark):
    rows = awkward() * 30 + [(i, "hot phrase of all rows, hot phrase", "en", *awkward()[0][3:]) for i in range(500)]
    want = expected([(r[1], r[2]) for r in rows], 20, 5, 2000)
    assert sorted(map(tuple, collocations(frame(spark, rows), least=20, bits=18).collect())) == want
    assert collocations(frame(spark).limit(0)).collect() == []


def test_bins_that_collide_leave_nothing_out(spark):
    rows = texts(5)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA)
    one, many = (sorted(map(tuple, collocations(df, least=5, bits=b).collect())) for b in (ROW_BITS, 24))
    assert one == many == expected(rows, 5, 5, 2000)


def test_arithmetic_beyond_64_bits(spark):
    huge = 10**14
    made = spark.createDataFrame([(huge, huge - 7, huge - 9, huge * 9)], "a long, l long, r long, n long").select(score()).first()[0]
    assert made == 1000 * huge * huge * 9 // ((huge - 7) * (huge - 9))
