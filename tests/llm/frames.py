"""Small tables with every awkward case, shared by the tests."""

import random

#: Columns of documents, and others whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, kept string, doc long, bucket int, position double, places string, score string, `a.b` int"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(120, 1)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, near, "de", "s2"), (3, near, "de", "s2"), (4, None, "en", None), (5, "", None, "s1"), (6, "  \n\t ", "fr", "s3"), (7, "one", "en", "s1"),
        (8, "ONE", "en", "s1"), (None, base, "en", "s2"), (None, "two words", None, None), (9, prose(5000, 2), "en", "s1"), (10, "a b " * 300, "en", "s4"), (11, "line one\nline one\nline two\n" * 3, "es", "s5"),
        (12, 'token = "0123456789abcdef0123456789abcdef01234567" end', "en", "s1"), (13, "é 日本 😀 \x1c\x85\xa0 x<|endoftext|>y", "de", "s2"), (14, prose(60, 3) + " " + " ".join(words[20:80]), "en", "s3"),
        (15, base + " tail", None, "s1"), (9, "another text under the same id", "en", "s1"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "r", 1, "k", -1, 2, 0.5, "p", "s", 3) for i, t, lang, source in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def plain(spark, pairs):
    return spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string")


def pairs():
    return [(r[0], r[1]) for r in awkward()]
