"""op6 against all pairs, and components against union-find."""

import random

import pytest

from docketlake.llm import minhash
from docketlake.llm.components import connected_components
from docketlake.llm.minhash import near_duplicates

from .frames import frame, pairs, plain, prose


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def expected(rows, width, percent):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_awkward_rows(spark, width):
    assert got(near_duplicates(frame(spark), width=width)) == expected(pairs(), width, 80)


def test_families_left_in_several_components(spark, monkeypatch):
    """Chains of edits: neighbours are linked, ends aren't, and some members are linked with none."""
    for bound, value in {"BLOCK_MEMBERS": 3, "BLOCK_SHINGLES": 900, "TASK_ROWS": 20, "TASK_SHINGLES": 2000}.items():
        monkeypatch.setattr(minhash, bound, value)
    r, rows = random.Random(6), []
    for family in range(3):
        words = prose(150, 50 + family).split()
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            source = words if step % 3 else words[:]
            for _ in range(r.choice([2, 5, 9])):
                source[r.randrange(150)] = f"n{r.randrange(10**6)}"
            words = source
    rows += [(i, rows[(i * 7 + 31) % 75][1]) for i in range(0, 75, 9)]  # ids with a second text, of another family
    assert got(near_duplicates(plain(spark, rows), width=2)) == expected(rows, 2, 80)


def test_empty_table(spark):
    assert near_duplicates(plain(spark, []).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i * 7) % 30) for i in range(30)]
    r.shuffle(edges)
    found = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in list(parent) if find(x) != x}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
