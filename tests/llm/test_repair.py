"""op12 against a plain search of all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from docketlake.llm import repair
from docketlake.llm.q_repair import damaged, repaired_digests

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def searched(turns):
    """(cost, audit, repaired turns) of the best edits by trying all of them: the least cost, then the least string."""

    @lru_cache(None)
    def best(i, made, inserted):
        options = []
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", made):
            options.append((0, "", ()))
        if inserted < 2:
            options += [(c + 2, "I" + a, ((role, ""), *r)) for role in ("user", "assistant") if ok(made + role[0]) for c, a, r in [best(i, short(made + role[0]), inserted + 1)]]
        if i < len(turns):
            role, text, gone, cut = turns[i]
            c, a, r = best(i + 1, made, 0)
            options.append((c + 3, "D" + a, r))
            if not gone:
                if role and ok(made + role[0]):
                    c, a, r = best(i + 1, short(made + role[0]), 0)
                    options.append((c + cut, "K" + a, ((role, text), *r)))
                for new in ("user", "assistant"):
                    if ok(made + new[0]):
                        c, a, r = best(i + 1, short(made + new[0]), 0)
                        options.append((c + 2 + cut, "R" + a, ((new, text), *r)))
        return min(options, default=(10**9, "", ()))

    ok = lambda s: re.fullmatch("s?(ua)*u?", s) is not None
    short = lambda s: re.sub("(ua)+", "ua", s)
    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def expected(rows):
    out = []
    for conv, kept in damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, role, text in kept:
            inner = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            turns.append((role, text, fault in (0, 1), int(fault == 2)))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[0][:1] for t in turns]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit, made = searched(turns)
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, most, conv=lambda r, i: i):
    r, rows = random.Random(seed), []
    for i in range(n):
        rows += [
            (conv(r, i), r.choice([j, j, j, j + 1, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No", "Why?\n", "", None, " \t", "é!", "\x1c", "Sure. ", f"t{r.randrange(99)}."]))
            for j in range(r.randrange(1, most))
        ]
    return rows


@pytest.fixture
def ranges(spark):
    """Ranges stay small, so that conversations are cut."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def got(df):
    return sorted(map(tuple, repaired_digests(df).collect()), key=repr)


def test_by_search(spark):
    rows = conversations(1, 150, 9) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (-5, None, None, None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_conversations_cut_by_ranges(spark, ranges):
    rows = conversations(2, 12, 60, lambda r, i: None if r.random() < 0.7 else i)
    df = spark.createDataFrame(rows, SCHEMA)
    assert repair.repair_conversations(damaged(df)).filter("long").count() > 2
    assert got(df) == expected(rows)


def test_one_turn_repeated_everywhere(spark, ranges):
    rows = [(7, 3, "user", "Same.")] * 150 + [(7, 4, "assistant", "Same.")] * 3 + [(8, 1, "user", "Hi.")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_all_dropped_and_none(spark):
    dropped = [i for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows = [(i, 0, "user", "Hi.") for i in dropped]
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted([(i, 0, 0, 0, 0, 0, 0, "", empty) for i in dropped], key=repr)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_turns_are_rebuilt_and_names_may_clash(spark):
    rows = [("x", 1, "user", "Hi", 1), ("x", 2, "user", "There.", 2), ("x", 3, "assistant", "Well.", 3)]
    df = spark.createDataFrame(rows, "`conv.id` string, pos long, role string, text string, again int")
    row = repair.repair_conversations(df, conv="conv.id", turn="pos").first()
    assert (row.conv, row.audit, row.cost, [tuple(t) for t in row.turns]) == ("x", "DKK", 3, [("user", "There."), ("assistant", "Well.")])
    assert df.select(F.count("*")).first()[0] == 3
