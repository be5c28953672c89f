"""Repair of conversations by the cheapest edits that make their roles take turns.

The roles' initials of a sound conversation read ``(s?(ua)+)?``. Turns are kept,
given another role, deleted, or inserted; the cheapest edits are found by a
backward pass that holds the cost to go from every turn and state of that
grammar, and a forward walk that takes, among the edits that keep to the least
cost, the first by initial (Delete, Insert, Keep, Rerole).

Turns are sorted by ranges of (conversation, turn), so a conversation of any
length lies in consecutive ranges. One that lies in several is cut there: each
part's costs from state to state are a 4 by 4 matrix, the parts' matrices give
the cost to go at each cut, and each part's walks from all four states give the
state at each cut. Parts are bounded by a range; what is gathered of a
conversation is one matrix for each range that it lies in.

Defined results: a null conversation is one of its own; null roles and texts
are one space; null turns come first; turns that tie are ordered by role and
SHA-256 of the text; a role without one of the initials s, u, a can't be kept;
an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import by_key
from .common import SPACES, cut, name

#: Costs of edits and of a truncated turn that stays (fixed values).
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after s, after u, after a; where the initials lead, and the role that comes next (fixed values).
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = ("user", "user", "assistant", "user")
AFTER = tuple(STEPS[s][NEXT[s][0]] for s in range(4))
#: The cost to go after the last turn: what is left of a pair is inserted.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
#: Pairs of neighbours' initials that are as they should be (fixed values).
LEGAL = ("su", "ua", "au")


def costs_to_go(turns: list[tuple[str, bool, bool]], end: list[int]) -> list[list[int]]:
    """For each of turns (initial, must go, truncated) and the end, the least cost from each state on; end: that after the last turn."""
    table = [list(end)] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        then, (initial, must_go, truncated) = table[i + 1], turns[i]
        best = [DELETE + c for c in then]
        if not must_go:
            for s in range(4):
                best[s] = min(best[s], REROLE + truncated * TRUNCATED + then[AFTER[s]])
                if initial in STEPS[s]:
                    best[s] = min(best[s], truncated * TRUNCATED + then[STEPS[s][initial]])
        u, a = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
        table[i] = [min(best[0], INSERT + u), min(best[1], INSERT + u), u, a]
    return table


def walked(turns: list[tuple[str, bool, bool]], table: list[list[int]], state: int) -> tuple[list[tuple[str, int, str]], int]:
    """The first by initials of the cheapest edits (initial, turn, role given) from a state on, and the state they end in."""
    edits, i = [], 0
    while i < len(turns):
        left, then, (initial, must_go, truncated) = table[i][state], table[i + 1], turns[i]
        if left == DELETE + then[state]:
            edits.append(("D", i, ""))
            i += 1
        elif left == INSERT + table[i][AFTER[state]]:
            edits.append(("I", i, NEXT[state]))
            state = AFTER[state]
        else:
            kept = initial in STEPS[state] and left == truncated * TRUNCATED + then[STEPS[state][initial]]
            edits.append(("K", i, "") if kept else ("R", i, NEXT[state]))
            state = STEPS[state][initial] if kept else AFTER[state]
            i += 1
    return edits, state


def finished(state: int) -> list[tuple[str, int, str]]:
    """The insertions that complete a pair after the last turn."""
    edits = []
    while END[state]:
        edits.append(("I", -1, NEXT[state]))
        state = AFTER[state]
    return edits


def conversation_key(conv: Column) -> Column:
    """The conversation as a string that isn't null."""
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A written table of turns in their order: conv, conv_key, turn, role, text, sha, blank, truncated, pos.

    pos grows with (conversation, turn, role, sha); its upper bits are the range.
    """
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    rows = turns.select(name(conv).alias("conv"), name(turn).alias("turn"), F.coalesce(name(role), F.lit(" ")).alias("role"), F.coalesce(name(text), F.lit(" ")).alias("text"))
    rows = rows.select("*", conversation_key(F.col("conv")).alias("conv_key"), F.sha2("text", 256).alias("sha"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = ["conv_key", F.col("turn").asc_nulls_first(), "role", "sha"]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # turns alike in all may lie in several ranges
    return cut(salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt").withColumn("pos", F.monotonically_increasing_id()))


def range_of(pos: Column) -> Column:
    return F.shiftright(pos, 33)


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_PART = pa.schema(
    [("conv_key", pa.string()), ("part", pa.int64()), ("long", pa.bool_()), ("n", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(_TURN))]
)
PART = (
    "conv_key string, part long, long boolean, n long, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, first_initial string, last_initial string, illegal long, cost long, audit string, "
    "turns array<struct<role:string,text:string>>"
)
#: Turns and characters that are turned into one batch.
BATCH_TURNS, BATCH_CHARACTERS = 4096, 1 << 21


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one conversation and range; rows come sorted by pos."""
    part: list[dict] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in batch.slice(lo, 256).to_pylist():
                if part and (part[0]["conv_key"] != row["conv_key"] or part[0]["pos"] >> 33 != row["pos"] >> 33):
                    yield part
                    part = []
                part.append(row)
    if part:
        yield part


def _turns(part: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(r["role"][:1], r["blank"] or r["again"], r["truncated"] and not r["blank"] and not r["again"]) for r in part]


def _repaired(part: list[dict]) -> tuple:
    """The row of _PART of a part; entry and end tell its surroundings where the conversation has several parts."""
    turns, first = _turns(part), part[0]
    entry, end = first["entry"] or 0, first["end"] or END
    table = costs_to_go(turns, end)
    edits, state = walked(turns, table, entry)
    cost = table[0][entry] - end[state]
    if first["final"]:
        edits, cost = edits + finished(state), cost + END[state]
    rows = [{"role": role or part[i]["role"], "text": "" if e == "I" else part[i]["text"]} for e, i, role in edits if e != "D"]
    numbers = [r["turn"] for r in part if r["turn"] is not None]
    initials = [t[0] for t in turns]
    faults = (sum(r["blank"] for r in part), sum(r["again"] and not r["blank"] for r in part), sum(t[2] for t in turns))
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    spans = (min(numbers), max(numbers), len(set(numbers))) if numbers else (None, None, 0)
    return (first["conv_key"], first["part"], first["end"] is not None, len(part), *spans, *faults, initials[0], initials[-1], illegal, cost, "".join(e for e, _, _ in edits), rows)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    n = size = 0
    full = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PART, strict=True)], schema=_PART)
    for part in _parts(batches):
        made.append(_repaired(part))
        n, size = n + len(part), size + sum(len(t["text"]) for t in made[-1][-1])
        if n >= BATCH_TURNS or size >= BATCH_CHARACTERS:
            yield full()
            made, n, size = [], 0, 0
    if made:
        yield full()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's least costs from state to state, one row of four for each state that it ends in."""
    for part in _parts(batches):
        unit = [[0 if s == t else NEVER for s in range(4)] for t in range(4)]
        found = [costs_to_go(_turns(part), e)[0] for e in unit]
        yield pa.RecordBatch.from_arrays([pa.array([part[0]["conv_key"]]), pa.array([part[0]["pos"] >> 33]), pa.array([found], pa.list_(pa.list_(pa.int64())))], names=["conv_key", "part", "costs"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which a part is left, for each in which it is entered."""
    for part in _parts(batches):
        turns = _turns(part)
        table = costs_to_go(turns, part[0]["end"])
        found = [walked(turns, table, s)[1] if table[0][s] < NEVER else 0 for s in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([part[0]["conv_key"]]), pa.array([part[0]["pos"] >> 33]), pa.array([found], pa.list_(pa.int64()))], names=["conv_key", "part", "exits"])


def _ends(parts: pa.Table) -> pa.Table:
    """The cost to go at the end of each part of one conversation, from the parts' matrices."""
    rows, end, out = sorted(parts.to_pylist(), key=lambda r: -r["part"]), list(END), []
    for r in rows:
        out.append(end)
        end = [min(min(r["costs"][t][s] + end[t] for t in range(4)), NEVER) for s in range(4)]
    return pa.table([[r["conv_key"] for r in rows], [r["part"] for r in rows], pa.array(out, pa.list_(pa.int64())), [i == 0 for i in range(len(rows))]], names=["conv_key", "part", "end", "final"])


def _entries(parts: pa.Table) -> pa.Table:
    """The state in which each part of one conversation is entered."""
    rows, state, out = sorted(parts.to_pylist(), key=lambda r: r["part"]), 0, []
    for r in rows:
        out.append(state)
        state = r["exits"][state]
    return pa.table([[r["conv_key"] for r in rows], [r["part"] for r in rows], pa.array(out, pa.int64())], names=["conv_key", "part", "entry"])


def repair_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parts of repaired conversations: conv and what PART lists.

    A conversation has one row but where it is long, that is, lies in several
    ranges; part orders these. turns: the repaired turns; illegal counts pairs
    inside the part; first_turn, last_turn and n_turns (different ones) are of
    turns that aren't null. What a conversation's parts say together:
    whole_conversations().
    """
    rows = ordered(turns, conv, turn, role, text)
    part = range_of(F.col("pos"))
    same = ["conv_key", "role", "sha"]
    again = cut(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("first")).filter("k > 1"))
    later = by_key(rows.select(*same, "pos"), again, same, "k", ["first"]).filter("pos > first").select("pos", F.lit(True).alias("again"))
    marked = rows.join(later, "pos", "left").withColumn("again", F.coalesce("again", F.lit(False))).withColumn("part", part)
    several = cut(rows.groupBy("conv_key").agg(F.min(part).alias("lo"), F.max(part).alias("hi")).filter("lo < hi"))
    # a conversation in several ranges holds a border of ranges: there are fewer of them than ranges
    long = marked.join(F.broadcast(several.select("conv_key")), "conv_key", "left_semi")
    whole = marked.join(F.broadcast(several.select("conv_key")), "conv_key", "left_anti")
    in_order = lambda df: df.repartition("part").sortWithinPartitions("pos")
    thin = ["conv_key", "pos", "role", "blank", "again", "truncated", "part"]
    if several.isEmpty():
        surroundings = None
    else:
        thin_rows = cut(long.select(*thin))
        matrices = in_order(thin_rows).mapInArrow(_matrices, "conv_key string, part long, costs array<array<long>>")
        ends = cut(matrices.groupBy("conv_key").applyInArrow(_ends, "conv_key string, part long, end array<long>, final boolean"))
        ended = in_order(thin_rows.join(F.broadcast(ends), ["conv_key", "part"]))
        exits = ended.mapInArrow(_exits, "conv_key string, part long, exits array<long>")
        entries = exits.groupBy("conv_key").applyInArrow(_entries, "conv_key string, part long, entry long")
        surroundings = cut(entries.join(ends, ["conv_key", "part"]))
    none = [F.lit(None).cast("array<long>").alias("end"), F.lit(True).alias("final"), F.lit(None).cast("long").alias("entry")]
    fields = ["conv_key", "pos", "part", "turn", "role", "text", "blank", "again", "truncated"]
    given = whole.select(*fields, *none)
    if surroundings is not None:
        given = given.unionByName(long.join(F.broadcast(surroundings), ["conv_key", "part"]).select(*fields, "end", "final", "entry"))
    made = in_order(given).mapInArrow(_repair, PART)
    return made.select(F.when(F.col("conv_key") != "", F.expr("substring(conv_key, 2)")).cast(turns.schema[conv].dataType).alias("conv"), "*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired turns, from its parts in order, without holding them."""
    key, digest, empty, out = None, None, True, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["conv_key"] != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, empty = row["conv_key"], hashlib.sha256(), True
            for t in row["turns"]:
                digest.update((("" if empty else "\n") + t["role"] + ":" + t["text"]).encode())
                empty = False
    if key is not None:
        out.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["conv_key", "repaired_sha256"])


def whole_conversations(parts: DataFrame) -> DataFrame:
    """One row for each conversation of a written table of parts: conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A long conversation's repaired text is hashed as a stream, which is one
    task's work, as the hash is sequential, but nothing of it is held.
    """
    gaps = lambda first, last, n: F.coalesce(last - first + 1 - n, F.lit(0)).cast("long")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    short = parts.filter("not long").select("conv_key", gaps(F.col("first_turn"), F.col("last_turn"), F.col("n_turns")).alias("gaps"), *counts, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    several = parts.filter("long")
    if several.isEmpty():
        return short
    figures = ["part", "first_turn", "last_turn", "n_turns", *counts, "first_initial", "last_initial", "audit"]
    p = F.col("p")
    lists = several.groupBy("conv_key").agg(F.array_sort(F.collect_list(F.struct(*figures))).alias("p"))  # a row for each range of the conversation
    total = lambda c: F.aggregate(p[c], F.lit(0).cast("long"), lambda x, y: x + y)
    before = lambda i, c: F.get(p, i - 1)[c]
    borders = lambda test: F.size(F.filter(F.transform(p, lambda x, i: F.coalesce((i > 0) & test(x, i), F.lit(False))), lambda x: x))
    shared = borders(lambda x, i: before(i, "last_turn") == x["first_turn"])
    wrong = borders(lambda x, i: ~F.concat(before(i, "last_initial"), x["first_initial"]).isin(*LEGAL))
    spans = gaps(F.array_min(p["first_turn"]), F.array_max(p["last_turn"]), total("n_turns") - shared)
    sums = {c: total(c).alias(c) for c in counts} | {"illegal": (total("illegal") + wrong).alias("illegal")}
    joined = lists.select("conv_key", spans.alias("gaps"), *sums.values(), F.array_join(p["audit"], "").alias("audit"))
    hashes = several.select("conv_key", "part", "turns").repartition("conv_key").sortWithinPartitions("conv_key", "part").mapInArrow(_digests, "conv_key string, repaired_sha256 string")
    return short.unionByName(joined.join(hashes, "conv_key"))
