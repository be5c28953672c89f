"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given as knots and
linear between them. Its integral up to time t, scaled to the source's target,
is the source's cumulative token demand. A document that begins after c tokens
of its source's stream (documents in a fixed pseudo-random order, wrapped round
for further passes) is trained when the demand reaches the document's middle,
so its position is the inverse of the demand there. Sorting by position by
ranges gives the training order (``training_order``, the method's last step).

Targets: the sources share the corpus' words by weight; none takes over ``cap``
times its own size, what is beyond goes to the others by weight.

Scale: one scan aggregates sizes per source and hash bucket; offsets of buckets
come from that small table, and only rows of one bucket (a 1/2**bits part of a
source) meet in a window, so a source that holds a third of all rows is spread
over as many tasks as there are buckets. Sources may be as many as hosts. All
expressions are native.

Defined results: null text or only spaces: size 0, takes nothing but still gets
a position if its source is repeated. A null source is a source of its own,
after all others. Repeated rows are separate rows; rows with the same id are
ordered by a hash of their text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import cut, drop_cut, name, packed, words

Knots = Sequence[tuple[float, float]]

#: Schedules that integrate to 5, 2 and 1: the first wanes, the last grows.
DEFAULT_SCHEDULES: tuple[Knots, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 2.0)))


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def _segments(knots: Knots) -> Column:
    """Literal array of the schedule's linear pieces, scaled to an integral of 1."""
    total, at, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 > t0:
            a, b = w0 / total, w1 / total
            out.append(F.struct(F.lit(at).alias("q0"), F.lit(t0).alias("t0"), F.lit(a).alias("a"), F.lit((b - a) / (t1 - t0)).alias("slope")))
            at += (t1 - t0) * (a + b) / 2
    return F.array(*out)


def _time_of(demand: Column, pieces: Column) -> Column:
    """The time at which the integrated schedule reaches demand (0..1)."""
    piece = F.element_at(F.filter(pieces, lambda s: s["q0"] <= demand), -1)
    rest = demand - piece["q0"]
    below = piece["a"] + F.sqrt(F.greatest(piece["a"] * piece["a"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return piece["t0"] + F.when(below == 0, F.lit(0.0)).otherwise(2 * rest / below)


def order_key(doc_id: Column, seed: int) -> Column:
    """60 pseudo-random bits of an id, from md5 so that other engines can derive them."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, source_size, pattern (of the schedules, in the order of sources) and target, from (source, source_size).

    Sources are numbered by ranges, and the level below which a source is full is
    found by sums over all of them, so no task sees every source.
    """
    ordered = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    table = numbered(sizes.select(ordered.alias("order"), "source_size"), "order", "place")
    table = table.select("order.source", "source_size", F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int").alias("pattern"))
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("pattern") + 1))
    table = cut(table.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight")))
    full, share = F.lit(False), 0.0
    while True:
        found = table.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        total, spent, rest = (x or 0.0 for x in found)
        if not rest:
            break
        last, share = share, (total - spent) / rest
        if share == last:
            break
        full = F.col("level") <= share  # the share only grows, so what is full stays full
    target = F.when(full, F.col("most")).otherwise(F.col("weight") * share)
    return table.select("source", "source_size", "pattern", F.round(target, 6).alias("target"))


def mix_curriculum(
    docs: DataFrame,
    *,
    schedules: Sequence[Knots] = DEFAULT_SCHEDULES,
    cap: float = 3,
    seed: int = 17,
    bucket_bits: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows (row, source, size, source_size, target, copies, taken, positions).

    row: the columns of docs (or those in keep); copies: how often the mix
    takes the document; positions: a training time in [0, 1] for each copy.
    size defaults to the number of words.
    """
    weights = [integral(s) for s in schedules]
    kept = docs.select(*[name(c) for c in keep]) if keep is not None else docs
    n_words = F.size(words(name(text))).cast("long") if size is None else size
    base = docs.select(
        packed(kept), name(source).alias("source"), n_words.alias("size"), order_key(name(doc_id), seed).alias("key"), F.xxhash64(name(text)).alias("tie")
    ).withColumn("bucket", F.shiftright("key", 60 - bucket_bits))
    parts = cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("part")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("part_from", F.coalesce(F.sum("part").over(before), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    plan = cut(offsets.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "part"))
    drop_cut(parts)
    plan = plan.withColumnsRenamed({"source": "p_source", "bucket": "p_bucket"})
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.col("part_from") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    middle = F.col("begin") + F.col("size") / 2
    rows = rows.withColumn("copies", passes + F.when(middle < rest, 1).otherwise(0))
    pieces = F.element_at(F.array(*[_segments(s) for s in schedules]), F.col("pattern") + 1)
    at = lambda j: F.round(_time_of(F.least((j * F.col("source_size") + F.col("begin") + F.col("size") / 2) / F.col("target"), F.lit(1.0)), pieces), 9)
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.select("row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), "key", "tie")


def training_order(mix: DataFrame, *, untaken: bool = False) -> DataFrame:
    """One row a taken copy (copy: its number, from 0), range-sorted by position; ties by the order of the stream.

    untaken: documents that the mix doesn't take follow after all copies, with
    null copy and position, spread over ranges by their keys.
    """
    explode = F.posexplode_outer if untaken else F.posexplode
    copies = mix.select(*[c for c in mix.columns if c != "positions"], explode("positions").alias("copy", "position"))
    return copies.orderBy(F.col("position").asc_nulls_last(), "key", "tie")
