"""Quality rules: counts per text, base rules, and robust multivariate outliers.

The counts of each text that passes the base rules become a transformed vector.
For each language and source a minimum-covariance-determinant estimate of
centre and spread is made: from several fixed starts, concentration steps keep
the closest half and take their mean and covariance until the determinant stops
falling; of all starts the smallest determinant is kept, and one reweighted step
uses all within the 97.5 % ellipsoid. Texts whose squared Mahalanobis distance
is above the chi-square quantile are rejected. Half is the most that an estimate
can withstand: a group with more junk than sound texts is described by its junk.

A group of fewer than ``least_rows`` sound texts is held against the estimate of
all sound texts of its language, and if these are too few of all sound texts; if
even these are too few, nothing is rejected.

Scale: a step is one aggregate of counts, sums and products per group, start and
distance bin, summed before the shuffle, so a group of any size is a few hundred
rows for each start. Vectors are whole thousandths, so sums don't depend on their order. All
expressions are native; each text is read and counted once, and its counts are
written beside what is kept of its row.

Defined results: null or empty text: no words, all counts 0, base_failed. Null
language or source are values of their own. Repeated rows count as often as
they occur and get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.once import let
from .common import SPACES, cut, drop_cut, name, packed, words

#: Chi-square quantiles for five variables: 97.5 % and 99.999 % (fixed values).
WITHIN, BEYOND = 12.833, 30.856
#: Factors that make the covariance of the closest 50 %, 75 % and 97.5 % consistent (fixed values).
HALF_FACTOR, CLOSEST_FACTOR, WITHIN_FACTOR = 1.912, 1.412, 1.055
#: Standard deviations added to each variable's own, so that constant variables are allowed and differences that
#: don't matter aren't outliers: a third of a text's length (of its logarithm), a tenth of a character in a word's mean
#: length, a quarter in the logarithm of ten times the share of symbols, half in that of repeated lines (0 or 1 of them
#: are alike), a tenth of all words repeated.
FLOORS = (0.3, 0.1, 0.25, 0.5, 0.1)
UNIT = 1000
#: Where a variable is cut off (far outside of any ellipsoid), so that sums of products stay in range.
FURTHEST = 100.0
VARIABLES = len(FLOORS)
#: Shares that a step keeps: of the estimate, and of the steps that give one of its starts.
HALF, CLOSEST = 0.5, 0.75
#: A determinant that falls by less (in its logarithm) has stopped falling.
FALLS = 1e-4


def repeated_words(w: Column, width: int = 5) -> Column:
    """Words in windows of width words that are found twice or more in the text."""
    n = F.size(w)

    def covered(starts: Column) -> Column:
        following = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.get(starts, F.size(starts) - 1) + width))
        return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(F.lit(width), b - a)), F.lit(0), lambda s, x: s + x)

    def starts(ordered: Column) -> Column:
        twice = lambda x, j: F.when((x["v"] == F.get(ordered, j + 1)["v"]) | (x["v"] == F.get(ordered, j - 1)["v"]), x["i"])
        return F.array_sort(F.array_compact(F.transform(ordered, twice)))

    def among(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(ordered, starts), covered))

    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(n < width, 0).otherwise(let(windows, among)).cast("long")


def text_counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, as a struct."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(t, SPACES, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), repeats.alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words")),
    )


def _vector(c: Column) -> list[Column]:
    """The transformed counts, in thousandths: length, shrunk mean word length, symbols, repeated lines, repeated words."""
    n = F.greatest(c["n_words"], F.lit(1))
    raw = [F.log(n), (c["word_chars"] + 100) / (n + 20), F.log1p(10 * c["n_symbols"] / n), F.log1p(c["n_dup_lines"].cast("double")), c["n_repeat_words"] / n]
    return [F.round(F.least(x, F.lit(FURTHEST)) * UNIT).cast("long").alias(f"v{i}") for i, x in enumerate(raw)]


#: Keys of a table that is broadcast as a whole (a model has 200 bytes, a key five models); of a larger one only keys
#: with more than this part of all rows are, of which there are fewer.
MOST_KEYS, FREQUENT_PART = 10_000, 2_000


@dataclass(frozen=True)
class Lookup:
    """How rows meet a table of keys: all of it broadcast (frequent is None), or the keys in frequent only."""

    key: str
    frequent: DataFrame | None

    def join(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        if self.frequent is None:
            return rows.join(F.broadcast(table), self.key, how)
        often = F.broadcast(self.frequent)
        hot = rows.join(often, self.key, "left_semi").join(F.broadcast(table.join(often, self.key, "left_semi")), self.key, how)
        return hot.unionByName(rows.join(often, self.key, "left_anti").join(table, self.key, how))


#: Groups that are few.
ALL = Lookup("group", None)


def lookup(counts: DataFrame, key: str, rows: str) -> Lookup:
    """For a table of distinct keys and how many rows each has."""
    keys, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(rows), F.lit(0))).first()
    return Lookup(key, None if keys <= MOST_KEYS else cut(counts.filter(F.col(rows) > total // FREQUENT_PART).select(key)))


def _groups(scored: DataFrame, least_rows: int) -> DataFrame:
    """A row for each pair of language and source: rows, sound rows n, the language, and the group whose estimate holds (null: none), of the pair, else the language, else all."""
    counts = scored.groupBy("pair").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    of_lang = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n_lang"))
    table = counts.join(of_lang, F.col("lang").eqNullSafe(F.col("of"))).withColumn("n_all", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    language = F.concat(F.lit("l"), F.to_json(F.struct("lang")))
    group = F.when(F.col("n") >= least_rows, F.concat(F.lit("s"), "pair")).when(F.col("n_lang") >= least_rows, language).when(F.col("n_all") >= least_rows, F.lit("all"))
    return cut(table.select("pair", "rows", "n", language.alias("language"), group.alias("group")))


def _estimated(groups: DataFrame) -> DataFrame:
    """Rows (pair, group, n) for every estimate: a pair counts for its own, and for its language's and for all where some small pair needs these."""
    wanted = groups.filter("group is not null").select(F.col("group").alias("wanted")).distinct()
    every = groups.filter("n > 0").select("pair", "n", F.explode(F.array_distinct(F.array(F.col("group"), F.col("language"), F.lit("all")))).alias("group"))
    return cut(every.join(wanted, F.col("group") == F.col("wanted"), "left_semi"))


def _quantiles(vectors: DataFrame, at: Sequence[float]) -> DataFrame:
    """Rows (group, i, q): the quantiles of each variable, read off a histogram in hundredths."""
    long = vectors.select("group", F.posexplode(F.array(*[F.floor(F.col(f"v{i}") / 10) for i in range(VARIABLES)])).alias("i", "bin"))
    bins = long.groupBy("group", "i", "bin").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("group", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("k").over(order)).withColumn("all", F.sum("k").over(Window.partitionBy("group", "i")))
    return bins.groupBy("group", "i").agg(F.array(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / 100 for q in at]).alias("q"))


def _apart(scales: DataFrame) -> DataFrame:
    """Models (group, start) of rows (group, start, i, mid, sd) as if the variables were independent."""
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOORS]), F.col("i") + 1)
    return scales.groupBy("group", "start").agg(
        *[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(VARIABLES)],
        *[(F.max(F.when(F.col("i") == i, 1 / (F.col("sd") * F.col("sd") + floor * floor))) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _cells()],
    )


def _first(vectors: DataFrame, steps: int = 64) -> DataFrame:
    """Starts 0, from medians and quartiles, and 1, from the shortest interval of each variable that holds half of the rows."""
    q = F.col("q")
    halves = F.transform(F.sequence(F.lit(0), F.lit(steps // 2)), lambda j: F.struct((F.get(q, j + steps // 2) - F.get(q, j)).alias("width"), F.get(q, j).alias("lo")))
    found = _quantiles(vectors, [j / steps for j in range(steps + 1)]).select("group", "i", "q", F.array_min(halves).alias("h"))
    quartiles = F.struct(F.lit(0).alias("start"), q[steps // 2].alias("mid"), ((q[3 * steps // 4] - q[steps // 4]) / 1.349).alias("sd"))
    shortest = F.struct(F.lit(1).alias("start"), (F.col("h.lo") + F.col("h.width") / 2).alias("mid"), (F.col("h.width") / 1.349).alias("sd"))
    return _apart(found.select("group", "i", F.explode(F.array(quartiles, shortest)).alias("s")).select("group", "i", "s.*"))


def _shaped(vectors: DataFrame, models: DataFrame, by: Lookup) -> DataFrame:
    """Starts 2 and 3: the centres and scales of 0 and 1, and the covariance of the scaled variables once bounded: by the hyperbolic tangent, or to their signs in space."""
    scaled = [(F.col(f"v{i}") / UNIT - F.col(f"m{i}")) * F.sqrt(f"p{i}{i}") for i in range(VARIABLES)]
    norm = F.sqrt(sum((z * z for z in scaled), F.lit(1e-6)))
    rows = by.join(vectors, models).select("group", "start", *[F.round(F.when(F.col("start") == 0, F.tanh(z)).otherwise(z / norm) * UNIT).cast("long").alias(f"w{i}") for i, z in enumerate(scaled)])
    totals = rows.groupBy("group", "start").agg(*[F.expr(f"sum(w{i} * w{j}) as q{i}{j}") for i, j in _cells()]).join(models, ["group", "start"])
    trace = " + ".join(["1D", *[f"q{i}{i}" for i in range(VARIABLES)]])
    share = lambda i, j: f"{VARIABLES} * q{min(i, j)}{max(i, j)} / ({trace}) / sqrt(p{i}{i} * p{j}{j}) + {FLOORS[i] ** 2 if i == j else 0.0}D"
    return _modelled(totals.withColumn("start", F.col("start") + 2), ["group", "start"], [f"m{i}" for i in range(VARIABLES)], _matrix(share))


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in range(VARIABLES) for j in range(i, VARIABLES)]


def distance() -> Column:
    """Squared Mahalanobis distance of v0.. to the model's centre m0.. by its inverse covariance p00.."""
    x = [f"(v{i} / {UNIT} - m{i})" for i in range(VARIABLES)]
    return F.expr(" + ".join(["0D", *[f"p{i}{j} * {x[i]} * {x[j]} * {1 if i == j else 2}" for i, j in _cells()]]))


def _inverse(rows: Column) -> Column:
    """Inverse of a positive definite matrix (array of rows) by Gauss-Jordan steps."""
    n = VARIABLES
    wide = F.transform(rows, lambda r, i: F.concat(r, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == i, 1.0).otherwise(0.0))))

    def step(m: Column, k: Column) -> Column:
        def clear(pivot: Column) -> Column:
            return F.transform(m, lambda r, i: F.when(i == k, pivot).otherwise(F.zip_with(r, pivot, lambda a, b: a - F.get(r, k) * b)))

        return let(F.transform(F.get(m, k), lambda x: x / F.get(F.get(m, k), k)), clear)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), wide, step), lambda r: F.slice(r, n + 1, n))


def _log_determinant(rows: Column) -> Column:
    """Logarithm of the determinant of a positive definite matrix (array of rows), from its pivots."""

    def step(s: Column, k: Column) -> Column:
        m = s["m"]
        pivot = F.get(F.get(m, k), k)
        clear = lambda r, i: F.when(i <= k, r).otherwise(F.zip_with(r, F.get(m, k), lambda a, b: a - F.get(r, k) / pivot * b))
        return F.struct(F.transform(m, clear).alias("m"), (s["d"] + F.log(pivot)).alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(VARIABLES - 1)), F.struct(rows.alias("m"), F.lit(0.0).alias("d")), step)["d"]


def _matrix(cell: Callable[[int, int], str]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(cell(i, j) for j in range(VARIABLES)) + ")" for i in range(VARIABLES)) + ")")


def _modelled(rows: DataFrame, keys: list[str], mean: list[str], matrix: Column, more: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    return rows.select(*keys, *[F.expr(f"{m} as m{i}") for i, m in enumerate(mean)], _inverse(matrix).alias("p"), *[c.alias(n) for n, c in more.items()]).selectExpr(
        *keys, *[f"m{i}" for i in range(VARIABLES)], *[f"p[{i}][{j}] as p{i}{j}" for i, j in _cells()], *more
    )


def _estimate(bins: DataFrame, keys: list[str], factor: str, more: dict[str, Column]) -> DataFrame:
    """Models of summed rows: centre, inverse of the covariance times factor."""
    mean = [f"(s{i} / k / {UNIT})" for i in range(VARIABLES)]
    cell = lambda i, j: f"(q{min(i, j)}{max(i, j)} / k / {UNIT**2} - {mean[i]} * {mean[j]}) * {factor} + {FLOORS[i] ** 2 if i == j else 0.0}D"
    matrix = _matrix(cell)
    return _modelled(bins, keys, mean, matrix, {n: f(matrix) if callable(f) else f for n, f in more.items()})


def _sums() -> list[Column]:
    return [F.expr(f"sum(v{i}) as s{i}") for i in range(VARIABLES)] + [F.expr(f"sum(v{i} * v{j}) as q{i}{j}") for i, j in _cells()]


def _again() -> list[Column]:
    return [F.expr(f"sum({c}) as {c}") for c in [*[f"s{i}" for i in range(VARIABLES)], *[f"q{i}{j}" for i, j in _cells()]]]


def concentrated(vectors: DataFrame, models: DataFrame, by: Lookup = ALL) -> DataFrame:
    """A step of each model (group, start, share, factor, det): mean and covariance of the closest share of its group's rows; det: the logarithm of the covariance's determinant, last: the one before."""
    keys = ["group", "start"]
    d = F.least(F.greatest(distance(), F.lit(1e-6)), F.lit(1e12))
    rows = by.join(vectors, models).withColumn("bin", F.floor(F.log2(d) * 16).cast("int"))
    facts = [F.first(c).alias(c) for c in ("share", "factor", "det")]
    bins = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"), *_sums(), *facts)
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0))).withColumn("all", F.sum("k").over(Window.partitionBy(*keys)))
    totals = bins.filter(F.col("before") < F.col("share") * F.col("all")).groupBy(*keys).agg(F.sum("k").alias("k"), *_again(), *facts)
    return _estimate(totals, keys, "factor", {"det": _log_determinant, "last": F.col("det")})


def reweighted(vectors: DataFrame, model: DataFrame, by: Lookup = ALL) -> DataFrame:
    """The model of the rows within the 97.5 % ellipsoid of another model."""
    rows = by.join(vectors, model).filter(distance() <= WITHIN)
    return _estimate(rows.groupBy("group").agg(F.count(F.lit(1)).alias("k"), *_sums()), ["group"], f"{WITHIN_FACTOR}D", {})


def _with_share(models: DataFrame, wide: bool) -> DataFrame:
    """What a step takes of each start: half, but for the last one while wide."""
    far = (F.col("start") == 4) & F.lit(wide)
    return models.withColumn("share", F.when(far, CLOSEST).otherwise(HALF)).withColumn("factor", F.when(far, CLOSEST_FACTOR).otherwise(HALF_FACTOR))


def robust_fit(vectors: DataFrame, by: Lookup = ALL, wide_steps: int = 2) -> DataFrame:
    """The estimate of each group, from rows (group, v0..).

    Start 4 is start 0 whose first wide_steps steps take the closest three
    quarters. Starts whose determinant has stopped falling stay as they are.
    """
    first = cut(_first(vectors))
    starts = first.unionByName(first.filter("start = 0").withColumn("start", F.lit(4))).unionByName(_shaped(vectors, first, by))
    state = cut(starts.withColumn("det", F.lit(float("inf"))).withColumn("falls", F.lit(True)))
    drop_cut(first)
    step = 0
    while True:
        wide, seen = step < wide_steps, Observation()
        now = concentrated(vectors, _with_share(state.filter("falls").drop("falls"), wide), by)
        if wide:  # determinants of other shares aren't compared
            now = now.withColumn("det", F.when(F.col("start") == 4, float("inf")).otherwise(F.col("det")))
        now = now.withColumn("falls", (F.col("det") == float("inf")) | (F.col("det") < F.col("last") - FALLS)).drop("last")
        new = cut(now.unionByName(state.filter("not falls")).observe(seen, F.count(F.when(F.col("falls"), 1)).alias("n")))
        drop_cut(state)
        state, step = new, step + 1
        if not seen.get["n"]:  # a determinant has a least value, that of FLOORS, so its falls end
            break
    columns = [c for c in state.columns if c not in ("group", "start", "det", "falls")]
    best = state.groupBy("group").agg(F.min(F.struct("det", "start", *columns)).alias("best")).select("group", *[F.col("best")[c].alias(c) for c in columns])
    model = cut(reweighted(vectors, best, by))
    drop_cut(state)
    return model


def quality_rules(
    docs: DataFrame, *, least_rows: int = 50, least_words: int = 10, most_repeated: int = 20, text: str = "text", lang: str = "lang", source: str = "source", keep: Sequence[str] | None = None
) -> DataFrame:
    """Rows (row, counts, base_failed, distance, kept); row: the columns of docs, or those in keep.

    base_failed: fewer than least_words words or more than most_repeated
    percent of them repeated.
    """
    kept = docs.select(*[name(c) for c in keep]) if keep is not None else docs
    scored = docs.select(packed(kept), name(lang).alias("lang"), F.to_json(F.struct(name(lang).alias("lang"), name(source).alias("source"))).alias("pair"), text_counts(name(text)).alias("counts"))
    failed = (F.col("counts.n_words") < least_words) | (100 * F.col("counts.n_repeat_words") > most_repeated * F.col("counts.n_words"))
    scored = cut(scored.withColumn("base_failed", failed).select("*", *_vector(F.col("counts"))))
    groups = _groups(scored, least_rows)
    by_pair = lookup(groups, "pair", "rows")
    members = _estimated(groups)
    by_group = lookup(members.groupBy("group").agg(F.sum("n").alias("n")), "group", "n")
    sound = by_pair.join(scored.filter(~F.col("base_failed")).select("pair", *[f"v{i}" for i in range(VARIABLES)]), members.select("pair", "group")).drop("pair")
    sound = cut(sound)
    model = robust_fit(sound, by_group)
    out = by_group.join(by_pair.join(scored, groups.select("pair", "group"), "left"), model, "left").withColumn("distance", distance())
    drop_cut(sound, members)
    good = ~F.col("base_failed") & F.coalesce(F.col("distance") <= BEYOND, F.lit(True))
    return out.select("row", "counts", "base_failed", "distance", good.alias("kept"))
