"""Near-duplicate documents by MinHash.

Many universal hash minima of each text's word shingles make a signature; equal
bands of it make candidates; candidates are verified on signatures, then
confirmed on the full shingle sets; links are joined to components by
alternating large-star and small-star.

Texts with equal shingle sets are one class, linked at once and represented by
the smallest id, so a group of copies of any size is one row after a partial
aggregation. In a band's bucket the members are first compared with the one that shares most
buckets with others. Whatever then lies in one component needs no further
comparison. Buckets that still hold several components are compared across
these, in square blocks of a bounded number of members and shingles: signatures
first, each pair in the first band that it shares, then the full sets of the
pairs left. So only members that share a bucket are compared, no component is
split and no bucket is capped.

With 160 minima in 32 bands of 5, a pair of similarity 0.8 is missed with a
chance of 3e-6, one of 0.85 with 2e-8.

Defined results: a null or empty text has an empty set and links with nothing;
fewer words than a shingle give one shingle of all words; rows with the same id
are one node; a row without id is linked with nothing, has no component and is
kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import word_grams
from .common import cut, drop_cut, name
from .components import connected_components

BANDS, ROWS = 32, 5
#: Members, and shingles of members, in one side of a block of comparisons; rows and shingles that a task takes at once.
BLOCK_MEMBERS, BLOCK_SHINGLES, TASK_ROWS, TASK_SHINGLES = 500, 400_000, 4000, 400_000


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, ASCII letters lower-cased, in order."""
    words = np.array(list(map(xxhash.xxh3_64_intdigest, raw.lower().split())), dtype=np.uint64)
    if not len(words):
        return words
    return np.unique(word_grams(words, min(width, len(words))))


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random odd multipliers and offsets of n universal hash functions."""
    random = np.random.Generator(np.random.PCG64(20240229))
    draw = lambda: random.integers(0, 1 << 63, size=(n, 1), dtype=np.uint64) * np.uint64(2) + random.integers(0, 2, size=(n, 1), dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def signature(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(items), 2048):
            h = a * items[lo : lo + 2048]
            h += b
            np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _features(width: int):
    family = hash_family(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sizes, keys, signs = [], [], []
                for raw in part.column(1).to_pylist():
                    items = shingle_set(raw, width) if raw else np.zeros(0, np.uint64)
                    sizes.append(len(items))
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    signs.append(signature(items, family).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return run


def _floor(threshold: float) -> float:
    """A share of agreeing minima that a similarity of the threshold falls short of by chance only (6 sigma)."""
    return threshold - 6 * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def _signatures(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<u4").reshape(len(values), -1)


def _near(threshold: float):
    """Keeps pairs whose signatures agree in a share that a link has."""
    floor = _floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_signatures(batch.column(c).to_pylist()) for c in ("x", "y"))
                near = (x == y).mean(axis=1) >= floor
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], names=["a", "b"])

    return run


def _alike(width: int, percent: int):
    """Keeps pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, np.ndarray] = {}
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if y not in held:
                    held = {y: shingle_set(y, width)}
                p, q = shingle_set(x, width), held[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                yes.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _pairs_to_links(pairs: DataFrame, facts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: by size, by signature, then on full sets."""
    sizes = facts.select("rep", "n_shingles")
    sized = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("k")), "b")
    sized = cut(sized.filter(100 * F.least("n", "k") >= percent * F.greatest("n", "k")).select("a", "b"))
    x, y = (facts.select(F.col("rep").alias(c), F.col("signature").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    near = cut(sized.join(x, "a").join(y, "b").mapInArrow(_near(percent / 100), "a long, b long").distinct())
    full = near.join(texts.select(F.col("doc_id").alias("a"), F.col("raw").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("raw").alias("y")), "b")
    links = cut(full.mapInArrow(_alike(width, percent), "a long, b long").distinct())
    drop_cut(sized, near)
    return links


def _compared(members: DataFrame) -> DataFrame:
    """Pairs of each member with the one of its bucket that shares most with others, (a, b) with a < b."""
    pivots = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"))).alias("p")).select("bucket", (-F.col("p.least")).alias("pivot"))
    pairs = members.join(pivots, "bucket").filter("rep <> pivot")
    return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _candidates(percent: int):
    """The members of blocks that may have links, with whom: queries (asks) against members of larger components, each pair in the first band that it shares."""
    floor = _floor(percent / 100)

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (bucket, x, y), block in shard.groupby(["bucket", "x", "y"]):
            asks, members = block[block["asks"]], block[~block["asks"]]
            if not len(asks) or not len(members):
                continue
            own, others = _signatures(asks["signature"].tolist()), _signatures(members["signature"].tolist())
            sizes, reps, band = members["n_shingles"].to_numpy(), members["rep"].to_numpy(), int(block["band"].iloc[0])
            held, component = members["held"].to_numpy(), members["component"].to_numpy()
            partners: dict[int, set[int]] = {}
            for sign, rep, n, h, c in zip(own, asks["rep"].tolist(), asks["n_shingles"], asks["held"], asks["component"], strict=True):
                at = np.flatnonzero(((held > h) | ((held == h) & (component > c))) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                equal = others[at] == sign
                shared = equal.reshape(len(at), BANDS, ROWS).all(axis=2)
                found = reps[at[(equal.mean(axis=1) >= floor) & (shared.argmax(axis=1) == band)]].tolist()
                if found:
                    partners.setdefault(rep, set()).update(found)
                    for other in found:
                        partners.setdefault(other, set())
            out.extend((bucket, x, y, rep, sorted(found)) for rep, found in partners.items())
        return pd.DataFrame(out, columns=["bucket", "x", "y", "rep", "partners"])

    return run


def _confirmed(width: int, percent: int):
    """The pairs of some blocks that are links on full sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts: dict[int, set[bytes]] = {}  # more than one where an id has several texts
        for rep, raw in zip(rows["rep"].tolist(), rows["raw"], strict=True):
            texts.setdefault(rep, set()).add(raw)
        sets = {rep: [shingle_set(raw, width) for raw in raws] for rep, raws in texts.items()}

        def alike(p: np.ndarray, q: np.ndarray) -> bool:
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= percent * (len(p) + len(q) - both)

        pairs = {(min(rep, other), max(rep, other)) for rep, partners in zip(rows["rep"].tolist(), rows["partners"], strict=True) for other in partners}
        return pd.DataFrame([(a, b) for a, b in sorted(pairs) if any(alike(p, q) for p in sets[a] for q in sets[b])], columns=["a", "b"], dtype="int64")

    return run


def _left_over(members: DataFrame, components: DataFrame, facts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of crowded buckets that the first comparison left in different components.

    In each bucket the members outside its largest component are compared with
    those of larger components, so every pair of components is compared once.
    """
    placed = members.filter("k > 2").select("bucket", "band", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut(placed.select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component")))
    spread = placed.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("spread")).filter("spread").select("bucket")
    rest = cut(placed.join(spread, "bucket").join(facts, "rep"))
    sizes = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"), F.sum("n_shingles").alias("shingles"))
    order = F.struct("held", "component")
    tops = sizes.groupBy("bucket").agg(F.max(order).alias("top"), F.sum("held").alias("n"), F.sum("shingles").alias("s"), F.max_by("shingles", order).alias("top_s"))
    blocks = lambda n, s: F.greatest(F.floor(n / BLOCK_MEMBERS) + 1, F.floor(s / BLOCK_SHINGLES) + 1).cast("int")
    tops = tops.select("bucket", F.col("top.component").alias("top"), blocks(F.col("n"), F.col("s")).alias("n_members"), blocks(F.col("n") - F.col("top.held"), F.col("s") - F.col("top_s")).alias("n_asks"))
    rows = rest.join(cut(sizes.select("bucket", "component", "held").join(tops, "bucket")), ["bucket", "component"])
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ["bucket", "band", "rep", "component", "held", "n_shingles", "signature"]
    asks = rows.filter("component <> top").select(*shown, F.lit(True).alias("asks"), own("n_asks").alias("x"), every("n_members").alias("y"))
    held = rows.select(*shown, F.lit(False).alias("asks"), own("n_members").alias("y"), every("n_asks").alias("x"))
    # small blocks share tasks, of which there are as many as rows need
    counted = rows.agg(F.sum(F.col("n_asks") + F.col("n_members"))).first()[0] or 0
    task = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(1 + counted // TASK_ROWS))
    found = cut(asks.unionByName(held).groupBy(task.alias("task")).applyInPandas(_candidates(percent), "bucket long, x int, y int, rep long, partners array<long>"))
    found = found.join(facts.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
    shingles = found.agg(F.sum("n_shingles")).first()[0] or 0
    task = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(1 + shingles // TASK_SHINGLES)).alias("task")
    rows = found.select(task, "rep", "partners").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    links = cut(rows.groupBy("task").applyInPandas(_confirmed(width, percent), "a long, b long"))
    drop_cut(placed, rest)
    return links


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept, a row for each row of docs; ids are integers."""
    t = name(text)
    docs = docs.select(name(doc_id).cast("long").alias("doc_id"), F.coalesce(t.cast("binary"), F.lit(b"")).alias("raw"))
    features = cut(docs.mapInArrow(_features(width), "doc_id long, n_shingles long, set_key binary, signature binary"))
    usable = features.filter("set_key is not null and doc_id is not null")
    of_set = cut(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    classes = cut(usable.join(of_set.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "signature").distinct())
    several = usable.groupBy("doc_id").agg((F.min("set_key") != F.max("set_key")).alias("several")).filter("several").select("doc_id")
    repeats = usable.join(several, "doc_id", "left_semi").join(of_set, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    size = 4 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("signature"), i * size + 1, F.lit(size))))
    rows = classes.select("rep", F.posexplode(band).alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = cut(rows.join(shared, "bucket"))
    degrees = cut(members.groupBy("rep").agg(F.sum("k").alias("degree")))
    members, old = cut(members.join(degrees, "rep")), members
    drop_cut(old)
    facts = cut(classes.join(degrees.select("rep"), "rep", "left_semi"))
    texts = cut(docs.join(degrees.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").distinct())
    links = cut(repeats.unionAll(_pairs_to_links(_compared(members), facts, texts, width, percent)))
    first = cut(connected_components(links))
    more = _left_over(members, first, facts, texts, width, percent)
    components = first if more.isEmpty() else cut(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)))
    drop_cut(members, degrees, facts, texts, links, classes)
    out = features.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
