"""Exact nearest neighbours over vectors kept by centroid: clusters that can't hold one aren't read.

By the triangle inequality a cluster's members lie at least (distance to its
centroid - its radius) from a query, and at most (distance + radius). The
clusters nearest to a query that hold k members give it a kth distance; of the
others only those whose lower bound isn't beyond it are read. Nothing is
approximate.

Members and queries are dealt to groups of bounded sizes, and each pair of
groups is one step of a task, which keeps the k nearest of each query and never
all pairs: its memory doesn't grow with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Centroids at most, so that they fit a closure whatever the table's size.
MOST_CENTROIDS = 1024
#: Relative room for rounding in bounds.
ROOM = 1e-9
#: Members and queries of a group at most, about; with 64 dimensions 16 and 2 MB.
GROUP_MEMBERS, GROUP_QUERIES = 1 << 15, 1 << 12
#: Members of a group at least, about, where more groups than GROUP_MEMBERS asks for keep all cores busy.
LEAST_MEMBERS = 256
#: Queries and members whose distances are computed at once, and pairs that are kept before they are cut to k a query.
QUERIES_AT_ONCE, MEMBERS_AT_ONCE, PAIRS_HELD = 512, 2048, 1 << 20


@dataclass
class Clusters:
    """members (id, vector, cluster, r) as a written table; centroids, their radii and sizes."""

    members: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - c) ** 2).sum(1)) for c in centroids], axis=1)


def clustered(rows: DataFrame, id: str, vector: str, k: int | None = None) -> Clusters:
    """Assign every vector to the nearest of k centroids, which are rows picked by a hash of their id.

    k: the square root of the number of rows if not given, 1,024 at most. Null
    vectors, and those of another length than the first centroid's, have no
    neighbours and are none.
    """
    held = rows.filter(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    n = held.count()
    k = min(MOST_CENTROIDS, n, k or max(1, round(n**0.5)))
    picked = [r.vector for r in held.orderBy(F.xxhash64("id"), "id").limit(k).collect()]
    dimensions = len(picked[0]) if picked else 0
    fitting = [p for p in picked if len(p) == dimensions]
    centroids = np.array(fitting, dtype=np.float64).reshape(len(fitting), dimensions)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                d = _distances(_matrix(part.column(1), dimensions), centroids)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], names=["id", "vector", "cluster", "r"])

    same = held.filter(F.size("vector") == dimensions)
    schema = f"id {held.schema['id'].dataType.simpleString()}, vector array<double>, cluster int, r double"
    members = cut(same.mapInArrow(assign, schema))
    figures = {r.cluster: (r.radius, r.n) for r in members.groupBy("cluster").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each centroid
    of = lambda i: np.array([figures.get(c, (0.0, 0))[i] for c in range(len(centroids))], dtype=np.float64)
    return Clusters(members, centroids, of(0), of(1))


def _wanted(clusters: Clusters, away: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By query and cluster: the nearest clusters, as many as hold k members; and the others that may hold a member within kth.

    away: distances of queries to centroids.
    """
    near = np.argsort(away, axis=1, kind="stable")
    before = np.cumsum(clusters.sizes[near], axis=1) - clusters.sizes[near]  # members of the clusters that come before
    first = np.zeros(away.shape, dtype=bool)
    np.put_along_axis(first, near, before < k, axis=1)
    others = ~first & (away - clusters.radii <= kth[:, None] * (1 + ROOM))
    return first & (clusters.sizes > 0), others & (clusters.sizes > 0)


def _first(query: np.ndarray, member: np.ndarray, distance: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest pairs of each query, ties by the members' places in the order of ids."""
    order = np.lexsort((place[member], distance, query))
    query, member, distance = query[order], member[order], distance[order]
    begins = np.flatnonzero(np.diff(query, prepend=-1))
    kept = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query)))) < k
    return query[kept], member[kept], distance[kept]


def _between(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """All distances, summed in the order of dimensions as l2() does."""
    total = np.zeros((len(queries), len(members)))
    for x, y in zip(queries.T, members.T, strict=True):
        total += (x[:, None] - y[None, :]) ** 2
    return np.sqrt(total)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _read(clusters: Clusters, asked: DataFrame, n_asked: int, k: int) -> DataFrame:
    """(query, id, distance): the nearest of each query (query, qv, kth) in the clusters that come first where kth is null, else in the others, within kth.

    At most k of a query from each group of members.
    """
    n, cores = int(clusters.sizes.sum()), asked.sparkSession.sparkContext.defaultParallelism
    groups = max(n // GROUP_MEMBERS + 1, min(2 * cores, n // LEAST_MEMBERS + 1))
    parts = n_asked // GROUP_QUERIES + 1
    dimensions = clusters.centroids.shape[1]
    members = clusters.members.select("id", "vector", "cluster", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), F.explode(_numbers(parts)).alias("h"))
    asked = asked.select("query", "qv", "kth", F.explode(_numbers(groups)).alias("g"), F.pmod(F.xxhash64("query"), F.lit(parts)).alias("h"))
    figures = Clusters(None, clusters.centroids, clusters.radii, clusters.sizes)  # what is sent to tasks

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "id", "distance"]
        ids, vectors, own = left.column("id").combine_chunks(), _matrix(left.column("vector"), dimensions), left.column("cluster").to_numpy()
        asking, kth = _matrix(right.column("qv"), dimensions), right.column("kth").to_numpy().astype(np.float64)
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        runs = [order[i : min(i + MEMBERS_AT_ONCE, end)] for begin, end in zip(begins, np.append(begins[1:], len(order)), strict=True) for i in range(begin, end, MEMBERS_AT_ONCE)]
        done = []
        for lo in range(0, len(asking), QUERIES_AT_ONCE):
            q, bound = asking[lo : lo + QUERIES_AT_ONCE], kth[lo : lo + QUERIES_AT_ONCE]
            start = np.isnan(bound)  # null: the first clusters are wanted
            first, others = _wanted(figures, _distances(q, figures.centroids), bound, k)
            need = np.where(start[:, None], first, others)
            most = np.where(start, np.inf, bound * (1 + ROOM))
            held, n_held = [], 0
            for rows in runs:
                wanted = np.flatnonzero(need[:, own[rows[0]]])
                if not len(wanted):
                    continue
                d = _between(q[wanted], vectors[rows])
                i, j = np.nonzero(d <= most[wanted][:, None])
                held.append((wanted[i], rows[j], d[i, j]))
                n_held += len(i)
                if n_held > PAIRS_HELD:
                    held = [_first(*map(np.concatenate, zip(*held, strict=True)), place, k)]
                    n_held = len(held[0][0])
            if held:
                i, j, d = _first(*map(np.concatenate, zip(*held, strict=True)), place, k)
                done.append((i + lo, j, d))
        i, j, d = map(np.concatenate, zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table([right.column("query").combine_chunks().take(pa.array(i)), ids.take(pa.array(j)), pa.array(d)], names=names)

    schema = f"query {asked.schema['query'].dataType.simpleString()}, id {members.schema['id'].dataType.simpleString()}, distance double"
    return members.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(run, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asked(clusters: Clusters, queries: DataFrame, id: str, vector: str) -> DataFrame:
    return queries.filter(F.size(vector) == clusters.centroids.shape[1]).select(F.col(id).alias("query"), F.col(vector).cast("array<double>").alias("qv"))


def _start(clusters: Clusters, asked: DataFrame, n_asked: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The nearest in the clusters that come first, and each query's kth distance there: (query, kth), infinite where there are fewer."""
    start = cut(_read(clusters, asked.withColumn("kth", F.lit(None).cast("double")), n_asked, k))
    kth = _best(start, k).groupBy("query").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    return start, kth.select("query", F.when(F.col("n") < k, float("inf")).otherwise(F.col("kth")).alias("kth"))


def nearest(clusters: Clusters, queries: DataFrame, id: str, vector: str, k: int) -> DataFrame:
    """query, rank, id, distance: the k nearest of each query, ties by id."""
    if not len(clusters.centroids):
        return clusters.members.select(F.col("id").alias("query"), F.lit(1).alias("rank"), "id", F.col("r").alias("distance")).limit(0)
    asked = _asked(clusters, queries, id, vector)
    n_asked = asked.count()
    start, kth = _start(clusters, asked, n_asked, k)
    more = _read(clusters, asked.join(kth, "query"), n_asked, k)
    return _best(start.unionByName(more), k).select("query", "rank", "id", "distance")


def share_read(clusters: Clusters, queries: DataFrame, id: str, vector: str, k: int) -> float:
    """The share of all pairs of a query and a vector whose distance nearest() computes."""
    asked = _asked(clusters, queries, id, vector)
    n_asked = asked.count()
    _, kth = _start(clusters, asked, n_asked, k)
    figures, dimensions = Clusters(None, clusters.centroids, clusters.radii, clusters.sizes), clusters.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(lo, QUERIES_AT_ONCE)
                first, others = _wanted(figures, _distances(_matrix(part.column(0), dimensions), figures.centroids), part.column(1).to_numpy(zero_copy_only=False), k)
                yield pa.RecordBatch.from_arrays([pa.array((first | others) @ figures.sizes)], names=["n"])

    read = asked.join(kth, "query").select("qv", "kth").mapInArrow(run, "n double").agg(F.sum("n")).first()[0]
    total = clusters.sizes.sum() * n_asked
    return float((read or 0.0) / total) if total else 0.0
