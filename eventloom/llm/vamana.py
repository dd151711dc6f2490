"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Equal vectors are one point; its rows are its members. Points are dealt to shards of
about SHARD points by a hash of their vector. In a shard points are inserted in rounds:
a beam search from the medoid through the graph so far visits candidates, of which
robust pruning keeps the nearest, drops all that are ALPHA times nearer to it than to
the point, and so on, until DEGREE neighbours are kept that lie in different directions.
Kept neighbours get the point as theirs and are pruned again when they have too many. Two
passes are made, the first with ALPHA 1. A query is sent to every shard of its dimension,
where a beam search finds candidates; distances to these are computed in double
precision from the original vectors, and the nearest over all shards are returned.

A vector takes no part if it is null, zero, or holds a null or a component that is not
finite. Ties go to the smaller id. Rows with a null vec_id take no part. A repeated
vec_id is as many candidates as it has different vectors, and each of its vectors is a
query. Tables with fewer candidates than asked for give all; an empty one gives nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.workspace import ship_package

from .common import stored

DEGREE, ALPHA = 32, 1.2
#: Width of the beam when building and when asked.
BUILD_BEAM, QUERY_BEAM = 48, 64
#: Points of a shard, and points that search together.
SHARD, BLOCK = 4096, 256


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to b[i, j]."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


class Graph:
    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> None:
        self.points, self.degree = points, degree
        n = len(points)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        centre = points.mean(axis=0)
        self.start = int(np.argmin(((points - centre) ** 2).sum(axis=1)))
        order = np.random.default_rng(n).permutation(n)
        for factor in (1.0, alpha):
            at, step = 0, 1 if factor == 1.0 else BLOCK
            while at < n:
                self._insert(order[at : at + step], beam, factor * factor)
                at += step
                step = min(2 * step, BLOCK)

    def _insert(self, block: np.ndarray, beam: int, factor: float) -> None:
        seen, _ = self.search(self.points[block], beam)
        found = np.concatenate([seen, self.edges[block], np.full((len(block), 1), self.start)], axis=1)
        self.edges[block] = self._prune(block, found, factor)
        # kept neighbours get the new points as theirs
        source = np.repeat(block, self.degree)
        target = self.edges[block].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        counts = np.diff(np.append(first, len(target)))
        wide = np.full((len(nodes), int(counts.max(initial=0))), -1, dtype=np.int32)
        row = np.repeat(np.arange(len(nodes)), counts)
        wide[row, np.arange(len(target)) - first[row]] = source
        both = np.concatenate([self.edges[nodes], wide], axis=1)
        for i in range(0, len(nodes), BLOCK):
            self.edges[nodes[i : i + BLOCK]] = self._merge(nodes[i : i + BLOCK], both[i : i + BLOCK], factor)

    def _merge(self, nodes: np.ndarray, found: np.ndarray, factor: float) -> np.ndarray:
        """All neighbours found if there is room for them, else pruned."""
        found = np.sort(found, axis=1)[:, ::-1]
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, axis=1)
        full = (found >= 0).sum(axis=1) > self.degree
        out = found[:, : self.degree].copy()
        if full.any():
            out[full] = self._prune(nodes[full], found[full], factor)
        return out

    def _prune(self, nodes: np.ndarray, found: np.ndarray, factor: float) -> np.ndarray:
        """Robust pruning of several nodes at once."""
        own = self.points[nodes]
        found = np.where(found == nodes[:, None], -1, found)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        near = np.where(found >= 0, squared(own, self.points[found]), np.inf)
        order = np.argsort(near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        used = int(np.isfinite(near).sum(axis=1).max(initial=0))
        found, near = found[:, :used], near[:, :used]
        out = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        vectors = self.points[found]
        open_ = np.isfinite(near)
        for k in range(self.degree):
            if not open_.any():
                break
            best = np.argmax(open_, axis=1)
            has = open_[rows, best]
            out[has, k] = found[rows, best][has]
            between = squared(vectors[rows, best], vectors)
            open_ &= ~(has[:, None] & (factor * between <= near))
            open_[rows, best] = False
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest points found for each query (-1: none) and their squared
        distances, nearest first."""
        q, n = len(queries), len(self.points)
        beam = min(beam, n)
        ids = np.full((q, beam), -1, dtype=np.int32)
        near = np.full((q, beam), np.inf)
        open_ = np.zeros((q, beam), dtype=bool)
        ids[:, 0], open_[:, 0] = self.start, True
        near[:, 0] = squared(queries, self.points[ids[:, :1]])[:, 0]
        met = np.zeros((q, n), dtype=bool)
        met[:, self.start] = True
        live = np.arange(q)
        while len(live):
            best = np.argmax(open_[live], axis=1)  # rows are sorted: the nearest open one
            open_[live, best] = False
            ahead = self.edges[ids[live, best]]
            new = (ahead >= 0) & ~met[live[:, None], ahead]
            met[np.repeat(live, ahead.shape[1])[new.ravel()], ahead[new]] = True
            far = np.full(ahead.shape, np.inf)
            row, col = np.nonzero(new)
            d = self.points[ahead[row, col]] - queries[live[row]]
            far[row, col] = np.einsum("ij,ij->i", d, d)
            all_near = np.concatenate([near[live], far], axis=1)
            pick = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            near[live] = np.take_along_axis(all_near, pick, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, ahead, -1)], axis=1), pick, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], axis=1), pick, 1) & np.isfinite(near[live])
            live = live[open_[live].any(axis=1)]
        return ids, near


# -- on Spark -----------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, key): vectors that take part, doubles; equal ones have equal keys."""
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = embeddings.where("vec_id is not null and embedding is not null")
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    out = out.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0.0))
    text = F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))
    return out.select("vec_id", "vector", F.unhex(F.md5(text.cast("binary"))).alias("key")).distinct()


def nearest(
    embeddings: DataFrame, is_query, k: int = 10, shard: int = SHARD, beam: int = QUERY_BEAM
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where the column is_query holds (an
    expression over vec_id): the k nearest other rows found."""
    rows = stored(usable(embeddings), "vectors")
    # of equal vectors only the smallest k + 1 ids can be among the k nearest
    order = Window.partitionBy("key").orderBy("vec_id")
    members = rows.select("key", "vec_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = stored(members.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "members")
    points = rows.groupBy("key").agg(F.first("vector").alias("vector")).withColumn("dim", F.size("vector"))
    points = stored(points, "points")
    sizes = {r.dim: r["count"] // shard + 1 for r in points.groupBy("dim").count().collect()}
    if not sizes:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in sizes.items()])
    offsets = {d: sum(list(sizes.values())[:i]) for i, d in enumerate(sizes)}
    place = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in offsets.items()]) + F.col("shard")

    dealt = points.select("dim", F.pmod(F.xxhash64("key"), shards).cast("int").alias("shard"), F.lit(0).alias("asks"), "key", "vector")
    asked = rows.where(is_query).select("key").distinct().join(points, "key")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1).alias("asks"), "key", "vector")
    both = dealt.unionByName(asked.withColumn("shard", F.col("shard").cast("int")))
    # every shard is a task of its own
    both = both.repartitionById(sum(sizes.values()), place.cast("int")).sortWithinPartitions("dim", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, _), points_at, queries in _shards(batches):
            if not points_at or not queries:
                continue
            keys, vectors = _stack(points_at, dim)
            graph = Graph(vectors)
            for part in queries:
                asking, wanted = _stack([part], dim)
                for i in range(0, len(wanted), BLOCK):
                    ids, near = graph.search(wanted[i : i + BLOCK], max(beam, k + 1))
                    ids, near = ids[:, : k + 1], near[:, : k + 1]
                    ok = np.isfinite(near)
                    source = np.repeat(np.arange(i, i + len(ids)), ok.sum(axis=1))
                    d = wanted[source] - vectors[ids[ok]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([asking[s] for s in source.tolist()], pa.binary()),
                            pa.array([keys[t] for t in ids[ok].tolist()], pa.binary()),
                            pa.array(np.sqrt((d * d).sum(axis=1))),
                        ],
                        names=["asking", "key", "score"],
                    )

    ship_package(embeddings.sparkSession)
    found = both.mapInArrow(run, "asking binary, key binary, score double")
    # points first: with its members each is k + 1 rows at most
    best = Window.partitionBy("asking").orderBy("score", "key")
    found = stored(found, "found")
    kept = found.withColumn("at", F.row_number().over(best))
    edge = kept.where(F.col("at") == k + 1).select("asking", F.col("score").alias("edge"))
    kept = found.join(edge, "asking", "left").where(F.coalesce(F.col("score") <= F.col("edge"), F.lit(True))).drop("edge")
    kept = kept.join(members, "key").select("asking", "score", F.explode("members").alias("vec_id"))
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("key").alias("asking"))
    # equal queries ask once; the answer to each leaves itself out
    near = Window.partitionBy("asking").orderBy("score", "vec_id")
    kept = stored(kept.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1), "answers")
    out = asking.join(kept, "asking").where("vec_id <> query_id")
    last = Window.partitionBy("query_id", "asking").orderBy("score", "vec_id")
    out = out.select("query_id", "asking", "vec_id", "score").withColumn("rank", F.row_number().over(last))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((dim, shard), parts of points, parts of queries): a part is (keys, flat vectors)."""
    at, points, queries = None, [], []
    for batch in batches:
        dims, shards, asks = (batch.column(c).to_numpy() for c in range(3))
        if not len(dims):
            continue
        change = (dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])
        starts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(dims)]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = (int(dims[a]), int(shards[a]))
            if here != at and at is not None:
                yield at, points, queries
                points, queries = [], []
            at = here
            part = batch.slice(a, b - a)
            (queries if asks[a] else points).append((part.column(3).to_pylist(), part.column(4).flatten().to_numpy()))
    if at is not None:
        yield at, points, queries


def _stack(parts: list[tuple], dim: int) -> tuple[list[bytes], np.ndarray]:
    return [k for keys, _ in parts for k in keys], np.concatenate([v for _, v in parts]).reshape(-1, dim)


def nearest_report(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    return nearest(embeddings, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")
