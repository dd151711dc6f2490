from __future__ import annotations

import math

import duckdb
import numpy as np
from texts import SF

from eventloom.llm.vamana import Graph, nearest, nearest_report
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, query_ids, k=10):
    """(query, rank) -> (score, id), ties to the smaller id."""
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and v.any()]
    out = {}
    for q, a in usable:
        if q in query_ids:
            near = sorted((math.sqrt(((a - b) ** 2).sum()), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, r): x for r, x in enumerate(near[:k], 1)}
    return out


def test_graph():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(1500, 24))
    graph = Graph(points)
    queries = draw.normal(size=(60, 24))
    ids, near = graph.search(queries, 64)
    assert (np.diff(near, axis=1) >= 0).all()
    true = np.argsort(((queries[:, None, :] - points) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len({*a[:10]} & {*b}) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.95
    assert Graph(points[:1]).search(queries, 8)[0].tolist() == [[0]] * 60


def test_recall(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = brute_force(rows, {i for i, _ in rows if i % 20 == 0})
    found = nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 20 == 0, shard=150).collect()
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in found}
    assert got.keys() == want.keys()
    assert np.mean([got[k][1] == want[k][1] for k in want]) > 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(r.score - math.dist(vectors[r.query_id], vectors[r.vec_id])) < 1e-12 for r in found)


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100, [1.0, 3.0]), (101, [-0.0, 5.0]), (102, [0.0, 5.0])]
    rows += [(200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [math.nan, 1.0]), (600, [math.inf, 1.0]), (700, [])]
    rows += [(800, [1.0, 2.0, 3.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    plain = sorted({(i, tuple(v) if v is not None else None) for i, v in rows if i is not None}, key=repr)
    queries = {0, 39, 100, 101, 800}
    found = nearest(docs, F.col("vec_id").isin(*queries)).collect()
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in found}
    assert got == brute_force(plain, queries)
    assert len(found) == len(got)


def test_few(spark):
    assert nearest_report(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0), (100, [3.0], 0), (5, [2.0], 0)], SCHEMA)
    assert sorted(map(tuple, nearest_report(few).collect())) == [(0, 1, 5, 1.0), (0, 2, 100, 2.0), (100, 1, 5, 1.0), (100, 2, 0, 2.0)]
