from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest
from compare import connect, difference
from texts import SF, no_docs, odd_docs

from eventloom.llm.mixing import MIX_SQL, mix_sources, targets

LABELS = "doc_id long, quality int, toxic int"


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def fair_targets(sizes: list[int]) -> list[float]:
    """By the words of the rule: share by weight, stop at twice the size, share what is over."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    aim, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        among = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / among > 2 * sizes[k]}
        if not over:
            for k in open_:
                aim[k] = left * weights[k] / among
            break
        for k in over:
            aim[k] = 2.0 * sizes[k]
        left -= sum(aim[k] for k in over)
        open_ -= over
    return aim


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1, 1000, 1], [7], [0, 0, 5], [3, 200, 40, 1, 90, 12, 12], [0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"={k:03d}", f"{k:03d}", n) for k, n in enumerate(sizes)], "_of string, _source string, _size long")
    got = {r["_of"]: r.target for r in targets(rows).collect()}
    assert [got[f"={k:03d}"] for k in range(len(sizes))] == pytest.approx(fair_targets(sizes))


def test_sql(spark):
    got = mix_sources(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), keep=["doc_id"])
    assert difference(got.toPandas(), connect(SF).execute(MIX_SQL).df()) is None


def test_odd_rows(spark):
    """Nulls, ids and rows that repeat, long texts; the same as by SQL."""
    rows = odd_docs(spark).union(odd_docs(spark).replace("en", "x").selectExpr("doc_id", "text", "lang", "'é' source", "n_chars", "fingerprint", "spans"))
    mixed = mix_sources(rows.withColumnRenamed("spans", "size"), no_labels(spark))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "fingerprint", "size", "source_size", "target", "taken"]
    con = duckdb.connect()
    con.register("documents", rows.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet' WHERE doc_id < 0")
    got = mixed.select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert difference(got, con.execute(MIX_SQL).df()) is None
    assert mix_sources(no_docs(spark), no_labels(spark)).count() == 0


def test_copies(spark):
    """Thousands of equal rows in one source: the target is met to the word."""
    rows = docs(spark, [(None, "one two three", "a")] * 3_000 + [(k, "w " * (k % 7), "b") for k in range(300)] + [(5, None, None)])
    got = mix_sources(rows, no_labels(spark)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert len(got) == len(rows.collect())
    assert taken == {s: int(t) for s, t in target.items()}


def test_quality(spark):
    """Good documents come before bad ones more often; a rerun agrees."""
    rows = docs(spark, [(k, f"text number {k}", s) for k in range(2_000) for s in ("a", "b", "c")]).repartition(5)
    known = spark.createDataFrame([(k, k % 2, 0) for k in range(2_000)] + [(0, None, 0), (None, 1, 0)], LABELS)
    runs = [sorted((r.source, r.doc_id, r.taken) for r in mix_sources(df, known, keep=["doc_id", "source"]).collect()) for df in (rows, rows.coalesce(2))]
    assert runs[0] == runs[1]
    good = sum(t for s, d, t in runs[0] if s == "c" and d % 2)
    bad = sum(t for s, d, t in runs[0] if s == "c" and not d % 2)
    assert good > 1.3 * bad > 0
