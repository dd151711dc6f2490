"""Classifiers: held-out accuracy, and texts they have to cope with."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import no_docs, odd_docs, odd_texts

from eventloom.llm.language import UNKNOWN, Languages, identify, language_report, learn
from eventloom.llm.quality import THRESHOLD, Ranking, bradley_terry, keep_good, packed, score_documents, unpacked
from eventloom.llm.quality import learn as learn_quality

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


def test_bradley_terry_finds_the_order():
    draw = np.random.default_rng(0)
    true = np.array([2.0, -1.0, 0.0])
    a, b = draw.normal(size=(2, 4000, 3))
    wins = draw.random(4000) < 1 / (1 + np.exp(-(a - b) @ true))
    got = bradley_terry(np.where(wins[:, None], a - b, b - a))
    assert np.abs(got - true).max() < 0.25


def test_threshold_is_a_quantile():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1.0, 1.0, (900, 2)), draw.normal(-1.0, 1.0, (300, 2))
    model = Ranking(good, bad, 0.25)
    scores = np.concatenate([model.score(good), model.score(bad)])
    assert abs((scores < THRESHOLD).mean() - 0.25) < 0.01
    assert Ranking(good, bad[:0], 0.0).score(good[:2]).tolist() == [0.5, 0.5]


def test_quality(tables):
    docs, labels = tables
    got = score_documents(docs, labels).toPandas().set_index("doc_id")
    truth = labels.toPandas().set_index("doc_id").quality
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got.predicted == (got.score >= THRESHOLD)).all()
    both = got.join(truth, how="inner")
    both = both[both.held_out]
    assert len(both) > 50
    assert (both.predicted == both.quality).mean() > 0.95
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(got[got.predicted == 1].index)


def test_quality_odd(spark, tables):
    _, labels = tables
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0)], labels.schema))
    rows = score_documents(odd_docs(spark), labels).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(no_docs(spark), labels).count() == 0
    assert {r.score for r in score_documents(odd_docs(spark), labels.limit(0)).collect()} == {0.5}


def test_quality_of_texts_under_one_id(spark, tables):
    """Whatever the order of the rows, the same text teaches; clashing names are ignored."""
    docs, labels = tables
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1))
    clash = twice.withColumns({c: F.lit("own") for c in ("score", "predicted", "held_out", "good", "x", "first")})
    other = clash.repartition(5, "text").sortWithinPartitions(F.col("text").desc())
    a, b = learn_quality(twice, labels), learn_quality(other, labels)
    texts = [r.text for r in docs.limit(50).collect()]
    assert [a.score_text(t) for t in texts] == [b.score_text(t) for t in texts]
    got = score_documents(clash, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert got.count() == twice.count()
    assert keep_good(docs.limit(0), labels).count() == 0


def test_every_labelled_document_teaches(spark):
    """More labelled documents than any cell holds, few of them bad: the weights and the
    threshold are those of all documents, and one document more changes them."""
    texts = [(i, "A fine line of text. " * (1 + i % 7) if i % 40 else "junk !!! $$$ " * (1 + i % 11)) for i in range(1, 12_001)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 40 != 0).cast("int").alias("quality"))
    model = learn_quality(docs, labels, rare=10_000, common=10_000)
    teaching = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    x = {flag: unpacked([packed(t) for i, t in teaching if (i % 40 != 0) == flag]) for flag in (True, False)}
    want = Ranking(x[True], x[False], len(x[False]) / len(teaching))
    assert np.allclose(model.weights, want.weights, atol=1e-3) and np.allclose(model.mean, want.mean, atol=1e-6)
    assert abs(model.cut - want.cut) < 1e-3 and abs(model.slope - want.slope) < 1e-3
    small = learn_quality(docs, labels, rare=50, common=300)
    assert [small.score_text(t) >= THRESHOLD for _, t in texts[:200]] == [want.score_text(t) >= THRESHOLD for _, t in texts[:200]]
    more = labels.where("doc_id <> 11999")
    assert not np.array_equal(learn_quality(docs, more).mean, learn_quality(docs, labels).mean)


def test_language(tables):
    docs, _ = tables
    got = language_report(docs).toPandas()
    want = duckdb.connect().execute(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").df()
    both = got.merge(want, on="doc_id")
    assert len(both) == len(want)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.95
    assert both.score.between(0, 1).all()


def test_language_odd(spark, tables):
    docs, _ = tables
    model = learn(docs.select("doc_id", "text", "lang"))
    assert set(model.members) == {"germanic", "romance"}
    rows = identify(odd_docs(spark), model).collect()
    assert len(rows) == len(odd_texts())
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 11)} == {UNKNOWN}
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 7)} <= {"en", "de", "fr", "es"}
    assert language_report(no_docs(spark)).count() == 0
    assert Languages([], []).predict("words") == (UNKNOWN, 0.0)
    assert Languages(["some words"], ["xx"]).predict("words") == ("xx", 1.0)


def test_every_language_is_learned(spark):
    """More languages than one sample's worth, and letters that are none."""
    rows = []
    for k in range(70):
        word = "".join(chr(97 + (k * 7 + i * (k % 5 + 1)) % 26) for i in range(6)) + chr(97 + k % 26) * 2
        rows += [(100 * k + i, f"{word} {word[::-1]} {word[2:]} {i}", f"l{k:02d}") for i in range(6)]
    rows += [(None, "null id", "l00"), (None, "other text", "l00"), (7_001, "² ½ 3", "l01"), (7_002, None, "l02"), (7_003, "", "l03")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs, per_language=5)
    assert len(model.families) == 70
    got = {r.doc_id: (r.lang, r.lang_pred) for r in identify(docs, model).collect()}
    named = [pair for doc_id, pair in got.items() if doc_id is not None and doc_id < 7_000]
    assert sum(a == b for a, b in named) > 0.95 * len(named)
    assert {got[k][1] for k in (7_001, 7_002, 7_003)} == {UNKNOWN}
    # clashing names, and a sample of one row per language
    clash = docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit("y")})
    assert identify(clash, learn(docs, examples=70)).select("score").schema[0].dataType.typeName() == "double"
