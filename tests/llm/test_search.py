from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from texts import SF, no_docs, odd_docs, odd_texts

import eventloom.llm.search as search
from eventloom.llm.search import SEARCH_SQL, combined, search_items, sharing_plan, terms_of

SCHEMA = "item_id long, text string, rank string"


def plain(docs, items, limit=10):
    """By the words of the rule."""
    texts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    wanted: dict[int | None, set[bytes]] = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c in texts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms if n_terms else 10
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:limit], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    terms = [t.decode() for t in terms_of("A-b C3 'é'Éx\x00漢字 1_2 İ")]
    assert terms == ["a", "b", "c3", "é", "Éx", "漢字", "1", "2", "İ"]
    assert terms_of(None) == terms_of("") == terms_of(" .,\n") == []


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    """Sums along the plan are the sums over the items' terms; shared pairs are gone."""
    rng = random.Random(seed)
    topics = [rng.sample(range(60), 6) for _ in range(6)]
    items = [sorted(set(rng.sample(range(60), 4)) | set(rng.choice(topics)) | set(rng.choice(topics))) for _ in range(30)] + [[], [3]]
    plan = sharing_plan(items, 60)
    values = np.array([rng.randrange(10**6) for _ in range(60)])
    got = combined(plan, np.arange(60), np.zeros(60, np.int64), values, 1)[:, 0]
    assert got.tolist() == [int(values[i].sum()) if i else 0 for i in items]
    assert plan.sums and sum(map(len, plan.items)) < sum(map(len, items))
    left = Counter((a, b) for nodes in plan.items for a in nodes.tolist() for b in nodes.tolist() if a < b)
    assert max(left.values(), default=0) <= 1


def test_sql(spark):
    got = search_items(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert difference(got.toPandas(), connect(SF).execute(SEARCH_SQL).df()) is None


def test_odd_rows(spark, monkeypatch):
    """Nulls, ties, repeated rows and ids, long texts; one item per block and all in one."""
    items = [(1, "line word"), (2, None), (2, "token before"), (None, "after"), (None, "WORD"), (3, "..."), (4, "line word"), (1, "line word"), (5, "x" * 20_000)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], SCHEMA)
    want = plain(odd_texts(), items)
    assert any(r[2] is None for r in want)
    assert rows_of(search_items(odd_docs(spark), frame)) == want
    monkeypatch.setattr(search, "BLOCK", 3)
    assert rows_of(search_items(odd_docs(spark), frame)) == want
    assert search_items(no_docs(spark), frame).count() == 0
    assert search_items(odd_docs(spark), frame.limit(0)).count() == 0


def test_ties(spark):
    """Many equal documents: the smallest ids, whatever the partitions."""
    docs = [(k, "same words here") for k in range(3_000)] + [(k, f"other {k}") for k in range(3_000, 3_050)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "words"), (2, "same other")]
    assert rows_of(search_items(frame, spark.createDataFrame([(i, t, "x") for i, t in items], SCHEMA))) == plain(docs, items)
