from __future__ import annotations

import numpy as np
from texts import SF

from eventloom.llm import common, simhash
from eventloom.llm.simhash import alike_links, distinct_shingles, one_of_each_group, prefix, similar_documents


def words(k, n):
    return [f"w{k}x{j}" for j in range(n)]


def resemblance(a, b):
    x, y = (set(distinct_shingles(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_force(rows):
    """The smallest id of each component of resemblances of 0.8 or more."""
    sets = [set(distinct_shingles(t or "").tolist()) for _, t in rows]
    label = [i for i, _ in rows]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if k == old else k for k in label]
    return label


def best(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.ord: r.best.ord for r in similar_documents(docs, **options).collect()}


def pairs_at(low, high, sizes):
    """Texts and copies with their tail replaced, with a resemblance from low to under high."""
    rows = []
    for k, n in enumerate(sizes):
        own = words(k, n)
        for cut in range(n):
            copy = own[: n - cut] + words(k + 10_000, cut)
            if low <= resemblance(" ".join(own), " ".join(copy)) < high:
                rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
                break
    return rows


def test_under_the_line_is_clean(spark):
    for low, high in ((0.6, 0.7), (0.7, 0.8)):
        rows = pairs_at(low, high, range(40, 500, 9))
        assert len(rows) > 80
        kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows)


def test_short_texts(spark):
    """Five and four shingles, and every size around the limits of the two ways."""
    rows = [(100 * n + k, " ".join(words(n, n + 4 - k))) for n in (5, 6, 10, 30, 54, 55, 56, 57, 69, 70, 71, 87) for k in (0, -(-n // 5) - (n % 5 > 0), -(-n // 5) + (n % 5 == 0))]
    got = best(spark, rows)
    assert [got[i] for i, _ in rows] == brute_force(rows)
    assert got[501] == 500


def test_given_texts_and_cut_cells(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + k, " ".join(words(7, 150) + words(900 + k, k % 23))) for k in range(90)]
    rows += [(20_000 + k, " ".join(words(8, 30) + words(950 + k, k % 9))) for k in range(60)]
    want = brute_force(rows)
    for limit in (1 << 20, 3_000):
        got = best(spark, rows, limit=limit)
        assert [got[i] for i, _ in rows] == want


def test_links_connect_all_that_are_alike():
    draw = np.random.default_rng(3)
    base = np.unique(draw.integers(0, 2**63, 40).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[draw.random(len(base)) < 0.93], draw.integers(0, 2**63, 2).astype(np.uint64)))) for _ in range(80)]
    rows = [(k, None) for k in range(len(sets))]
    label = [k for k, _ in rows]
    for a, b in alike_links(sets):
        assert 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                assert label[a] == label[b] and np.intersect1d(prefix(sets[a]), prefix(sets[b])).size


def test_chain(spark, monkeypatch):
    """Each text is like the next few only: one group, and no cell holds much of it."""
    chain, step = words(3, 5 * 3_000 + 150), 5
    rows = [(k, " ".join(chain[step * k : step * k + 150])) for k in range(3_000)]
    seen = []
    real = simhash.candidate_cells

    def counted(own, radius):
        found = real(own, radius)
        seen.append(found.groupBy("lane", "part").count().agg({"count": "sum", "*": "count"}).first())
        seen.append(found.groupBy("lane", "part").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(simhash, "candidate_cells", counted)
    got = best(spark, rows)
    assert set(got.values()) == {0} and len(got) == 3_000
    assert max(seen[0]) <= simhash.LANES * 3_000 and seen[1] <= 40
