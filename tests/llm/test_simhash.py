from __future__ import annotations

import numpy as np
import xxhash
from texts import RUN, given, no_docs, odd_docs, odd_texts

from eventloom.llm.graph import components
from eventloom.llm.simhash import (
    component_report,
    fingerprint,
    links_in_cells,
    near_links,
    one_of_each_group,
    shingle_hashes,
    similar_documents,
    spanning_links,
)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(values, radius):
    """For rows of bits as numbers, the smallest position that links reach."""
    near = np.bitwise_count(values[:, None, :] ^ values[None, :, :]).sum(axis=2) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def clusters(draw, n, words, flips):
    values = draw.integers(0, 2**63, size=(n, words), dtype=np.uint64)
    values[n // 2 :] = values[draw.integers(0, n // 4, size=n - n // 2)]
    for row in values[n // 2 :]:
        for _ in range(draw.integers(0, flips)):
            row[draw.integers(words)] ^= np.uint64(1) << np.uint64(draw.integers(64))
    return values


def test_planes():
    draw = np.random.default_rng(4)
    for words, radius in ((1, 0), (1, 2), (1, 6), (2, 11), (4, 45)):
        values = clusters(draw, 700, words, 2 * radius + 3)
        got = np.arange(len(values))
        for a, b in spanning_links(values, radius):
            got[a] = b
        assert (got == reach(values, radius)).all()


def test_hash_is_that_of_spark(spark):
    text = "Ünï co\tde  words AND more Ä words"
    words = "Ünï co de words and more Ä words".split()
    shingles = [(" ".join(words[k : k + 3]),) for k in range(len(words) - 2)]
    want = spark.createDataFrame(shingles, "s string").selectExpr("xxhash64(s)").collect()
    assert shingle_hashes(text).tolist() == [r[0] % 2**64 for r in want]
    for _, t, _ in given()[:30]:
        assert fingerprint(shingle_hashes(t)) == plain_fingerprint(t)


def test_cells_of_any_size_give_the_same(spark):
    values = clusters(np.random.default_rng(8), 600, 1, 5)
    longs = sorted(set(values[:, 0].astype(np.int64).tolist()))
    fps = spark.createDataFrame([(v,) for v in longs], "fp long")
    want = reach(np.array(longs, dtype=np.int64).view(np.uint64)[:, None], 2)
    for limit in (7, 1 << 14):
        found = {r.node: r.root for r in components(near_links(fps, 2, limit)).collect()}
        groups = {}
        for v, k in zip(longs, want.tolist(), strict=True):
            groups.setdefault(k, []).append(v)
        assert found == {v: min(g) for g in groups.values() for v in g if v != min(g)}
    one = fps.selectExpr("0 as lane", "0L as part", "fp")  # all in one group
    found = {r.node: r.root for r in components(links_in_cells(one, 2, 50)).collect()}
    assert len(found) == len(longs) - len(set(want.tolist()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 200)] + [(7, 7)] + [(1, k) for k in range(300, 400)] + [(350, 450)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    want = {k: 100 for k in range(101, 201)} | {k: 1 for k in [*range(300, 400), 450]}
    assert got == want


def brute_force(rows):
    prints = [plain_fingerprint(t or "") for _, t in rows]
    label = reach(np.array(prints, dtype=np.uint64)[:, None], 2)
    out = []
    for (doc_id, _), fp, k in zip(rows, prints, label.tolist(), strict=True):
        ids = [i for (i, _), j in zip(rows, label.tolist(), strict=True) if j == k and i is not None]
        out.append((doc_id, f"{fp:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_report(spark):
    rows = [(i, t) for i, t, _ in given()]
    rows += [(1000 + k, rows[k][1] + " tail" * (k % 3)) for k in range(40)] + odd_texts()
    got = component_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows)
    assert component_report(no_docs(spark)).count() == 0


def edited(text, every):
    words = text.split(" ")
    return " ".join(f"{w}x" if k % every == every // 2 else w for k, w in enumerate(words))


def test_similar(spark):
    """Copies with few changes go, texts of their own stay."""
    own = [(i, t) for i, t, _ in given() if len(t.split()) > 150]
    shingled = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in own}
    clean = [i for i in shingled if all(len(shingled[i] & s) < 0.3 * len(s) for j, s in shingled.items() if j != i)]
    docs = [(i, t) for i, t in own if i in set(clean)]
    copies = [(10_000 + i, edited(t, 120)) for i, t in docs[:40]] + [(20_000 + i, t) for i, t in docs[:10]]

    def resemblance(a, b):
        sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])

    # a text of few distinct shingles may lose more than a fifth of them by an edit
    texts = dict(docs)
    own_again = [i for i, t in copies if resemblance(texts[i % 10_000], t) < 0.8]
    assert len(own_again) < 5
    kept = one_of_each_group(spark.createDataFrame(docs + copies, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean + own_again)
    assert len(clean) > 50


def test_similar_odd(spark):
    docs = odd_docs(spark)
    assert similar_documents(docs).count() == len(odd_texts())
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if r.text == RUN) == [7]
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert one_of_each_group(no_docs(spark)).count() == 0
