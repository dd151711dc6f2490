from __future__ import annotations

import hashlib

import numpy as np
from texts import given, no_docs, odd_docs, odd_texts

from eventloom.llm.sketches import (
    SCALE,
    containment,
    edited_report,
    fingerprint_documents,
    likeness,
    shingle_hashes,
    sketch,
    word_hashes,
    written,
)


def shingles(text, size=5):
    words = text.encode().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def test_hashes_follow_the_words():
    a = word_hashes("  one two\tone\nthree ")
    assert a[0] == a[2] and len(set(a.tolist())) == 3
    for _, text, _ in given()[:50]:
        assert len(set(shingle_hashes(word_hashes(text)).tolist())) == len(shingles(text))
    assert len(shingle_hashes(word_hashes("two words"))) == 1


def test_estimates():
    """Likeness and containment are near the true ones where a sketch is large."""
    docs = [t for _, t, _ in given() if len(t) > 4000][:30]
    for a, b in zip(docs, docs[1:], strict=False):
        joined = a + "\n" + b
        x, y = shingles(a), shingles(joined)
        true = len(x & y) / len(x | y)
        assert abs(likeness(sketch(a), sketch(joined)) - true) < 0.2
        assert containment(sketch(a), sketch(joined)) > 0.95
    share = np.mean([len(sketch(t)) / len(shingles(t)) for t in docs])
    assert abs(share * SCALE - 1) < 0.1


def in_order(rows):
    return sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), (r[1] or "").encode()))


def brute_force(rows):
    out, rows = [], in_order(rows)
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = sketch(text), sketch(edited), sketch(following)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), digest, written(own), written(changed), likeness(own, changed), likeness(own, other)))
    return sorted(out, key=repr)


def test_report(spark):
    for rows in ([(i, t) for i, t, _ in given()], odd_texts(), [(None, "a b"), (None, "c")], [(3, "only one")]):
        got = edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((tuple(r)[:7] for r in got), key=repr) == brute_force(rows)
    assert edited_report(no_docs(spark)).count() == 0


def test_odd(spark):
    out = fingerprint_documents(odd_docs(spark))
    assert out.dtypes[-1] == ("fingerprint", "string")
    rows = out.collect()
    assert len(rows) == len(odd_texts())
    assert {r.fingerprint for r in rows if not (r.text or "").strip()} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id == 7}) == 1
