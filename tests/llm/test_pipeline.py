"""The stages of the pipeline, each against a plain version on its own input."""

from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F
from test_lines import brute_force as without_repeats
from test_secrets import brute_force as base_spans
from test_tokens import plain
from texts import SF, no_docs, odd_docs

import corpus_pipeline
from eventloom.llm import common
from eventloom.llm.catalog import llm_oracle, llm_queries
from eventloom.llm.packing import END_ID
from eventloom.llm.quality import THRESHOLD, learn
from eventloom.llm.secrets import secret_report

FILTERS = [name for name, _ in corpus_pipeline.STAGES[:-1]]


def test_queries():
    names = sorted(int(n[2:].split("_")[0]) for n in llm_queries())
    assert names == list(range(1, 14))
    assert set(llm_oracle()) <= set(llm_queries())
    assert [len(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [3] * 5


@pytest.fixture(scope="module")
def chain(spark):
    """Stage -> what it got and what it returned."""
    docs, out = common.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, common.stored(stage(spark, docs, SF), "stage")
        out[name] = (given, docs)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.orderBy("doc_id").collect()}


def test_stages(spark, chain):
    """Every stage works on what the one before kept and returns whole documents."""
    for name in FILTERS:
        assert chain[name][1].columns == list(corpus_pipeline.COLUMNS)
        assert all(r.n_chars == len(r.text) for r in chain[name][1].collect())
    ids = [{r.doc_id for r in out.collect()} for _, out in chain.values()]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    quality = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    kept = [quality[i] for i in ids[0] if i in quality]
    assert len(ids[0]) > 0.7 * 200 and sum(kept) > 0.95 * len(kept)


def test_quality_stage(spark, chain):
    given, out = chain["quality classifier"]
    model = learn(given, common.table(spark, SF, "labels"))
    assert rows(out) == {i: t for i, t in rows(given).items() if model.score_text(t) >= THRESHOLD}


def test_line_stage(chain):
    given, out = (rows(df) for df in chain["line dedup"])
    want = without_repeats(list(given.values()))
    assert out == {i: text for i, (text, _) in zip(given, want, strict=True)}


def test_near_dedup_stage(chain):
    """All pairs, by the resemblance of their sets of five words in a row."""
    given, out = (rows(df) for df in chain["simhash near-dedup"])

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, label = {i: shingles(t) for i, t in given.items()}, {i: i for i in given}
    for a, x in sets.items():
        for b, y in sets.items():
            if b < a and 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if k == old else k for i, k in label.items()}
    assert out == {i: t for i, t in given.items() if label[i] == i}
    assert len(out) < len(given)


def test_secret_stage(chain):
    given, out = chain["secret scans"]
    spans = {r.doc_id: r.spans.split(",") if r.spans else [] for r in secret_report(given).collect()}
    want = {}
    for i, text in rows(given).items():
        base = base_spans(text)
        assert set(base.split(",") if base else []) <= set(spans[i])
        merged = []
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i]):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        for start, end in reversed(merged):
            text = text[:start] + "[secret]" + text[end:]
        want[i] = text
    assert rows(out) == want
    assert not any("AKIA" in t or "password=" in t for t in want.values())


def test_packing_stage(chain):
    given, out = chain["packing"]
    tokenizer, pieces = plain(), {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + r.ids
    for i, text in rows(given).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, END_ID]
        assert pieces.pop(i) == b"".join(k.to_bytes(4, "little") for k in ids)
    assert not pieces


def test_odd(spark):
    docs = odd_docs(spark).withColumns({c: F.lit("own") for c in ("ord", "row", "score", "predicted", "start", "n_removed")})
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "stage")
        assert docs.count() > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty(spark, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, no_docs(spark), SF)
    assert out.count() == 0
    if name in FILTERS:
        assert out.columns == list(corpus_pipeline.COLUMNS)
