from __future__ import annotations

import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F
from texts import given, no_docs, odd_docs, odd_texts
from tokenizers import Tokenizer

from eventloom.llm.bpe import assembled, cuts, encode_documents, round_trip_report
from eventloom.llm.packing import END_ID, LENGTH, cost, pack, pack_documents, rooms
from eventloom.llm.tokens import encoder, refuse_others, vocabulary_path, wide

HARD = ["I'll don't 'S", "a\x1cb \x85 z", "ÀÉ ß ÿ Œuvre", "ΑΣ ΣΑΣ. Ǆ ͅ ẛ̣", "x<|endoftext|>y <|ENDOFTEXT|>", "é." * 50, "漢字 12.5"]


def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def small(ids):
    return b"".join(k.to_bytes(2, "little") for k in ids)


def test_words_agree_with_the_library():
    tokenizer, codec = plain(), encoder()
    for text in [*HARD, *(t or "" for _, t in odd_texts()), *(t for _, t, _ in given()[:60])]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == small(ids)
        assert codec.decode(small(ids)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    passage = given()[3][1] * 3
    a, b = "some words before " * 20 + passage, "other words " * 55 + passage
    parts = [{t[s:e] for s, e in zip([0, *cuts(t)], cuts(t), strict=False)} for t in (a, b)]
    assert len(parts[0] & parts[1]) >= 3
    assert cuts("") == [] and cuts("short") == [5] and cuts("x" * 5000)[-1] == 5000


def test_joins_are_exact():
    codec, tokenizer, draw = encoder(), plain(), random.Random(5)
    for text in [*HARD, "x<|endoftext|>y" * 200, *(t for _, t, _ in given()[:40])]:
        ends = sorted({*cuts(text), *draw.sample(range(1, len(text) + 1), min(6, len(text))), len(text)})
        parts = [(s, e) for s, e in zip([0, *ends], ends, strict=False)]
        parts = [(s, e, codec.encode(text[s:e])) for s, e in parts if draw.random() < 0.7]
        assert assembled(codec, text, parts) == small(tokenizer.encode(text, add_special_tokens=False).ids)


def want(rows):
    tokenizer, out = plain(), []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(i, t) for i, t, _ in given()]
    rows += [(1000 + k, f"{k} " + rows[5][1] + rows[9][1]) for k in range(6)]
    got = round_trip_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == want(rows)
    assert sorted(map(tuple, round_trip_report(odd_docs(spark)).collect()), key=repr) == want(odd_texts())
    assert encode_documents(no_docs(spark)).count() == 0


def test_pack():
    draw = random.Random(1)
    lengths = sorted((draw.randint(1, 9000) for _ in range(300)), reverse=True)
    pieces, sizes = pack(lengths), rooms(sum(lengths))
    used, costs = [0] * len(sizes), [0.0] * len(sizes)
    for doc, start, n, k, offset in pieces:
        assert offset == used[k] and n > 0
        used[k] += n
        costs[k] += cost(n)
    assert used == sizes and sum(sizes) == sum(lengths)
    assert all(size == LENGTH or size & (size - 1) == 0 for size in sizes)
    for doc, total in enumerate(lengths):
        own = sorted(p[1:3] for p in pieces if p[0] == doc)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == total
    # documents that are no longer than half a sequence leave sequences of like cost
    pieces, even = pack([200] * 1000 + [100] * 1000), {}
    for doc, _, n, k, _ in pieces:
        even[k] = even.get(k, 0) + cost(n)
    whole = [even[k] for k, size in enumerate(rooms(300_000)) if size == LENGTH]
    assert max(whole) / min(whole) < 1.05
    assert pack([]) == []


def test_packing(spark):
    tokenizer = plain()
    rows = [(i, t) for i, t, _ in given()] + [(500, given()[0][1] * 80), (501, None), (502, ""), (None, "no id")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.length for r in got] == [len(r.ids) // 4 for r in got]
    for doc_id, text in rows:
        ids = small([*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID])
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == wide(ids)
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) // 2 for r in own)
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= LENGTH and n & (n - 1) == 0 for n in sequences.values())


def test_packing_odd(spark):
    out = pack_documents(odd_docs(spark), with_ids=False)
    assert "ids" not in out.columns
    assert out.where("start = 0").count() == len(odd_texts())
    assert pack_documents(no_docs(spark)).count() == 0


def test_equal_rows_spread(spark):
    """Rows without an id and with one text don't meet in one group."""
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same forty characters in all rows ...").alias("text"))
    out = pack_documents(rows, with_ids=False).groupBy(F.shiftright("sequence_id", 24).alias("g")).agg(F.sum("length").alias("n")).collect()
    sizes = [r.n for r in out]
    assert len(sizes) == 2 and max(sizes) < 1.1 * min(sizes)


def test_other_tokenizers_are_refused():
    settings = json.loads(plain().to_str())
    refuse_others(settings)
    other = [
        settings | {"normalizer": None},
        settings | {"pre_tokenizer": None},
        settings | {"decoder": {"type": "ByteLevel"}},
        settings | {"model": settings["model"] | {"type": "WordPiece"}},
        settings | {"added_tokens": [settings["added_tokens"][0] | {"content": "[end]"}]},
    ]
    for changed in other:
        with pytest.raises(ValueError, match="word-level"):
            refuse_others(changed)
    with pytest.raises(ValueError, match="word-level"):
        encoder("byte_bpe_50k.json")


def test_packing_with_clashing_names(spark):
    """Columns of the input named like those of the result are ignored."""
    docs = spark.createDataFrame([(k, f"words of text {k}") for k in range(9)], "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("own") for c in ("start", "length", "offset", "row", "pack_group", "ids", "sequence_id")})
    assert sorted(map(tuple, pack_documents(clash).collect())) == sorted(map(tuple, pack_documents(docs).collect()))
