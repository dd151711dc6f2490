"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch keeps every 64-bit hash of its five-word shingles that lies below a fixed
fraction of the hash range, by default the half of it, without exception or fallback. So
the sketch of a union is the union of the sketches, and shares of sketches estimate shares
of texts, however unequal their lengths. A text of few words may have no hash in its
sketch, and its estimates are coarse; `edited_report` gives the shares of the full sets
besides. With `scale=1` sketches are the full sets. Words are runs without ASCII white
space; a text of fewer words is one shingle.

A null or empty text has an empty sketch; two empty sketches are alike (1), as equal
fingerprints are, one and any other are not (0). Rows with the same doc_id stand in the order of their texts; a null doc_id
comes last. A table of one row is its own next document. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, partitions, whole_text

WORDS = 5
#: One shingle hash in so many is kept.
SCALE = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse modulo 2**64, up to n."""
    known = _powers[kind]
    if len(known) <= n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n < 1 << 20:
            _powers[kind] = known
    return known


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, from sums over the bytes of the whole text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    solid = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw))[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _power("down", len(raw))[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    factors = _power("up", size + 1)
    for k in range(size):
        out += words[k : k + n - size + 1] * factors[k + 1]
    return _mix(out + np.uint64(size))


def sketch(text: str, size: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below 2**64 / scale."""
    return below(np.unique(shingle_hashes(word_hashes(text), size)), scale)


def below(hashes: np.ndarray, scale: int) -> np.ndarray:
    return hashes[hashes <= np.uint64((1 << 64) // scale - 1)]


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.isin(a, b, assume_unique=True).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance: shared hashes by all hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = shared(a, b)
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a that is in b."""
    return shared(a, b) / len(a) if len(a) else 1.0


def fingerprint_documents(docs: DataFrame, size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Adds `fingerprint` to the columns; of that name, this one wins."""
    kept = [c for c in docs.columns if c not in ("fingerprint", "text")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, *rest in rows:
            yield (*rest, text, written(sketch(text or "", size, scale)))

    schema += (", " if schema else "") + "text string, fingerprint string"
    return map_rows(docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in kept]), run, schema)


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(doc_id, text, next_text)` for every document and the next one by descending
    doc_id (null last, equal ids by text; after the last comes the first).

    Texts move once, to ranges of doc_id. What a range needs of its neighbour is one
    document, which is sent along. The driver holds the bounds of the ranges only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = texts.select("doc_id")
    ranges = 4 * partitions(docs.sparkSession)
    points = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", points, 20 * ranges)).first()[0] or []))

    def place(doc_id: int | None) -> int:
        return -1 if doc_id is None else bisect_right(bounds, doc_id)

    def placed_ids(rows: Iterator[tuple]) -> Iterator[tuple]:
        tops: dict[int, int] = {}
        for (doc_id,) in rows:
            k = place(doc_id)
            if k >= 0 and doc_id > tops.get(k, doc_id - 1):
                tops[k] = doc_id
        yield from tops.items()

    # one row per range: its largest id
    found = map_rows(ids, placed_ids, "place int, top long").groupBy("place").agg(F.max("top").alias("top")).collect()
    tops = {r.place: r.top for r in found}
    order = sorted(tops, reverse=True)
    # of the rows without an id only the first text is needed elsewhere
    idless = texts.where("doc_id is null").agg(F.min("text")).first()[0]
    goes_to = {tops[k]: order[i - 1] for i, k in enumerate(order) if i}
    if order:
        goes_to[tops[order[0]]] = order[-1] if idless is None else -1
    ends_with = {} if idless is None else {(order[-1] if order else -1): idless}

    def placed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield place(doc_id), 0, doc_id, text
            if doc_id in goes_to:
                yield goes_to[doc_id], 1, doc_id, text

    def paired(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for at, guest, doc_id, text in rows:
            if held and held[0] == at:
                yield fn(held[1], held[2], text)
            elif held:  # a range that ends before the rows without an id
                yield fn(held[1], held[2], ends_with[held[0]])
            held = None if guest else (at, doc_id, text)
        if held:
            yield fn(held[1], held[2], ends_with[held[0]])

    moved = map_rows(texts, placed, "place int, guest int, doc_id long, text string")
    near = moved.repartition("place").sortWithinPartitions("place", "guest", F.col("doc_id").desc(), "text")
    return map_rows(near, paired, schema)


def edited_report(docs: DataFrame, size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the
    next document, and how alike the fingerprints are; `full_` are the shares of the
    full sets of shingles."""

    def report(doc_id: int | None, text: str, following: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        full = [sketch(t, size, 1) for t in (text, edited, following)]
        own, changed, other = (below(hashes, scale) for hashes in full)
        return (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            written(own),
            written(changed),
            likeness(own, changed),
            likeness(own, other),
            containment(own, changed),
            containment(own, other),
            likeness(full[0], full[1]),
            likeness(full[0], full[2]),
        )

    return with_next(
        docs,
        report,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double, contained_next double, "
        "full_edited double, full_next double",
    )
