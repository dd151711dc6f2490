"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last 16 characters has its top bits clear, so
equal passages are cut alike wherever they stand. A chunk that occurs more than once, in
one text or in many, is encoded once and its ids are joined back to all its places; the
rest of a text is encoded where it is. A cut may fall inside a word, and then the ids of
the parts are not those of the whole: the words around each join are encoded again,
more of them until the ids on both sides agree with the parts, and replace theirs.

Texts move once, by a hash of id and text, so copies of one text are spread; of chunks
only hashes and places do, and the ids of the shared ones.

A null text is an empty one, with no ids. Rows with equal or null doc_id are kept apart.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.state import delete
from eventloom.workspace import scratch_path

from .common import map_rows, stored, whole_text
from .tokens import VOCABULARY, Encoder, encoder, wide

#: Characters under the rolling hash, bits that have to be clear, least chunk.
WINDOW, CLEAR_BITS, LEAST = 16, 10, 128
_STEP = 0x9E3779B97F4A7C15


def cuts(text: str) -> list[int]:
    """Ends of the chunks, in characters; the last is the text's."""
    if len(text) <= LEAST:
        return [len(text)] if text else []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    span, factor = 1, _STEP
    while span < WINDOW:  # the hash of twice the span from two of the span
        codes = codes[span:] + codes[:-span] * np.uint64(factor)
        span, factor = 2 * span, factor * factor % (1 << 64)
    mixed = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out, last = [], 0
    for end in (np.flatnonzero(mixed >> np.uint64(64 - CLEAR_BITS) == 0) + WINDOW).tolist():
        if end - last >= LEAST:
            out.append(end)
            last = end
    if last < len(text):
        out.append(len(text))
    return out


def chunk_hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


# -- joins of parts -----------------------------------------------------------------


def _word_start(text: str, at: int, words: int) -> int:
    """Where the word before `at` starts, or that many words back."""
    for _ in range(words):
        while at and text[at - 1] in " \t\n\v\f\r":
            at -= 1
        while at and text[at - 1] not in " \t\n\v\f\r":
            at -= 1
    return at


def _word_end(text: str, at: int, limit: int, words: int) -> int:
    for _ in range(words):
        while at < limit and text[at] in " \t\n\v\f\r":
            at += 1
        while at < limit and text[at] not in " \t\n\v\f\r":
            at += 1
    return at


def repaired(codec: Encoder, text: str, done: bytes, at: int, part: bytes, end: int) -> bytes:
    """Ids of text[:end], from those of text[:at] and of text[at:end]."""
    spaces = " \t\n\v\f\r"
    if not at or at == end or text[at - 1] in spaces or text[at] in spaces:
        return done + part
    seam_start, seam_end = _word_start(text, at, 1), _word_end(text, at, end, 1)
    words = 2
    while True:
        start, stop = _word_start(text, at, words), _word_end(text, at, end, words)
        left, right = codec.encode(text[start:at]), codec.encode(text[at:stop])
        whole = codec.encode_whole(text[start:stop])
        before, after = codec.encode(text[start:seam_start]), codec.encode(text[seam_end:stop])
        agrees = whole.startswith(before) and whole.endswith(after) and done.endswith(left) and part.startswith(right)
        if agrees:
            return done[: len(done) - len(left)] + whole + part[len(right) :]
        if start == 0 and stop == end:
            return codec.encode_whole(text[:end])
        words *= 2


def assembled(codec: Encoder, text: str, given: list[tuple[int, int, bytes]]) -> bytes:
    """Ids of the text; given: (start, end, ids) of the chunks encoded elsewhere."""
    done, at = b"", 0
    for start, end, ids in sorted(given):
        if start > at:
            done = repaired(codec, text, done, at, codec.encode(text[at:start]), start)
        done = repaired(codec, text, done, start, ids, end)
        at = end
    if at < len(text):
        done = repaired(codec, text, done, at, codec.encode(text[at:]), len(text))
    return done


# -- on Spark -----------------------------------------------------------------------

#: Places of a chunk that get its ids in one group.
BLOCK = 512


def shared_places(texts: DataFrame) -> DataFrame:
    """(key, start, end, h, blocks, block, first) for every place of a chunk that occurs at two places
    or more; first marks one place of each chunk. texts: key, text."""

    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            start = 0
            for end in cuts(text):
                yield key, start, end, chunk_hash(text[start:end])
                start = end

    spark, path = texts.sparkSession, scratch_path(texts.sparkSession, "chunks")
    found = map_rows(texts, chunks, "key binary, start int, end int, h binary")
    found.write.parquet(path)
    places = spark.read.schema(found.schema).parquet(path)
    place = F.xxhash64("key", "start")
    # rows that are equal have equal places, so smallest and largest tell whether there are two
    ends = places.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b")
    ends = ends.select("h", "a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = places.join(stored(ends, "shared").hint("merge"), "h")
    block = F.pmod(place, F.col("blocks")).cast("int")
    columns = ("key", "start", "end", "h", "blocks", block.alias("block"), (place == F.col("a")).alias("first"))
    out = stored(shared.select(*columns), "places")
    # written again with what matters of it, so nothing reads all chunks any more
    delete(spark, path)
    return out


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, finish=None, schema: str = "ids binary") -> DataFrame:
    """(doc_id, and what `finish` makes of the codec and the ids): by default the ids as
    little-endian 32-bit numbers."""
    finish = finish or (lambda codec, ids: (wide(ids),))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary"))
    # the same two columns in both uses below, which are in one plan: texts move once
    texts = rows.select(F.unhex(digest).alias("key"), F.struct("doc_id", "text").alias("row"))
    places = shared_places(texts.select("key", "row.text"))

    def firsts(batch: Iterator[tuple]) -> Iterator[tuple]:
        codec = encoder(vocabulary)
        for row, spots in batch:
            for spot in spots:
                yield spot["h"], spot["blocks"], codec.encode(row["text"][spot["start"] : spot["end"]])

    # hash joins, built from the small side: texts need no sorting
    spots = places.where("first").groupBy("key").agg(F.collect_list(F.struct("start", "end", "h", "blocks")).alias("spots"))
    own = texts.join(spots.hint("shuffle_hash"), "key", "left")
    # said in terms of both sides, after the join: else Spark would filter the texts before
    # they move, which would be another move than the one below
    own = own.where(F.coalesce(F.size("spots"), F.lit(0)) * F.coalesce(F.length("key"), F.lit(0)) > 0).select("row", "spots")
    encoded = map_rows(own, firsts, "h binary, blocks int, ids binary").dropDuplicates(["h"])
    # one row per block, so the places of a very common chunk don't meet in one task
    encoded = encoded.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ids")
    given = places.select("key", "start", "end", "h", "block").join(encoded, ["h", "block"])
    given = given.groupBy("key").agg(F.collect_set(F.struct("start", "end", "ids")).alias("given"))

    def whole(batch: Iterator[tuple]) -> Iterator[tuple]:
        codec = encoder(vocabulary)
        for row, parts in batch:
            parts = [(p["start"], p["end"], p["ids"]) for p in parts or ()]
            yield (row["doc_id"], *finish(codec, assembled(codec, row["text"], parts)))

    pieces = texts.join(given.hint("shuffle_hash"), "key", "left").select("row", "given")
    return map_rows(pieces, whole, f"doc_id long, {schema}")


def round_trip_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them."""

    def digests(codec: Encoder, ids: bytes) -> tuple:
        decoded = codec.decode(ids).encode()
        return len(ids) // 2, hashlib.sha256(wide(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_documents(docs, vocabulary, digests, schema)
