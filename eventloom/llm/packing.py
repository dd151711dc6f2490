"""Cost-balanced packing of documents into training sequences.

A document of n tokens in a sequence costs n + n * n / length: a linear part and the
attention over itself. Documents are taken in descending order; each goes to the
sequence of the lowest cost that still has room for it, and is cut where none has.

Documents are dealt to groups by a hash of id, content and number of the row, so repeated
rows spread like others, a group being as many sequences as about GROUP_CHARS characters fill, and each group is packed by itself, so
no task sees more than a group. Very long documents are dealt in segments. The room in a
group equals its tokens: whole sequences, and for the rest sequences whose lengths are
the powers of two that add up to it, which need no padding.

A null text is an empty one, with only the closing token. Repeated rows are packed like
any others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text
from .tokens import VOCABULARY, encoder, wide

LENGTH = 4096
END_ID = 2
GROUP_CHARS = 1_000_000
#: Longer documents are dealt in segments of so many tokens.
SEGMENT = 32 * LENGTH

Piece = tuple[int, int, int, int, int]


def cost(n: np.ndarray | int, length: int = LENGTH):
    return n + n * n / length


def rooms(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences of a group: whole ones, then powers of two."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], length: int = LENGTH) -> list[Piece]:
    """(document, start, length, sequence, offset) for documents in descending order."""
    room = np.array(rooms(sum(lengths), length), dtype=np.int64)
    used = np.zeros(len(room), dtype=np.int64)
    costs = np.zeros(len(room))
    out: list[Piece] = []
    for doc, n in enumerate(lengths):
        start = 0
        while n:
            piece = min(n, length)
            fits = room - used >= piece
            if not fits.any():
                fits = room > used
            k = int(np.argmin(np.where(fits, costs, np.inf)))
            piece = min(piece, int(room[k] - used[k]))
            out.append((doc, start, piece, k, int(used[k])))
            used[k] += piece
            costs[k] += cost(piece, length)
            start += piece
            n -= piece
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length and, unless switched off, the piece's `ids` as little-endian
    32-bit numbers."""
    if length & (length - 1):
        raise ValueError("the sequence length has to be a power of two")
    # the number of the row tells repeated rows apart
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("row"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = chars // GROUP_CHARS + 1

    def encoded(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = encoder(vocabulary)
        close = END_ID.to_bytes(2, "little")
        for doc_id, text, number in rows:
            ids = words.encode(text) + close
            total = len(ids) // 2
            mark = zlib.crc32(ids, 0 if doc_id is None else doc_id & 0xFFFFFFFF)
            for k, start in enumerate(range(0, total, SEGMENT)):
                group = zlib.crc32(b"%d %d %d" % (mark, number, k)) % groups
                yield group, doc_id, start, total, ids[2 * start : 2 * (start + SEGMENT)]

    def packed(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held = None, []
        for row in rows:
            if row[0] != at and held:
                yield from one_group(at, held)
                held = []
            at = row[0]
            held.append(row)
        if held:
            yield from one_group(at, held)

    def one_group(group: int, held: list[tuple]) -> Iterator[tuple]:
        held.sort(key=lambda r: (-len(r[4]), r[1] is None, r[1] or 0, r[2], r[4]))
        lengths = [len(r[4]) // 2 for r in held]
        sizes = rooms(sum(lengths), length)
        for doc, start, n, sequence, offset in pack(lengths, length):
            _, doc_id, first, total, ids = held[doc]
            own = wide(ids[2 * start : 2 * (start + n)])
            row = (doc_id, first + start, n, zlib.crc32(own), total, (group << 24) + sequence, offset, sizes[sequence])
            yield (*row, own) if with_ids else row

    dealt = map_rows(texts, encoded, "pack_group long, doc_id long, start long, total long, ids binary")
    gathered = dealt.repartition("pack_group").sortWithinPartitions("pack_group")
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "sequence_length long"
    )
    return map_rows(gathered, packed, schema + (", ids binary" if with_ids else ""))
