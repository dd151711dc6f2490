"""SimHash near-duplicates, compared over bit planes.

Two forms share the comparison. The exact one (`near_duplicates`) has 64-bit fingerprints
of three-word shingles and links all pairs within RADIUS bits: such a pair agrees, of
radius + 3 blocks of bits, in three at least, so each fingerprint is dealt once for every
three blocks, by their value. The wide one (`similar_documents`) links texts whose sets of
five-word shingles have a resemblance of four fifths or more. Its 256-bit fingerprints,
dealt by the smallest shingle hashes under LANES orders and compared within WIDE_RADIUS,
only find candidates; candidates of a cell meet once more with their texts, and only
pairs whose sets, counted in full, resemble each other enough are links. Texts of
few shingles, whose fingerprints are too coarse, are dealt by the smallest of their own
hashes instead: of two alike, these have one in common.

All fingerprints dealt to one cell are compared. A cell over CELL fingerprints is cut
into blocks, and every two blocks meet in a cell of their own. A comparison stores the
fingerprints of a tile vertically, one word of 64 fingerprints per bit, adds up the
differing bits of 64 pairs at once with carry-save counters, and leaves the tile as soon
as every pair in it is past the radius. A cell gives a spanning set of its links, not all
of them; equal fingerprints are one node, in the wide form equal sets of shingles.

A null or empty text has no shingle and fingerprint zero, which links like any other; in
the wide form such texts are alike and like no other.
Rows with a null doc_id take part; a component's id is the smallest doc_id in it, null if
it has none. Repeated rows are kept, but for `one_of_each_group`, where rows equal in
doc_id and text are one. An empty table gives an empty result. Extra columns are ignored
or, where documents are returned, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.workspace import ship_package

from .common import map_rows, stored, whole_text
from .graph import components
from .sketches import shingle_hashes as wide_shingles
from .sketches import word_hashes

WORDS, RADIUS = 3, 2
SEED = 42

#: The wide form: 64-bit words of a fingerprint, words of a shingle, orders of shingles.
WIDE, WIDE_WORDS, LANES = 4, 5, 12
#: Bits that differ at a resemblance of 0.8 are 39 of 256 on average, with a standard
#: deviation of 6, so a pair to be linked lies past this radius about once in 10 million.
WIDE_RADIUS = 72
#: Resemblance of a link, as a fraction.
ALIKE = (4, 5)
#: Texts of up to SHORT distinct shingles are dealt by their own smallest hashes, those of
#: LONG or more by fingerprint; so every two that can be alike are both the one or the other.
LONG, SHORT = 56, 70

#: Hashes counted at a time, rows of small cells compared together, size of a tile,
#: fingerprints of a block of a large cell.
SLICE, GATHER, TILE, CELL = 1 << 13, 512, 256, 1 << 14
#: Shingles of a block of candidates, a text counting as LEAST at least; texts up to which
#: all pairs of a cell are checked without a look at fingerprints.
BLOCK, LEAST, FEW = 1 << 20, 256, 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    words = text.encode().lower().split()  # both ASCII only
    if len(words) > size:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    else:
        shingles = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(rows, 64 * words) bits of (rows, words) numbers, lowest first."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(len(values), -1)
    return np.unpackbits(raw, axis=1, bitorder="little")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += bits_of(hashes[at : at + SLICE, None]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The same with WIDE independent words made of each hash."""
    counts = np.zeros((WIDE, 64), dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        for k in range(WIDE):
            counts[k] += bits_of(reordered(part, k)[:, None]).sum(axis=0, dtype=np.int64)
    return np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes()


def reordered(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes, one for one, for every k."""
    h = (hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            value = fingerprint(shingle_hashes(text, size))
            yield doc_id, value - (1 << 64) if value >> 63 else value

    return map_rows(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), run, "doc_id long, fp long")


# -- comparison over bit planes -----------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): word w of plane b holds bit b of values 64 w to 64 w + 63."""
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), dtype=np.uint64)
    padded[: len(values)] = values
    return np.packbits(np.ascontiguousarray(bits_of(padded).T), axis=1, bitorder="little").view("<u8")


def near_pairs(queries: np.ndarray, target: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (query, word) of targets within the radius; queries: all bits as 0 or
    1 per row, target: bit planes."""
    # checked after every four planes, so a counter has to hold the radius and four more
    counters = [np.zeros((len(queries), target.shape[1]), dtype=np.uint64) for _ in range((radius + 4).bit_length())]
    past = np.zeros_like(counters[0])
    flips = np.where(queries.T.astype(bool), ALL, np.uint64(0))
    for b, flip in enumerate(flips):
        carry = target[b][None, :] ^ flip[:, None]
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
            if k > 1 and not carry.any():
                break
        if b >= radius and b % 4 == 3:
            past |= _over(counters, radius)
            if (past == ALL).all():
                break
    return ~past


def _over(counters: list[np.ndarray], value: int) -> np.ndarray:
    """Where a counter stands over the value, by comparing from the highest bit down."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if value >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(position, position of its root) for links that join all rows of `values` that
    are connected by distances within the radius."""
    n = len(values)
    root = np.arange(n)
    vertical, flat = planes(values), bits_of(values)
    for i in range(0, n, TILE):
        for w in range(i // 64, vertical.shape[1], TILE // 4):
            near = near_pairs(flat[i : i + TILE], vertical[:, w : w + TILE // 4], radius)
            rows, words = np.nonzero(near)
            if not len(rows):
                continue
            hit, bit = np.nonzero(bits_of(near[rows, words][:, None]))
            a, b = rows[hit] + i, (words[hit] + w) * 64 + bit
            a, b = a[b < n], b[b < n]
            ra, rb = root[a], root[b]
            joins = np.unique(np.stack([np.maximum(ra, rb), np.minimum(ra, rb)], axis=1)[ra != rb], axis=0)
            for x, y in joins.tolist():
                while root[x] != x:
                    x = int(root[x])
                while root[y] != y:
                    y = int(root[y])
                if x != y:
                    root[max(x, y)] = min(x, y)
            while len(joins):
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return [(k, int(r)) for k, r in enumerate(root.tolist()) if r != k]


def cells(dealt: DataFrame, limit: int, weight: str = "1") -> DataFrame:
    """(cell, fp, other columns): dealt (lane, part, fp, ...) with groups of a weight over
    the limit cut into pairs of blocks."""
    others = [c for c in dealt.columns if c not in ("lane", "part", "fp")]
    sizes = dealt.groupBy("lane", "part").agg(F.sum(F.expr(weight)).alias("n")).where(F.col("n") > limit)
    large = stored(sizes.select("lane", "part", F.ceil(F.col("n") / limit).cast("int").alias("blocks")), "large")
    blocks = F.coalesce("blocks", F.lit(1))
    marked = dealt.join(large, ["lane", "part"], "left").select(
        "lane", "part", "fp", *others, blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int").alias("own")
    )
    met = marked.select("lane", "part", "fp", *others, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # two cells of one hash would only be compared with each other as well
    cell = F.xxhash64("lane", "part", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(cell.alias("cell"), "fp", *others)


def links_in_cells(dealt: DataFrame, radius: int, limit: int = CELL) -> DataFrame:
    """Links (u, v) of fingerprints that connect, within the cells, all that lie within
    the radius."""
    ship_package(dealt.sparkSession)
    kind = dealt.schema["fp"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _groups(batches):
            found = spanning_links(_numbers(column), radius)
            if found:
                u, v = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([column.take(u), column.take(v)], names=["u", "v"])

    met = cells(dealt, limit).repartition("cell").sortWithinPartitions("cell")
    return met.mapInArrow(compare, f"u {kind}, v {kind}")


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
    return _bits(column.to_pylist())


def _bits(fps: list[bytes]) -> np.ndarray:
    """The fingerprints in wide nodes."""
    return np.frombuffer(b"".join(fps), dtype="<u8").reshape(len(fps), -1)[:, :WIDE]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """Fingerprints of whole cells of two or more, small cells put together (a link found
    between cells is a link as well)."""
    ready: list[pa.Array] = []
    key, parts = None, []

    def closed() -> list[pa.Array]:
        return parts if sum(map(len, parts)) > 1 else []

    for batch in batches:
        cell, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        if not len(cell):
            continue
        starts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
        lengths = np.diff(starts)
        # the first run may go on from the batch before, the last in the next one
        lengths[[0, -1]] = 2
        for k in np.flatnonzero(lengths > 1).tolist():
            a, b = int(starts[k]), int(starts[k + 1])
            if cell[a] == key:
                parts.append(fp.slice(a, b - a))
                continue
            ready += closed()
            key, parts = cell[a], [fp.slice(a, b - a)]
            if sum(map(len, ready)) >= GATHER:
                yield pa.concat_arrays(ready)
                ready = []
    ready += closed()
    if ready:
        yield pa.concat_arrays(ready)


def block_masks(radius: int) -> list[int]:
    """For every three of radius + 3 blocks, the mask of their bits."""
    n = radius + 3
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, 3)]


def near_links(fps: DataFrame, radius: int = RADIUS, limit: int = CELL) -> DataFrame:
    """Links (u, v) that connect all fingerprints `fp` (distinct longs) within the radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    lanes = [
        F.struct(F.lit(k).alias("lane"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part"))
        for k, m in enumerate(masks)
    ]
    dealt = fps.select("fp", F.explode(F.array(*lanes)).alias("l")).select("l.lane", "l.part", "fp")
    return links_in_cells(dealt, radius, limit)


def labelled(prints: DataFrame, links: DataFrame, least) -> DataFrame:
    """(fp, best): what `least` aggregates over all rows of a fingerprint's component."""
    own = stored(prints.groupBy("fp").agg(least), "distinct")
    rooted = own.join(components(links), own.fp == F.col("node"), "left")
    rooted = stored(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "best"), "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("best").alias("best")), "named")
    return stored(rooted.drop("best").join(named, "root").select("fp", "best"), "labels")


def near_duplicates(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    own = stored(fingerprints(docs, size), "fingerprints")
    links = near_links(own.select("fp").distinct(), radius)
    labels = labelled(own, links, F.min("doc_id").alias("best"))
    return own.join(labels, "fp").select("doc_id", "fp", F.col("best").alias("component_id"))


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- resemblance --------------------------------------------------------------------


def distinct_shingles(text: str, size: int = WIDE_WORDS) -> np.ndarray:
    return np.unique(wide_shingles(word_hashes(text.lower()), size))


def node(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of shingles, then a hash of the whole set."""
    return wide_fingerprint(hashes) + xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def alike(both, a, b):
    """Whether sets of a and b members, `both` of them shared, resemble each other enough."""
    return ALIKE[1] * both >= ALIKE[0] * (a + b - both)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """So many of the smallest hashes that two sets that are alike share one of them."""
    return hashes[: len(hashes) + 1 + -ALIKE[0] * len(hashes) // ALIKE[1]]


def alike_links(sets: list[np.ndarray], values: np.ndarray | None = None, radius: int = WIDE_RADIUS) -> list[tuple[int, int]]:
    """Pairs of positions that are alike and connect all that are; with fingerprints, of
    pairs within the radius."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [flat[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    member = np.zeros(len(known), dtype=bool)
    group = np.arange(n)
    vertical = planes(values) if values is not None else None
    links = []
    for i in range(n):
        if vertical is not None and i % TILE == 0:
            found = near_pairs(bits_of(values[i : i + TILE]), vertical, radius)
            near = bits_of(found).astype(bool)
        able = (ALIKE[1] * sizes[:i] >= ALIKE[0] * sizes[i]) & (ALIKE[1] * sizes[i] >= ALIKE[0] * sizes[:i])
        rest = np.flatnonzero(able if vertical is None else able & near[i % TILE, :i])
        if not len(rest):
            continue
        member[ids[i]] = True
        take = 1
        while len(rest := rest[group[rest] != group[i]]):
            tried, rest, take = rest[:take], rest[take:], 8 * take
            starts = np.concatenate(([0], np.cumsum(sizes[tried])[:-1]))
            both = np.add.reduceat(member[np.concatenate([ids[j] for j in tried])].astype(np.int64), starts)
            for j in tried[alike(both, sizes[i], sizes[tried])].tolist():
                if group[j] != group[i]:
                    links.append((i, j))
                    group[group == group[i]] = group[j]
        member[ids[i]] = False
    return links


def checked_links(met: DataFrame, size: int, radius: int) -> DataFrame:
    """Links (u, v) that connect, within the cells of (cell, fp, content), all that are
    alike; the content is a text or a set of shingles."""

    def closed(fps: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple]:
        if len(fps) > 1:
            values = _bits(fps) if narrowed and len(fps) > FEW else None
            for a, b in alike_links(sets, values, radius):
                yield fps[a], fps[b]

    narrowed = met.schema["content"].dataType.simpleString() == "string"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, fps, sets = None, [], []
        for cell, fp, content in rows:
            if cell != key:
                yield from closed(fps, sets)
                key, fps, sets = cell, [], []
            fps.append(fp)
            sets.append(distinct_shingles(content, size) if narrowed else np.frombuffer(content, dtype="<u8"))
        yield from closed(fps, sets)

    return map_rows(met.select("cell", "fp", "content").repartition("cell").sortWithinPartitions("cell"), run, "u binary, v binary")


def short_links(own: DataFrame, size: int, radius: int, limit: int = BLOCK) -> DataFrame:
    """Links of texts of few shingles: every two that are alike share a hash of their prefix."""
    short = own.where(F.col("content").isNotNull())
    keys = stored(short.select("fp", F.explode("prefix").alias("part")).distinct(), "short-keys")
    shared = keys.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    dealt = stored(keys.join(shared, "part").select(F.lit(0).alias("lane"), "part", "fp"), "short-dealt")
    met = cells(dealt, limit, str(LEAST))
    return checked_links(met.join(short.select("fp", "content").distinct(), "fp"), size, radius)


def candidate_cells(own: DataFrame, radius: int) -> DataFrame:
    """(lane, part, fp): the cells of the fingerprints that have another within the radius,
    without those that hold the same fingerprints as a cell of another lane."""
    dealt = stored(own.select("fp", F.posexplode("keys").alias("lane", "part")).distinct(), "dealt")
    near = links_in_cells(dealt, radius).select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    dealt = stored(dealt.join(stored(near, "candidates"), "fp"), "near-dealt")
    content = {
        "n": F.count("*"),
        "a": F.sum(F.xxhash64("fp").cast("decimal(20,0)")),
        "b": F.bit_xor(F.xxhash64(F.lit(SEED), "fp")),
    }
    held = dealt.groupBy("lane", "part").agg(*[column.alias(name) for name, column in content.items()]).where("n > 1")
    one = held.groupBy(*content).agg(F.min(F.struct("lane", "part")).alias("at")).select("at.lane", "at.part")
    return dealt.join(stored(one, "candidate-cells"), ["lane", "part"])


def long_links(own: DataFrame, docs: DataFrame, size: int, radius: int, limit: int = BLOCK) -> DataFrame:
    """Links of the other texts: candidates meet in their cells, with one text of each
    node. Nothing is closed to components before, so a long chain of copies is compared
    only along its cells."""
    first = own.where(F.size("keys") > 0).groupBy("fp").agg(F.min(F.struct("ord", "th")).alias("at"), F.max("n").alias("n"))
    placed = candidate_cells(own, radius).join(first, "fp").select("lane", "part", "fp", "at.ord", "at.th", "n")
    met = stored(cells(stored(placed, "placed"), limit, f"greatest(n, {LEAST})").select("cell", "fp", "ord", "th"), "met")
    texts = docs.select(*document_key(), whole_text().alias("content"))
    wanted = met.select("ord", "th").distinct().hint("shuffle_hash")
    texts = texts.join(wanted, ["ord", "th"], "left_semi").dropDuplicates(["ord", "th"])
    return checked_links(texts.join(met, ["ord", "th"]), size, radius)


def similar_documents(docs: DataFrame, size: int = WIDE_WORDS, radius: int = WIDE_RADIUS, limit: int = BLOCK) -> DataFrame:
    """(ord, th, best) for every document by its id and the hash of its text: the first
    (ord, th) of its group of similar texts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for ord_, th, text in rows:
            hashes = distinct_shingles(text, size)
            n = len(hashes)
            keys = [int(reordered(hashes, -2 - k).min().view(np.int64)) for k in range(LANES)] if n >= LONG else []
            short = 0 < n <= SHORT
            content = hashes.astype("<u8").tobytes() if short else None
            yield ord_, th, node(hashes), n, keys, prefix(hashes).view(np.int64).tolist() if short else [], content

    rows = docs.select(*document_key(), whole_text().alias("text"))
    schema = "ord long, th long, fp binary, n int, keys array<long>, prefix array<long>, content binary"
    own = stored(map_rows(rows, run, schema), "fingerprints")
    links = long_links(own, docs, size, radius, limit).unionByName(short_links(own, size, radius, limit))
    labels = labelled(own, links, F.min(F.struct("ord", "th")).alias("best"))
    return own.join(labels, "fp").select("ord", "th", "best")


def document_key() -> list:
    """The id, null last, and the hash of the text."""
    last = F.lit(9223372036854775807)
    return [F.coalesce(F.col("doc_id").cast("long"), last).alias("ord"), F.xxhash64(whole_text()).alias("th")]


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The first document of every group of similar ones, by doc_id (null last)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = similar_documents(docs).where("best = struct(ord, th)").select("ord", "th").distinct()
    keyed = docs.select(*document_key(), F.struct(*columns).alias("row"))
    first = keyed.join(stored(kept, "kept").hint("merge"), ["ord", "th"], "left_semi").dropDuplicates(["ord", "th"])
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
