"""Hard-negative mining with full exact scores by the Four-Russians method.

Components become whole numbers, floor(256 * x). A candidate's numbers are written as bit
planes in two's complement; the bits of eight dimensions in one plane are one byte. For an
anchor and each group of eight dimensions a table of 256 entries holds the sums of all
subsets of its eight numbers. The byte of a plane looks its subset sum up, the sums of
all groups are added, and the planes are put together by shifting and adding, from the
sign plane down. That is the inner product, exactly.

Anchors (rows whose vec_id is divisible by EVERY) are a query set that meets all rows in
blocks: rows are dealt to blocks of about BLOCK rows, anchors to groups of about GROUP, and
a cell is one block with one group. A task holds one block of candidates and a few anchors at a time.
Two passes: the positives of an anchor are the best rows of its label, so the first pass
scores the candidates of that label; the second scores the others and keeps, per positive,
the best ones between NEAR percent of its score and the score. Each cell returns at most
the limit per anchor or positive; the final ranking joins those.

Rows with a null label or vector, or a null, infinite or undefined component, take no part.
Vectors of other lengths count as filled up with zeros, an empty one as zeros only. A null
vec_id is no anchor and comes last among equal scores. Repeated rows are rows of their
own: a copy of an anchor is another row, and gives the anchor's results again. Scores are
64-bit whole numbers; larger ones wrap around. Components beyond 2^31 count as 2^31.
Vectors of any length are scored whole. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Rows whose id is divisible by this are anchors.
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative has this many percent of its positive's score at least.
NEAR = 80
#: Candidates of a block, anchors of a group, and anchors that are scored at a time.
BLOCK, GROUP, AT_A_TIME = 16_384, 128, 16
LARGEST = 2**31


def usable(rows: DataFrame) -> DataFrame:
    """(place, vec_id, label, q): rows that take part, with a number of their own."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * 256.0), F.lit(LARGEST)), F.lit(-LARGEST)))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return kept.select(
        F.monotonically_increasing_id().alias("place"),
        F.col("vec_id").cast("long").alias("vec_id"),
        moved.alias("label"),
        whole.cast("array<long>").alias("q"),
    )


def planes_of(numbers: np.ndarray) -> np.ndarray:
    """Bit planes (planes x groups of eight x rows) of rows x dimensions, sign plane first;
    the bit of a group's first dimension is the highest."""
    bits = max(int(numbers.max(initial=0)).bit_length(), int(-numbers.min(initial=0)).bit_length()) + 1
    rows, dims = numbers.shape
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = numbers
    planes = [np.packbits((padded >> p & 1).astype(np.uint8), axis=1).T for p in range(bits - 1, -1, -1)]
    return np.ascontiguousarray(np.stack(planes))


#: The bits of each byte, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def subset_sums(numbers: np.ndarray, groups: int) -> np.ndarray:
    """Tables (groups x anchors x 256) of anchors x dimensions."""
    padded = np.zeros((len(numbers), groups * 8), np.int64)
    width = min(groups * 8, numbers.shape[1])
    padded[:, :width] = numbers[:, :width]
    return np.einsum("agk,bk->gab", padded.reshape(len(numbers), groups, 8), _BITS)


def scores_of(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (anchors x candidates)."""
    total = np.zeros((tables.shape[1], planes.shape[2]), np.int64)
    for k, plane in enumerate(planes):
        looked_up = np.zeros_like(total)
        for table, byte in zip(tables, plane, strict=True):
            looked_up += np.take(table, byte, axis=1)
        # the sign plane counts negative
        total = -looked_up if k == 0 else (total << 1) + looked_up
    return total


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


class Candidates:
    """A block of candidates, ordered by label."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[2])
        self.place = np.array([r[0] for r in rows], np.int64)
        self.ids = [r[1] for r in rows]
        self.labels = np.array([r[2] for r in rows], np.int64)
        # ids in order, a missing one after all others
        order = sorted(range(len(rows)), key=lambda r: (self.ids[r] is None, self.ids[r] or 0))
        self.order = np.empty(len(rows), np.int64)
        self.order[order] = np.arange(len(rows))
        self.planes = planes_of(_matrix([r[3] for r in rows]))

    def best(self, scores: np.ndarray, allowed: np.ndarray, limit: int, since: int = 0) -> Iterator[tuple[int, int]]:
        """(candidate, score) of the best allowed ones; scores are those from candidate `since` on."""
        at = np.flatnonzero(allowed)
        if len(at) > limit:
            least = np.partition(scores[at], len(at) - limit)[len(at) - limit]
            at = at[scores[at] >= least]
        at = at[np.lexsort((self.order[since + at], -scores[at]))[:limit]]
        for k in at:
            yield since + int(k), int(scores[k])


_ROW = "place long, vec_id long, label long, q array<long>"


def _cells(rows: DataFrame, anchors: DataFrame, work: Callable[[Candidates, list[tuple]], Iterator[tuple]], schema: str, block: int, group: int) -> DataFrame:
    """`work` on every cell: its candidates, and a few of its anchors at a time. anchors:
    place, vec_id, label, q, band (anything a pass needs to know about an anchor)."""
    n_rows, n_anchors = rows.count(), anchors.count()
    blocks, groups = max(1, -(-n_rows // block)), max(1, -(-n_anchors // group))

    def dealt(df: DataFrame, into: int) -> Column:
        return F.pmod(F.xxhash64("place"), F.lit(into)).cast("int")

    def every(into: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(into - 1)))

    no_band = F.lit(None).cast("array<long>")
    left = rows.select("*", no_band.alias("band"), dealt(rows, blocks).alias("block"), F.lit(0).alias("kind")).withColumn("group", every(groups))
    right = anchors.select("place", "vec_id", "label", "q", "band", dealt(anchors, groups).alias("group"), F.lit(1).alias("kind"))
    right = right.withColumn("block", every(blocks))
    both = left.unionByName(right).repartition(min(blocks * groups, 10_000), "block", "group")
    ordered = both.sortWithinPartitions("block", "group", "kind", "label", "place")

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        cell, held, candidates, waiting = None, [], None, []
        for *row, kind, b, g in stream:
            if (b, g) != cell:
                if waiting:
                    yield from work(candidates, waiting)
                cell, held, candidates, waiting = (b, g), [], None, []
            if kind == 0:
                held.append(tuple(row[:4]))
                continue
            if candidates is None:
                if not held:
                    continue
                candidates, held = Candidates(held), []
            if len(waiting) == AT_A_TIME or waiting and waiting[0][2] != row[2]:
                yield from work(candidates, waiting)
                waiting = []
            waiting.append(tuple(row))
        if waiting:
            yield from work(candidates, waiting)

    return map_rows(ordered.select("place", "vec_id", "label", "q", "band", "kind", "block", "group"), run, schema)


def positives_of(rows: DataFrame, anchors: DataFrame, limit: int = POSITIVES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(place, rank, positive_id, positive_score): the best other rows of an anchor's label."""

    def work(candidates: Candidates, waiting: list[tuple]) -> Iterator[tuple]:
        # the anchors of a call share a label
        since, until = np.searchsorted(candidates.labels, [waiting[0][2], waiting[0][2] + 1])
        if since == until:
            return
        tables = subset_sums(_matrix([a[3] for a in waiting]), candidates.planes.shape[1])
        scores = scores_of(tables, candidates.planes[:, :, since:until])
        for anchor, own in zip(waiting, scores, strict=True):
            other = candidates.place[since:until] != anchor[0]
            for k, score in candidates.best(own, other, limit, int(since)):
                yield anchor[0], candidates.ids[k], score, int(candidates.place[k])

    none = anchors.withColumn("band", F.lit(None).cast("array<long>"))
    found = _cells(rows, none, work, "place long, positive_id long, positive_score long, positive_place long", block, group)
    return _first(stored(found, "positives"), ("place",), "positive_score", ("positive_id", "positive_place"), limit)


def _first(rows: DataFrame, of: tuple[str, ...], score: str, ties: tuple[str, ...], limit: int) -> DataFrame:
    order = W.partitionBy(*of).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def mine_negatives(
    rows: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    near: int = NEAR,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    own = stored(usable(rows), "vectors")
    anchors = stored(own.where(F.col("vec_id") % every == 0), "anchors")
    best = positives_of(own, anchors, positives, block, group)
    best = stored(best.withColumnRenamed("rank", "nth"), "positives")
    # distinct scores: positives that score alike share their negatives
    bands = best.groupBy("place").agg(F.collect_set("positive_score").alias("band"))

    def work(candidates: Candidates, waiting: list[tuple]) -> Iterator[tuple]:
        tables = subset_sums(_matrix([a[3] for a in waiting]), candidates.planes.shape[1])
        for anchor, own in zip(waiting, scores_of(tables, candidates.planes), strict=True):
            other = candidates.labels != anchor[2]
            for most in anchor[4]:
                hard = other & (100 * own <= 100 * most) & (near * most <= 100 * own)
                for k, score in candidates.best(own, hard, negatives):
                    yield anchor[0], most, candidates.ids[k], score, int(candidates.place[k])

    schema = "place long, positive_score long, negative_id long, negative_score long, negative_place long"
    found = stored(_cells(own, anchors.join(bands, "place"), work, schema, block, group), "negatives")
    found = _first(found, ("place", "positive_score"), "negative_score", ("negative_id", "negative_place"), negatives)
    named = best.join(anchors.select("place", F.col("vec_id").alias("anchor_id")), "place")
    out = named.join(found, ["place", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in SQL.
NEGATIVES_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.place, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.place <> b.place
), positives AS (
  SELECT place, anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.place, positive_id ORDER BY n.score DESC, vec_id)::INT AS rank
FROM positives p JOIN pairs n ON n.place = p.place AND NOT same
  AND {NEAR} * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""
