"""Ranked lexical search of many items at once, sharing what they have in common.

The score of a document for an item is a sum over the item's terms, so items that share
terms share parts of the sum. From the items of a block a sharing DAG is built:

* terms that occur in exactly the same items form one leaf;
* the pair of nodes that occurs together in the most items becomes a node of its own, the
  sum of the two, and replaces them there; again and again, until no pair is shared.

Every batch of documents gets one accumulator per leaf and document, then each shared node
is added up once, and an item is the sum of the few nodes it has left. Tasks keep the best
LIMIT documents per item; the final ranking joins those.

Documents are tokenised once per block into the counts of the block's terms; document
frequencies, the number of documents and of terms are sums over all of them. Blocks bound
what a task and the driver hold of the items: the squares of their term counts add up to
BLOCK at most, unless an item alone has more.

A null text has no terms, an item without terms no results. Items with equal ids are one
item, a null id included. Repeated documents count and rank each; equal scores are in
order of doc_id, null last. Texts of any length are counted whole. Empty tables give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, stored

LIMIT = 10
#: Squares of term counts of the items of a block.
BLOCK = 2**21
#: Accumulators that a task holds at once.
ACCUMULATORS = 2**22

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_TO = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def terms_of(text: str | None) -> list[bytes]:
    """Terms in UTF-8, in order, with repeats. Code points from 128 on are term
    characters, so bytes from 128 on are."""
    return text.encode().translate(_TO).split() if text else []


@dataclass(frozen=True)
class Plan:
    """Nodes 0..leaves-1 are leaves, then come sums of two earlier nodes each."""

    leaf_of: np.ndarray
    """The leaf of each term."""
    leaves: int
    sums: list[tuple[int, int]]
    items: list[np.ndarray]
    """The nodes that an item is the sum of."""

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.sums)


def sharing_plan(items: list[list[int]], terms: int) -> Plan:
    """items: the distinct term numbers of each item, below `terms`."""
    holders: dict[int, list[int]] = defaultdict(list)
    for i, held in enumerate(items):
        for t in held:
            holders[t].append(i)
    leaf_of = np.zeros(terms, np.int64)
    leaves: dict[tuple[int, ...], int] = {}
    for t in range(terms):
        leaf_of[t] = leaves.setdefault(tuple(holders[t]), len(leaves))
    of_item: list[set[int]] = [set() for _ in items]
    where: list[set[int]] = []
    for held_by, leaf in leaves.items():
        where.append(set(held_by))
        for i in held_by:
            of_item[i].add(leaf)

    def pair(a: int, b: int) -> tuple[int, int]:
        return (a, b) if a < b else (b, a)

    counts: Counter[tuple[int, int]] = Counter()
    for nodes in of_item:
        shared = sorted(n for n in nodes if len(where[n]) > 1)
        counts.update((a, b) for k, a in enumerate(shared) for b in shared[k + 1 :])
    waiting = [(-n, p) for p, n in counts.items() if n > 1]
    heapq.heapify(waiting)
    sums: list[tuple[int, int]] = []
    while waiting:
        n, (a, b) = heapq.heappop(waiting)
        if counts[a, b] != -n:
            # out of date; comes back with the count it has now
            if counts[a, b] > 1:
                heapq.heappush(waiting, (-counts[a, b], (a, b)))
            continue
        new = len(where)
        together = where[a] & where[b]
        sums.append((a, b))
        where.append(together)
        grown: Counter[int] = Counter()
        for i in together:
            of_item[i] -= {a, b}
            for other in of_item[i]:
                if len(where[other]) > 1:
                    counts[pair(a, other)] -= 1
                    counts[pair(b, other)] -= 1
                    grown[other] += 1
            of_item[i].add(new)
        where[a] = where[a] - together
        where[b] = where[b] - together
        counts[a, b] = 0
        for other, n in grown.items():
            counts[pair(new, other)] = n
            if n > 1:
                heapq.heappush(waiting, (-n, pair(new, other)))
    return Plan(leaf_of, len(leaves), sums, [np.array(sorted(nodes), np.int64) for nodes in of_item])


def combined(plan: Plan, terms: np.ndarray, rows: np.ndarray, parts: np.ndarray, n_rows: int) -> np.ndarray:
    """Scores (items x documents) from parts of scores per term and document."""
    sums = np.zeros((plan.nodes, n_rows), np.int64)
    np.add.at(sums.reshape(-1), plan.leaf_of[terms] * n_rows + rows, parts)
    for k, (a, b) in enumerate(plan.sums, plan.leaves):
        np.add(sums[a], sums[b], out=sums[k])
    return np.stack([sums[nodes].sum(axis=0) for nodes in plan.items])


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, each once, with the block of the item."""

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            for term in set(terms_of(text)):
                yield item, term

    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    pairs = stored(map_rows(named, split, "item_id long, term binary").distinct(), "item-terms")
    # similar items next to each other: those that share their smallest hash
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("term")).alias("like"))
    before = F.sum(F.col("n") * F.col("n")).over(W.orderBy("like", "item_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    blocks = sizes.select("item_id", F.floor((before - 1) / F.lit(BLOCK)).cast("int").alias("block"))
    blocks = blocks.withColumnRenamed("item_id", "_item")
    return stored(pairs.join(blocks, pairs["item_id"].eqNullSafe(blocks["_item"])).drop("_item"), "blocks")


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of every document its number of terms, and the numbers and
    counts of those in the vocabulary, as 32-bit and 64-bit integers."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in rows:
            words = terms_of(text)
            found = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
            terms, tfs = zip(*found, strict=True) if found else ((), ())
            yield doc, len(words), np.array(terms, np.int32).tobytes(), np.array(tfs, np.int64).tobytes()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return map_rows(named, count, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(counts: DataFrame, terms: int) -> DataFrame:
    """(term, df) of the terms that occur."""

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        df = np.zeros(terms, np.int64)
        for (held,) in rows:
            df[np.frombuffer(held, np.int32)] += 1
        for t in np.flatnonzero(df):
            yield int(t), int(df[t])

    return map_rows(counts.select("terms"), add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, limit: int):
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)
        self.limit = limit

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        in_order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
        scores = scores[:, in_order]
        enough = scores >= self.least[:, None]
        for i in np.flatnonzero(enough.any(axis=1)):
            rows = np.flatnonzero(enough[i])
            # a stable sort: equal scores stay in order of id
            rows = rows[np.argsort(-scores[i, rows], kind="stable")[: self.limit]]
            new = [(-int(scores[i, r]), ids[in_order[r]] is None, ids[in_order[r]] or 0) for r in rows]
            self.kept[i] = heapq.nsmallest(self.limit, self.kept[i] + new)
            if len(self.kept[i]) == self.limit:
                self.least[i] = -self.kept[i][-1][0]


def best_per_task(counts: DataFrame, plan: Plan, weights: np.ndarray, names: list[int | None], n_docs: int, n_terms: int, limit: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task."""
    batch = max(64, ACCUMULATORS // max(1, plan.nodes))

    def search(rows: Iterator[tuple]) -> Iterator[tuple]:
        best = _Best(len(names), limit)

        def score(held: list[tuple]) -> None:
            terms = np.concatenate([np.frombuffer(t, np.int32) for _, _, t, _ in held]).astype(np.int64)
            tfs = np.concatenate([np.frombuffer(f, np.int64) for _, _, _, f in held])
            at = np.repeat(np.arange(len(held)), [len(t) // 4 for _, _, t, _ in held])
            m = np.array([10 + 90 * n * n_docs // n_terms for _, n, _, _ in held], np.int64)
            parts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[at]))
            best.add(combined(plan, terms, at, parts, len(held)), [doc for doc, _, _, _ in held])

        held: list[tuple] = []
        for row in rows:
            if row[2]:
                held.append(row)
            if len(held) == batch:
                score(held)
                held = []
        if held:
            score(held)
        for name, kept in zip(names, best.kept, strict=True):
            for negative, missing, doc in kept:
                yield name, None if missing else doc, -negative

    return map_rows(counts.select("doc_id", "n", "terms", "tfs"), search, "item_id long, doc_id long, score long")


def search_items(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    spark = docs.sparkSession
    pairs = _item_terms(items)
    blocks = pairs.agg(F.max("block")).first()[0]
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(0 if blocks is None else blocks + 1):
        # bounded by BLOCK, or one item
        held: dict[int | None, list[bytes]] = defaultdict(list)
        for item, term in pairs.where(F.col("block") == block).select("item_id", "term").toLocalIterator():
            held[item].append(bytes(term))
        if not held:
            continue
        vocabulary = {t: k for k, t in enumerate(sorted({t for terms in held.values() for t in terms}))}
        counts = stored(counted(docs, vocabulary), "term-counts")
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in document_frequencies(counts, len(vocabulary)).collect():
            df[term] = n
        plan = sharing_plan([[vocabulary[t] for t in terms] for terms in held.values()], len(vocabulary))
        best = best_per_task(counts, plan, term_weights(df, n_docs), list(held), n_docs, n_terms, limit)
        found = found.unionByName(stored(best, "best"))
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
#: The same in SQL.
SEARCH_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS_SQL} AS terms FROM documents
), whole AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
), i AS (
  SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs
), parts AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms))) AS part
  FROM tf JOIN w USING (term) JOIN d USING (r), whole
), scores AS (
  SELECT item_id, r, sum(part)::BIGINT AS score FROM parts JOIN i USING (term) GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scores JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {LIMIT}
"""
