"""Quality scores by pairwise ranking (Bradley-Terry).

A document's strength is a weighted sum of features of its text. In a pair of a document
labelled 1 and one labelled 0 the first is preferred with a probability that is the
logistic function of the difference of their strengths; weights minimize the logistic
loss over pairs. The score puts the quantile of strengths that leaves as many
labelled documents below it as have label 0 at THRESHOLD; documents from there on pass.

Weights are fitted to every labelled document. Documents of the rarer label are dealt to
buckets by hash, those of the other to cells of a bucket; a cell holds all documents of
the bucket's rarer label, about RARE, and about COMMON others, and all its pairs count. So
every document is in pairs, their number grows like the table, and up to RARE documents of
one label meet all of the other. A Newton step is a sum over cells; sums, of whole numbers, do
not depend on how rows are dealt. The driver gets sums and one quantile. Features are of whole
texts. A null text counts as empty; empty texts are scored like any. Documents labelled
twice count as 1 only if all labels are; of several texts under one id the one of smallest
features teaches. Without labels of both kinds all strengths are
0. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, stored, whole_text

THRESHOLD = 0.3
#: Documents of either label in a cell; strengths that are put in order on the driver.
RARE, COMMON, ORDERED = 256, 1_024, 4_096
#: Sums are of multiples of this.
UNIT = 2.0**-36

MARKS = b"!#$%&*.,:;|?"


def features(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw) + 1
    words = text.split()
    m = len(words) + 1
    counts = Counter(words)
    low = sum(len(w) for w in counts)
    most = max(counts.values(), default=0)
    lines = text.split("\n")
    distinct_lines = set(lines)
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    ends = sum(raw.count(c) for c in (b".\n", b". ")) + raw.endswith(b".")
    longest = max(map(len, counts), default=0)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = sum(raw.count(b"%d" % k) for k in range(10))
    base = [
        *(raw.count(bytes([c])) / m for c in MARKS),
        upper / m,
        title / m,
        digits / n,
        len(counts) / m,
        low / n,
        most / m,
        repeats / m,
        len(text) / m / 10,
        ends / m,
        len(distinct_lines) / len(lines),
        len(lines) / m,
        longest / 50,
        raw.count(b"  ") / m,
        sum(map(str.isalpha, words)) / m,
    ]
    return [*base, *np.sqrt(np.minimum(base, 4.0)), np.log1p(m) / 10, 1.0 / m, float(m < 20)]


class Ranking:
    def __init__(self, good: np.ndarray, bad: np.ndarray, share_bad: float) -> None:
        """good, bad: features of the labelled documents; share_bad: of all labelled. For
        documents that are here; ``learn`` does the same over a table."""
        self.mean, self.scale, self.weights, self.cut, self.slope = 0.0, 1.0, None, 0.0, 1.0
        if not len(good) or not len(bad):
            return
        both = np.concatenate([good, bad])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        pairs = len(good) * len(bad)
        good_, bad_ = self.standard(good), self.standard(bad)
        self.weights = newton(lambda w: [x / pairs for x in pair_sums(good_, bad_, w)], good.shape[1])
        strengths = np.concatenate([good_ @ self.weights, bad_ @ self.weights])
        # as many of them count as they stand for
        stands = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
        order = np.argsort(strengths)
        below = np.searchsorted(np.cumsum(stands[order]), share_bad)
        self.cut = float(strengths[order][min(below, len(order) - 1)])
        self.slope = float(1 / (strengths.std() + 1e-9))

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) / self.scale

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        strength = self.standard(rows) @ self.weights
        at_cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at_cut + 2 * self.slope * (strength - self.cut), -30, 30)))

    def score_text(self, text: str | None) -> float:
        return self.score_packed(packed(text or ""))

    def score_packed(self, x: bytes) -> float:
        return float(self.score(unpacked([x]))[0])


def packed(text: str) -> bytes:
    return np.array(features(text), dtype="<f4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f4") for x in rows], dtype=float)


def newton(sums: Callable[[np.ndarray], list[np.ndarray]], k: int, rounds: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton steps; sums: gradient and curvature of the mean loss at weights."""
    w = np.zeros(k)
    for _ in range(rounds):
        gradient, curvature = sums(w)
        step = np.linalg.solve(curvature + ridge * np.eye(k), gradient + ridge * w)
        w -= step * min(1.0, 3.0 / (np.linalg.norm(step) + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def bradley_terry(differences: np.ndarray) -> np.ndarray:
    """Weights by the logistic loss of the differences, preferred first."""

    def sums(w: np.ndarray) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(differences @ w, -30, 30)))
        return [differences.T @ (p - 1) / len(p), (differences * (p * (1 - p))[:, None]).T @ differences / len(p)]

    return newton(sums, differences.shape[1])


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Gradient and curvature of the logistic loss of all pairs."""
    p = 1 / (1 + np.exp(-np.clip((good @ w)[:, None] - bad @ w, -30, 30)))
    v = p * (1 - p)
    cross = good.T @ v @ bad
    gradient = bad.T @ (1 - p).sum(axis=0) - good.T @ (1 - p).sum(axis=1)
    return [gradient, (good.T * v.sum(axis=1)) @ good + (bad.T * v.sum(axis=0)) @ bad - cross - cross.T]


def total(rows: DataFrame, fn: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of the vectors that fn makes of each row, the same however rows are dealt."""

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        sums = 0
        for row in part:
            sums = sums + np.rint(fn(*row) / UNIT).astype(np.int64)
        if not isinstance(sums, int):
            yield from enumerate(sums.tolist())

    found = map_rows(rows, run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r.n for r in found]) * UNIT


def described(docs: DataFrame) -> DataFrame:
    """doc_id and features, written."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, packed(text)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return stored(map_rows(texts, run, "doc_id long, x binary"), "features")


def in_cells(taught: DataFrame, n: dict[bool, int], rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(good, bad): features of the documents of each cell, in order of their ids."""
    less = n[True] <= n[False]
    buckets = -(-n[less] // rare)
    cells = -(-n[not less] // (buckets * common))
    own = F.when(F.col("good") == less, F.sequence(F.lit(0), F.lit(cells - 1)))
    own = own.otherwise(F.array(F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.lit(cells)).cast("int")))
    dealt = taught.select("doc_id", "good", "x", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.explode(own).alias("cell"))
    member = F.struct("doc_id", "x")
    lists = [F.sort_array(F.collect_list(F.when(flag, member))).getField("x").alias(name) for name, flag in (("good", F.col("good")), ("bad", ~F.col("good")))]
    return dealt.groupBy("bucket", "cell").agg(*lists).select("good", "bad").where("size(good) > 0 and size(bad) > 0")


def quantile(strengths: DataFrame, stands: dict[bool, float], share: float, ordered: int = ORDERED) -> float:
    """The first strength up to which rows (good, s) stand for the share, exactly: ranges
    are narrowed until one is small enough to be put in order."""
    below, share = 0.0, share * (1 - 1e-12)
    edge = strengths.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).first()
    low, high, n = edge
    while low < high and n > ordered:
        at = F.floor((F.col("s") - low) / F.lit(high - low) * 1024).alias("bin")
        counts = [F.count_if(F.col("good") == flag) for flag in (True, False)]
        bins = strengths.where(F.col("s").between(low, high)).groupBy(at).agg(F.min("s"), F.max("s"), *counts).orderBy("bin").collect()
        for _, low, high, good, bad in bins:
            n, weight = good + bad, good * stands[True] + bad * stands[False]
            if below + weight >= share:
                break
            below += weight
    if low == high:
        return low
    for s, good in sorted((r.s, r.good) for r in strengths.where(F.col("s").between(low, high)).collect()):
        below += stands[good]
        if below >= share:
            return s
    return high


def learn(docs: DataFrame, labels: DataFrame, rare: int = RARE, common: int = COMMON, features: DataFrame | None = None) -> Ranking:
    """docs: doc_id, text; labels: doc_id, quality. Only ids whose crc32 modulo 5 is not
    0 teach. ``features``: those of the documents, if they are known."""
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    known = known.where(crc_mod("doc_id", 5) != 0)
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    model = Ranking(np.empty((0, 0)), np.empty((0, 0)), 0.0)
    if len(counts) < 2:
        return model
    x = described(docs.where(crc_mod("doc_id", 5) != 0)) if features is None else features
    # of several texts under one id the same one in every run
    taught = stored(x.join(known, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x")), "taught")
    n = {r.good: r["count"] for r in taught.groupBy("good").count().collect()}
    if len(n) < 2:
        return model
    rows = n[True] + n[False]

    model.mean = mean = total(taught.select("x"), lambda x: unpacked([x])[0] / rows)
    model.scale = np.sqrt(total(taught.select("x"), lambda x: (unpacked([x])[0] - mean) ** 2 / rows)) + 1e-6
    cells = stored(in_cells(taught, n, rare, common), "cells")
    pairs = cells.agg(F.sum(F.size("good").cast("long") * F.size("bad"))).first()[0]
    k = len(mean)

    def sums(w: np.ndarray) -> list[np.ndarray]:
        def of_cell(good: list[bytes], bad: list[bytes]) -> np.ndarray:
            return np.concatenate([x.ravel() / pairs for x in pair_sums(model.standard(unpacked(good)), model.standard(unpacked(bad)), w)])

        found = total(cells, of_cell)
        return [found[:k], found[k:].reshape(k, k)]

    weights = newton(sums, k)

    def strong(part: Iterator[tuple]) -> Iterator[tuple]:
        for good, x in part:
            yield good, float((model.standard(unpacked([x])) @ weights)[0])

    strengths = stored(map_rows(taught.select("good", "x"), strong, "good boolean, s double"), "strengths")
    middle, squares = total(strengths.select("s"), lambda s: np.array([s, s * s]) / rows)
    share_bad = counts[False] / (counts[True] + counts[False])
    model.weights, model.slope = weights, float(1 / (np.sqrt(max(squares - middle * middle, 0.0)) + 1e-9))
    model.cut = quantile(strengths, {True: (1 - share_bad) / n[True], False: share_bad / n[False]}, share_bad)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = described(docs)
    model = learn(docs, labels, features=x)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, held_out, x in rows:
            score = model.score_packed(x)
            yield doc_id, held_out, score, int(score >= THRESHOLD)

    rows = x.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "x")
    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    model = learn(docs, labels)
    at = docs.columns.index("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            if model.score_text(row[at]) >= THRESHOLD:
                yield row

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)
    return map_rows(docs, run, schema)
