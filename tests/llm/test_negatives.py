from __future__ import annotations

import math
import random

import numpy as np
import pytest
from compare import connect, difference
from texts import SF

from eventloom.llm.negatives import NEGATIVES_SQL, mine_negatives, planes_of, scores_of, subset_sums

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, place string, block int"


def plain(rows):
    """By the words of the rule."""
    held = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, label, [max(-(2**31), min(2**31, math.floor(256 * v))) for v in x]))
    out = []
    for i, (anchor, label, q) in enumerate(held):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), v is None, v or 0, l == label) for k, (v, l, p) in enumerate(held) if k != i]
        scored.sort()
        for ps, none, pos, _ in [s for s in scored if s[3]][:5]:
            hard = [s for s in scored if not s[3] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(anchor, None if none else pos, k, None if n else v, -ps, -s) for k, (s, n, v, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("dims", [1, 7, 8, 9, 64])
def test_scores(dims):
    rng = np.random.default_rng(dims)
    anchors, rows = rng.integers(-300, 300, (5, dims)), rng.integers(-(2**dims % 1000) - 1, 500, (40, dims))
    planes = planes_of(rows)
    assert (scores_of(subset_sums(anchors, planes.shape[1]), planes) == anchors @ rows.T).all()


def test_sql(spark):
    got = mine_negatives(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert difference(got.toPandas(), connect(SF).execute(NEGATIVES_SQL).df()) is None


@pytest.mark.parametrize("block,group", [(16_384, 128), (40, 1)])
def test_odd_rows(spark, block, group):
    """Nulls, ties, repeated rows, zero, short and long vectors, huge components."""
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)], rng.randrange(3)) for k in range(0, 500, 4)]
    rows += [(k, [0.5, 0.5], 1) for k in range(1, 40)] + [(700, [0.5, 0.5], 1)] * 3 + [(800, [0.5, 0.25], 2)] * 2
    rows += [(None, [0.5, 0.5], 2), (None, [0.5, 0.5], 1), (901, None, 1), (902, [0.5, None], 1), (903, [math.nan], 1)]
    rows += [(904, [math.inf, 1.0], 1), (905, [0.1], None), (600, [], 1), (1000, [0.0] * 5, 0), (907, [0.1] * 40, 2), (908, [1e300, -1e300], 3), (1100, [1.0], 3)]
    assert rows_of(mine_negatives(frame(spark, rows), block=block, group=group)) == plain(rows)


def test_few_rows(spark):
    assert mine_negatives(frame(spark, [])).count() == 0
    assert mine_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert mine_negatives(frame(spark, [(100, [1.0], 1)])).count() == 0
    assert rows_of(mine_negatives(frame(spark, [(100, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)]))) == [(100, 2, 1, 3, 65536, 58880)]
