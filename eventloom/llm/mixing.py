"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / w, where u is a uniform number from a
hash of its id and text and w its quality weight. Within a source the documents with the
smallest keys come first, which is weighted sampling without replacement. A source's
target, in words, is met by whole epochs first (every document once per epoch); the words
that are left go to the documents in key order until their running sum reaches the budget.
The document at which it is reached gives its first words only, so a source meets its
target to the word.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and divide SHARE of
all words; no target is over MOST times its source, what is over goes to the others by
weight, again and again until none is over.

The running sum never orders a source in one task. Keys are cut into ranges, these into
SLICES in all; sums of ranges, then of the slices of one range are one narrow row each;
only the slice in which the budget is reached is looked at closer, first by key, then,
where copies of one row share a key, by the place of the rows. Each step leaves one row per source: the point at which its budget is reached. All other
documents are decided by comparing them with that point.

Null texts and texts without words have size 0 and take nothing. A null source is a source
of its own. Null ids are ids like others; repeated rows count each, and of copies at the
budget the first ones stored are taken. Where `labels` has several rows for an id, the best
quality counts. An empty table gives an empty one. Very long texts are cut at the budget
like others. Columns of docs that are named like a result column are replaced. Runs on
built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Weights of the sources, in turn.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words, and of a source, as a share of its own.
SHARE, MOST = 1.5, 2.0
#: Quality weights: labelled good, labelled bad, not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0
SEED = 11
#: Slices of keys that are summed before anything is ordered, and of each range.
SLICES, OF_RANGE = 65_536, 256
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return best.agg(F.when(F.max("quality") >= 1, F.lit(GOOD)).otherwise(F.lit(BAD)).alias("weight"))


def drawn(docs: DataFrame, labels: DataFrame | None, seed: int, keep: Sequence[str]) -> DataFrame:
    """The kept columns, and per row its source, size, key, slice and place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    rows = docs.select(
        F.struct(*keep).alias("_kept"),
        F.col("doc_id").cast("long").alias("_id"),
        F.col("source").cast("string").alias("_source"),
        words_in(F.col("text")).alias("_size"),
        F.md5(named.cast("binary")).alias("_draw"),
    )
    weight = F.lit(UNKNOWN)
    if labels is not None:
        known = quality_weights(labels).withColumnsRenamed({"doc_id": "_id", "weight": "_weight"})
        rows = rows.join(known, "_id", "left")
        weight = F.coalesce("_weight", F.lit(UNKNOWN))
    uniform = (F.conv(F.substring("_draw", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    key = -F.ln(uniform) / weight
    return rows.select(
        "_kept",
        "_source",
        # a key without nulls
        F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")).alias("_of"),
        "_size",
        F.floor((1 - F.exp(-key)) * SLICES).cast("int").alias("_slice"),
        F.struct(key.alias("key"), F.col("_draw").alias("draw")).alias("_fine"),
        F.monotonically_increasing_id().alias("_place"),
    ).withColumns({"_range": F.floor(F.col("_slice") / OF_RANGE).cast("int"), "_part": F.shiftright("_place", 33)})


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_of, source_size, target, epochs, need): one row per source."""
    sizes = stored(rows.groupBy("_of", "_source").agg(F.sum("_size").alias("source_size")), "source-sizes")
    # the rank of a source among all: its place in its sorted range, and the rows of the ranges before
    ranged = stored(sizes.orderBy(F.col("_source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(2**33 - 1)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = stored(ranged.join(offsets, "_range").select("_of", "source_size", turn.alias("weight")), "weights")
    # sources that stop at their limit leave the rest to the others: sums of three columns per round
    limit = F.col("source_size") * F.lit(most)
    words, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    left, among, stopped = share * (words or 0), weight or 1, 0
    while True:
        over = weighed.where(limit * F.lit(float(among)) < F.lit(left) * F.col("weight"))
        n, held, weight_held = over.agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if n == stopped:
            break
        left, among, stopped = share * words - held, weight - weight_held, n
    fair = F.lit(left) * F.col("weight") / F.lit(float(among))
    out = weighed.withColumn("target", F.when(limit * F.lit(float(among)) < F.lit(left) * F.col("weight"), limit).otherwise(fair))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.select("_of", "source_size", "target", epochs.alias("epochs"))
    return out.withColumn("need", F.floor("target") - F.col("epochs") * F.col("source_size"))


def _reached(rows: DataFrame, left: DataFrame, step: str) -> DataFrame:
    """The value of `step` at which a source's running sum passes what it needs, and what
    is needed within it: (_of, step, need), at most one row per source."""
    sums = rows.groupBy("_of", step).agg(F.sum("_size").alias("_words"))
    upto = F.sum("_words").over(W.partitionBy("_of").orderBy(step).rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = sums.withColumn("_upto", upto).join(left, "_of")
    found = summed.where("_upto > need and _upto - _words <= need")
    return found.select("_of", step, (F.col("need") - F.col("_upto") + F.col("_words")).alias("need"))


STEPS = ("_range", "_slice", "_fine", "_part", "_place")


def budget_points(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(_of, point, rest): the row at which each source's budget is reached, as a struct of
    STEPS, and the words it still gives."""
    rows = rows.select("_of", "_size", *STEPS)
    left = left.select("_of", "need")
    found: list[DataFrame] = []
    for step in STEPS:
        if found:
            last = STEPS[len(found) - 1]
            rows = rows.join(found[-1].select("_of", last), ["_of", last], "left_semi")
        found.append(stored(_reached(rows, left, step), "reached"))
        left = found[-1].select("_of", "need")
    points = found[0].drop("need")
    for part in found[1:-1]:
        points = points.join(part.drop("need"), "_of")
    points = points.join(found[-1].withColumnRenamed("need", "rest"), "_of")
    return points.select("_of", F.struct(*STEPS).alias("point"), "rest")


def mix_sources(
    docs: DataFrame,
    labels: DataFrame | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of docs (all columns, or those in `keep`) with size, source_size, target
    and taken: a document goes into the mix taken // size times as a whole, and then with
    its first taken % size words."""
    keep = list(docs.columns if keep is None else keep)
    rows = stored(drawn(docs, labels, seed, keep), "drawn")
    aims = stored(targets(rows, weights, share, most), "targets")
    points = stored(budget_points(rows, aims), "points")
    here = F.struct(*STEPS)
    part = F.when(here < F.col("point"), F.col("_size")).when(here == F.col("point"), F.col("rest")).otherwise(0)
    mixed = rows.join(aims, "_of").join(points, "_of", "left")
    results = {
        "size": F.col("_size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "taken": F.col("epochs") * F.col("_size") + F.coalesce(part, F.lit(0)),
    }
    kept = [F.col(f"_kept.{name}").alias(name) for name in keep if name not in results]
    return mixed.select(*kept, *[column.alias(name) for name, column in results.items()])


#: The same in SQL.
MIX_SQL = f"""
WITH best AS (
  SELECT doc_id, CASE WHEN max(quality) >= 1 THEN {GOOD}::DOUBLE ELSE {BAD}::DOUBLE END AS weight
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5(concat('{SEED}:', coalesce(d.doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS draw, coalesce(weight, {UNKNOWN}::DOUBLE) AS weight
  FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id
), keyed AS (
  SELECT *, -ln((('0x' || substr(draw, 1, 13))::BIGINT + 0.5::DOUBLE) / {float(2**52)}::DOUBLE) / weight AS key FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([{", ".join(map(str, WEIGHTS))}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w
  FROM docs GROUP BY source
), whole AS (
  SELECT {SHARE}::DOUBLE * sum(source_size) AS mix, sum(w) AS among FROM sources
), ordered AS (
  SELECT source, source_size, w,
    mix - {MOST}::DOUBLE * coalesce(sum(source_size) OVER before, 0) AS rest, among - coalesce(sum(w) OVER before, 0) AS others
  FROM sources, whole
  WINDOW before AS (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fair AS (
  SELECT rest, others FROM ordered WHERE rest * w <= {MOST} * source_size * others ORDER BY others DESC LIMIT 1
), aims AS (
  SELECT source, source_size,
    CASE WHEN {MOST}::DOUBLE * source_size * others < rest * w THEN {MOST}::DOUBLE * source_size ELSE rest * w / others END AS target
  FROM sources, fair
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aims
), placed AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS need,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, draw ROWS UNBOUNDED PRECEDING) - size AS before
  FROM keyed k JOIN needs n ON k.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, need - before)))::BIGINT AS taken
FROM placed
"""
