"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """For links (u, v) of nodes of any one type: (node, root) for every node that has a link to
    another, root being the smallest node of its component (and not a row itself).

    Alternates two steps until nothing changes: every node tells its larger neighbours,
    then its smaller ones, the smallest node it knows. The table shrinks towards one
    link per node. Smallest nodes are written down before they are joined, so a node
    with very many links is an ordinary skewed join.
    """
    links = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        links = stored(links, "links")
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        told = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(told.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = _state(links)
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
