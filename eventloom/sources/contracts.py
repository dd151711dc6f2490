"""Published event contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import has_text
from eventloom.schemas import CONTRACT


def parse_contracts(published: DataFrame) -> DataFrame:
    """(app_code, version, events) from (app_code, contract_json).

    Unknown JSON fields are ignored. A missing, blank or malformed contract and a
    blank app mean: no contract. Only the newest version of an app counts.
    """
    parsed = published.where(has_text("app_code") & has_text("contract_json")).withColumn(
        "_c", F.from_json("contract_json", CONTRACT, {"mode": "PERMISSIVE"})
    )
    # PERMISSIVE gives an all-null struct for malformed text
    usable = F.coalesce(F.col("_c.appId"), F.col("_c.version").cast("string")).isNotNull() | F.col(
        "_c.events"
    ).isNotNull()
    empty = F.from_json(F.lit("{}"), CONTRACT["events"].dataType)
    return (
        parsed.where(usable)
        .select(
            "app_code",
            F.coalesce(F.col("_c.version"), F.lit(0)).alias("version"),
            F.coalesce(F.col("_c.events"), empty).alias("events"),
            F.col("contract_json").alias("_text"),
        )
        .groupBy("app_code")
        # the text only breaks ties between equal versions
        .agg(F.max_by(F.struct("version", "events"), F.struct("version", "_text")).alias("_c"))
        .select("app_code", "_c.version", "_c.events")
    )


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts from JSON lines of (app_code, contract_json)."""
    return parse_contracts(spark.read.schema("app_code string, contract_json string").json(path))


def explode_contracts(contracts: DataFrame) -> DataFrame:
    """(app_code, version, event_type, fields)."""
    return contracts.select("app_code", "version", F.explode("events").alias("event_type", "_spec")).select(
        "app_code", "version", "event_type", "_spec.fields"
    )
