"""Event contracts: attach the contract of each event's app and check the event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.contracts import contract_outcome, contract_violations
from eventloom.functions.variants import custom_map
from eventloom.operators.skew import lookup_join


def join_contract(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Add ``contract``: map<event type, fields> of the event's app, null without one."""
    published = contracts.select("app_code", F.col("events").alias("contract"))
    return lookup_join(events, published, ["app_code"])


def check_contracts(
    events: DataFrame, contracts: DataFrame, cfg: EngineConfig, custom: str = "custom"
) -> DataFrame:
    """Add ``violations`` and ``contract_outcome``; ``custom`` is JSON object text."""
    if cfg.contract_mode == "off":
        return events.withColumn("violations", F.array().cast("array<string>")).withColumn(
            "contract_outcome", contract_outcome("off", F.col("violations"))
        )
    has_fields = F.size(F.col("contract")[F.col("event_type")]["fields"]) > 0
    return (
        join_contract(events, contracts)
        # A column of its own: inside the check it would be parsed again for every field.
        # Events whose contract names no field are not parsed.
        .withColumn("_properties", F.when(has_fields, custom_map(F.col(custom))))
        .withColumn(
            "violations", contract_violations(F.col("event_type"), F.col("_properties"), F.col("contract"))
        )
        .withColumn("contract_outcome", contract_outcome(cfg.contract_mode, F.col("violations")))
        .drop("contract", "_properties")
    )
