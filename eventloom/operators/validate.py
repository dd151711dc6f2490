"""Required fields, identify events and the ordered outcome of each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import contracts as C
from eventloom.functions.text import has_text
from eventloom.functions.times import epoch_ms_to_ts

IDENTIFY = "$identify"

VALIDATION_FAILED = "validation_failed"
IDENTIFIED = "identified"
IDENTIFY_REJECTED = "identify_rejected"
SCHEMA_VIOLATION = "schema_violation"
DUPLICATE = "duplicate"
ACCEPTED = "accepted"


def has_required_fields(event_id: Column, event_type: Column, ts: Column) -> Column:
    return has_text(event_id) & has_text(event_type) & ts.isNotNull()


def split_required(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete events, incomplete events) of raw nested events."""
    valid = has_required_fields(F.col("eventId"), F.col("eventType"), F.col("timestamp"))
    return raw.where(valid), raw.where(~valid)


def reject_record(raw: DataFrame, now: Column) -> DataFrame:
    """What is kept of an event that failed the required-field check."""
    return raw.select(
        F.col("eventId").alias("event_id"),
        F.col("eventType").alias("event_type"),
        F.col("userId").alias("user_id"),
        F.col("anonymousId").alias("anonymous_id"),
        F.col("session.sessionId").alias("session_id"),
        F.coalesce(epoch_ms_to_ts(F.col("timestamp")), now).alias("timestamp"),
        now.alias("received_at"),
    )


def split_identify(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary events, identify control events) of flat events."""
    control = F.coalesce(F.col("event_type") == IDENTIFY, F.lit(False))
    return events.where(~control), events.where(control)


def takes_dedup_slot() -> Column:
    """Rows that reach the duplicate check: complete, not identify, not quarantined."""
    return F.coalesce(
        F.col("valid")
        & (F.col("event_type") != IDENTIFY)
        & (F.col("contract_outcome") != C.VIOLATION_ENFORCE),
        F.lit(False),
    )


def classify_outcome(events: DataFrame) -> DataFrame:
    """Add ``outcome``: the first rule that applies decides.

    Expects ``valid``, event_type, both ids, ``contract_outcome`` and ``is_duplicate``;
    the last must come from rows that take a duplicate slot (``takes_dedup_slot``).
    """
    identify = F.col("event_type") == IDENTIFY
    both_ids = has_text("anonymous_id") & has_text("user_id")
    return events.withColumn(
        "outcome",
        F.when(~F.col("valid"), F.lit(VALIDATION_FAILED))
        .when(identify & both_ids, F.lit(IDENTIFIED))
        .when(identify, F.lit(IDENTIFY_REJECTED))
        .when(F.col("contract_outcome") == C.VIOLATION_ENFORCE, F.lit(SCHEMA_VIOLATION))
        .when(F.col("is_duplicate"), F.lit(DUPLICATE))
        .otherwise(F.lit(ACCEPTED)),
    )
