"""From raw events to the events table, identity links and dead letters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.operators import validate as V
from eventloom.operators.contracts import check_contracts
from eventloom.operators.dead_letters import dead_letters
from eventloom.operators.dedup import accepted_ids, mark_duplicates
from eventloom.operators.enrich import flatten_enrich, sink_defaults
from eventloom.operators.identity import latest_link, link_rows, resolve_identity
from eventloom.operators.privacy import apply_privacy
from eventloom.operators.quality import ingest_summary, pipeline_metrics
from eventloom.operators.sessions import attach_sessions, open_sessions, visits
from eventloom.schemas import EVENT_COLUMNS
from eventloom.workspace import write_through

#: What a dead letter keeps of an event, as it was sent: enough to process it like new.
PAYLOAD = (*(name for name in EVENT_COLUMNS if name not in ("properties", "received_at")), "properties", "consent")


@dataclass(frozen=True)
class Earlier:
    """What earlier batches left behind; each may be missing."""

    seen: DataFrame | None = None
    """(event_id, anchor_ts) of ids accepted not long ago."""
    links: DataFrame | None = None
    """(anonymous_id, user_id, linked_at), live ones."""
    sessions: DataFrame | None = None
    """OPEN_SESSIONS."""


@dataclass(frozen=True)
class Ingested:
    """What one batch gives. The results are put together when they are asked for, so
    a job pays only for those it writes."""

    classified: DataFrame
    """Every input event, flat, with its outcome and flags."""
    cfg: EngineConfig
    now: Column
    earlier: Earlier = Earlier()

    @cached_property
    def _going(self) -> DataFrame:
        return self.classified.where(F.col("outcome").isin(V.ACCEPTED, V.IDENTIFIED))

    def _identified(self, events: DataFrame) -> DataFrame:
        return resolve_identity(
            events, self.cfg, allowed=~F.col("consent_denied"), stored=self.earlier.links
        )

    @cached_property
    def _visits(self) -> DataFrame:
        """Numbered spans; two results need them."""
        accepted = self.classified.where(F.col("outcome") == V.ACCEPTED)
        spans = visits(accepted, self.cfg, stored=self.earlier.sessions)
        return spans if self.earlier.sessions is None else write_through(spans, "visits")

    @cached_property
    def events(self) -> DataFrame:
        """Accepted events, flat, with their user and their final session id."""
        accepted = self._identified(self._going).where(F.col("outcome") == V.ACCEPTED)
        return attach_sessions(accepted, self.cfg, spans=self._visits).withColumn("properties", F.col("custom"))

    @cached_property
    def links(self) -> DataFrame:
        """(anonymous_id, user_id, linked_at): the latest link of each visitor."""
        return latest_link(link_rows(self._going, allowed=~F.col("consent_denied")))

    @cached_property
    def sessions(self) -> DataFrame:
        """OPEN_SESSIONS rows of the sessions that this batch has events of."""
        return open_sessions(self._visits, self.now)

    @cached_property
    def seen(self) -> DataFrame:
        """(event_id, anchor_ts, arrived_at) of the accepted events."""
        accepted = self.classified.where(F.col("outcome") == V.ACCEPTED)
        return accepted_ids(accepted).withColumn("arrived_at", self.now)

    @cached_property
    def dead(self) -> DataFrame:
        """New dead-letter entries, with the event as it was sent."""
        refused = self.classified.where(F.col("outcome").isin(V.VALIDATION_FAILED, V.SCHEMA_VIOLATION))
        return dead_letters(as_sent(refused), F.col("outcome"), self.now, PAYLOAD)

    def summary(self) -> DataFrame:
        return ingest_summary(self.classified)

    def metrics(self) -> DataFrame:
        flags = ["outcome", "violations", "pii_masked", "consent_denied", "identity_linked", "identity_resolved"]
        missing = {"identity_linked": F.lit(False), "identity_resolved": F.lit(False)}
        others = self.classified.where(~F.col("outcome").isin(V.ACCEPTED, V.IDENTIFIED)).withColumns(missing)
        narrow = [*flags[:-2], "anonymous_id", "user_id", "timestamp", "seq"]
        going = self._identified(self._going.select(*narrow))
        return pipeline_metrics(going.select(flags).unionByName(others.select(flags)))


def as_sent(refused: DataFrame) -> DataFrame:
    """Refused events with the time as sent, not the default, and no made-up columns."""
    sent = refused.withColumns({"timestamp": F.col("sent_at"), "properties": F.col("custom")})
    missing = {name: F.lit(None).cast("string") for name in PAYLOAD if name not in sent.columns}
    return sent.withColumns(missing)


def flatten(raw: DataFrame, now: Column) -> DataFrame:
    """Raw nested events as flat ones, with ``valid``."""
    valid = V.has_required_fields(F.col("eventId"), F.col("eventType"), F.col("timestamp"))
    return flatten_enrich(raw.withColumn("valid", valid), now, keep=("app_code", "seq", "consent", "valid"))


def classify_flat(
    flat: DataFrame,
    contracts: DataFrame,
    cfg: EngineConfig,
    seen: DataFrame | None = None,
    materialize=write_through,
) -> DataFrame:
    """Flat events with ``outcome``: required fields, identify events, contracts,
    duplicates (also of ``seen``, ids accepted earlier) decide in this order. Privacy
    rules are applied to what goes on. New events and replayed ones both come here.

    The checked events are written once; what follows reads the columns it needs.
    """
    checked = materialize(check_contracts(flat, contracts, cfg))
    marked = mark_duplicates(checked, cfg, slot=V.takes_dedup_slot(), seen=seen)
    outcome = V.classify_outcome(marked)
    goes_on = F.col("outcome").isin(V.ACCEPTED, V.IDENTIFIED)
    raw_user, raw_custom = F.col("user_id"), F.col("custom")
    private = apply_privacy(
        outcome.withColumns({"_user": raw_user, "_custom": raw_custom, "_go": goes_on}), cfg
    )
    # rejected events keep what was sent
    return private.withColumns(
        {
            "user_id": F.when(F.col("_go"), F.col("user_id")).otherwise(F.col("_user")),
            "custom": F.when(F.col("_go"), F.col("custom")).otherwise(F.col("_custom")),
            "pii_masked": F.col("_go") & (F.col("outcome") == V.ACCEPTED) & F.col("pii_masked"),
            "consent_denied": F.col("_go") & F.col("consent_denied"),
        }
    ).drop("_user", "_custom", "_go")


def classify(
    raw: DataFrame,
    contracts: DataFrame,
    cfg: EngineConfig,
    now: Column,
    seen: DataFrame | None = None,
) -> DataFrame:
    return classify_flat(flatten(raw, now), contracts, cfg, seen)


def ingest_flat(
    flat: DataFrame, contracts: DataFrame, cfg: EngineConfig, now: Column, earlier: Earlier = Earlier()
) -> Ingested:
    """One batch of flat events. The classified events feed several results, so they are
    written to the shared folder; everything after starts from there."""
    classified = classify_flat(flat, contracts, cfg, earlier.seen)
    return Ingested(write_through(classified, "classified"), cfg, now, earlier)


def ingest(
    raw: DataFrame,
    contracts: DataFrame,
    cfg: EngineConfig,
    now: Column,
    earlier: Earlier = Earlier(),
) -> Ingested:
    """One batch. ``raw`` holds nested events with ``app_code`` and ``seq``."""
    return ingest_flat(flatten(raw, now), contracts, cfg, now, earlier)


def event_table(ingested: Ingested) -> DataFrame:
    return sink_defaults(ingested.events)
