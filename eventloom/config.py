"""All settings of the engine, in one immutable object handed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

MINUTE = 60
DAY = 86_400


@dataclass(frozen=True)
class EngineConfig:
    """Durations are whole seconds unless the name says otherwise."""

    # sessions
    session_timeout_s: int = 30 * MINUTE
    session_key_columns: tuple[str, ...] = ("session_id", "anonymous_id", "user_id")
    bounce_max_page_views: int = 1
    bounce_below_ms: int = 10_000

    # a session that is idle or finished is remembered for so long after its last event
    # arrived, so that late events still find it
    session_keep_s: int = DAY

    # duplicates; an accepted id is remembered for so long after it arrived
    dedup_window_s: int = 5 * MINUTE
    seen_ttl_s: int = 60 * MINUTE

    # identity
    identity_enabled: bool = True
    identity_ttl_days: int = 90

    # event contracts: off, monitor, enforce
    contract_mode: str = "monitor"

    # privacy
    require_consent: bool = False
    hash_user_id: bool = False
    pii_fields: tuple[str, ...] = ()
    mask_heuristics: bool = False

    # dead letters
    dlq_batch_size: int = 100
    dlq_max_retry: int = 10
    dlq_ttl_s: int = 7 * DAY
    dlq_dead_ttl_s: int = 30 * DAY
    dlq_jitter: float = 0.2

    # retention of the events and sessions tables
    table_ttl_s: int = 90 * DAY

    # requests per client and second; the burst setting never binds because the
    # per-second bucket is the smaller one, so it has no field here
    max_requests_per_second: int = 10_000
    max_events_per_envelope: int = 500
    default_client: str = "default"

    # topics
    events_topic: str = "events"
    sessions_topic: str = "sessions"
    dead_letter_topic: str = "events-dlq"
    events_partitions: int = 12
    sessions_partitions: int = 6
    async_topic: bool = True

    # streaming
    watermark: str = "10 minutes"

    def __post_init__(self) -> None:
        if self.contract_mode not in ("off", "monitor", "enforce"):
            raise ValueError(f"contract_mode must be off, monitor or enforce, not {self.contract_mode!r}")
        if self.identity_ttl_days < 1:
            object.__setattr__(self, "identity_ttl_days", 1)

    def with_(self, **changes: object) -> "EngineConfig":
        return replace(self, **changes)
