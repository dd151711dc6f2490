"""Counts of what happened to the events, backlog figures and the request cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.times import sweep_due, trunc_second
from eventloom.operators import validate as V

_STORED = (V.VALIDATION_FAILED, V.SCHEMA_VIOLATION)
_REJECTED = (V.VALIDATION_FAILED, V.IDENTIFY_REJECTED, V.SCHEMA_VIOLATION)
_ACCEPTED = (V.IDENTIFIED, V.ACCEPTED)

# Lanes for ranking inside a busy second: with a cap of n, at most n rows of each
# lane take part in the final ranking.
_RANK_LANES = 1_024


def _outcome_in(*values: str) -> Column:
    return F.count_if(F.col("outcome").isin(*values))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Accepted, duplicate, rejected and dead-lettered events per app."""
    return outcomes.groupBy("app_code").agg(
        _outcome_in(*_ACCEPTED).alias("accepted"),
        _outcome_in(V.DUPLICATE).alias("duplicate"),
        _outcome_in(*_REJECTED).alias("rejected"),
        _outcome_in(*_STORED).alias("dead_lettered"),
    )


def metric_columns() -> list[Column]:
    """The counters of a batch. The flag columns must be null or false where a step
    was not reached."""
    violated = F.size("violations") > 0
    reached = ~F.col("outcome").isin(V.VALIDATION_FAILED, V.IDENTIFIED, V.IDENTIFY_REJECTED)
    return [
        _outcome_in(*_ACCEPTED).alias("accepted"),
        _outcome_in(V.DUPLICATE).alias("duplicate"),
        _outcome_in(*_REJECTED).alias("rejected"),
        _outcome_in(*_STORED).alias("dlq_stored"),
        F.count_if(violated & reached).alias("schema_violation"),
        F.count_if(F.col("pii_masked")).alias("pii_masked"),
        # identify events pass the consent gate too, but only collected events count
        F.count_if(F.col("consent_denied") & (F.col("outcome") == V.ACCEPTED)).alias("consent_denied"),
        F.count_if(F.col("identity_linked")).alias("identity_linked"),
        F.count_if(F.col("identity_resolved")).alias("identity_resolved"),
    ]


def pipeline_metrics(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*metric_columns())


def observe_metrics(outcomes: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The same counters as a side effect of the job that writes the rows."""
    observation = Observation(name)
    return outcomes.observe(observation, *metric_columns()), observation


def backlog_gauges(
    entries: DataFrame, sessions: DataFrame, outcomes: DataFrame, cfg: EngineConfig, now: Column
) -> DataFrame:
    """(gauge, value): dead-letter size, live sessions, share of checked events that
    were duplicates."""
    size = entries.agg(F.count("*").cast("double").alias("value"))
    live = sessions.agg(
        F.count_if(~sweep_due(F.col("last_active_at"), cfg.session_timeout_s, now)).cast("double").alias("value")
    )
    checked = _outcome_in(V.ACCEPTED, V.DUPLICATE)
    share = outcomes.agg(
        F.when(checked > 0, _outcome_in(V.DUPLICATE) / checked).otherwise(F.lit(0.0)).alias("value")
    )
    named = [
        size.select(F.lit("dlq_size").alias("gauge"), "value"),
        live.select(F.lit("live_sessions").alias("gauge"), "value"),
        share.select(F.lit("duplicate_share").alias("gauge"), "value"),
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


def rate_cap(
    requests: DataFrame,
    cfg: EngineConfig,
    client: str = "app_code",
    ts: str = "timestamp",
    request_id: str = "event_id",
) -> DataFrame:
    """Add ``over_limit``: not among the first n requests of its client and second.

    Ranked in two steps. A request that is not among the first n of its lane cannot
    be among the first n overall; the rest, at most n per lane, are ranked together.
    So one task never ranks an unbounded second.
    """
    n = cfg.max_requests_per_second
    lane = F.pmod(F.xxhash64(request_id), F.lit(_RANK_LANES)).cast("int")
    prepared = requests.withColumns(
        {
            "_client": F.coalesce(F.when(F.col(client) != "", F.col(client)), F.lit(cfg.default_client)),
            "_second": trunc_second(F.col(ts)),
            "_lane": lane,
        }
    )
    in_lane = W.partitionBy("_client", "_second", "_lane").orderBy(ts, request_id)
    ranked = prepared.withColumn("_first", F.row_number().over(in_lane) <= n)
    together = W.partitionBy("_client", "_second", F.when(~F.col("_first"), F.col("_lane"))).orderBy(ts, request_id)
    return (
        ranked.withColumn("over_limit", ~F.col("_first") | (F.row_number().over(together) > n))
        .drop("_client", "_second", "_lane", "_first")
    )
