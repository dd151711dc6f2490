"""What ingest remembers between batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.times import age_expired
from eventloom.operators.identity import latest_link, live_links
from eventloom.operators.sessions import fold_open_sessions
from eventloom.plans.ingest import Earlier, Ingested
from eventloom.schemas import IDENTITY_LINKS, OPEN_SESSIONS, SEEN_IDS
from eventloom.sources.state import BatchState


#: A batch number after all others.
LATEST = 2**62


@dataclass(frozen=True)
class IngestState:
    """Accepted ids, identity links and open sessions, below one folder.

    Ids and sessions are forgotten by the time they arrived, never by event times: a
    client with a wrong clock changes nothing for others. Links run out by their own
    time, as the rule says.
    """

    root: str
    cfg: EngineConfig
    now: Column

    def _seen(self) -> BatchState:
        def fold(rows: DataFrame) -> DataFrame:
            return rows.where(~age_expired(F.col("arrived_at"), self.cfg.seen_ttl_s, self.now))

        return BatchState(f"{self.root}/seen", SEEN_IDS, fold)

    def _links(self, of: str = "links") -> BatchState:
        def fold(rows: DataFrame) -> DataFrame:
            return live_links(latest_link(rows.withColumn("seq", F.lit(0))), self.cfg, self.now)

        return BatchState(f"{self.root}/{of}", IDENTITY_LINKS, fold)

    def _sessions(self, of: str = "sessions") -> BatchState:
        def fold(rows: DataFrame) -> DataFrame:
            return fold_open_sessions(rows, self.cfg, self.now)

        return BatchState(f"{self.root}/{of}", OPEN_SESSIONS, fold)

    def before(self, spark: SparkSession, batch: int) -> Earlier:
        """What batches of ingest before this one, and all replays, left behind."""
        links = self._links()
        sessions = self._sessions()
        return Earlier(
            self._seen().before(spark, batch),
            links.fold(links.before(spark, batch).unionByName(self._links("replay-links").before(spark, LATEST))),
            sessions.fold(
                sessions.before(spark, batch).unionByName(self._sessions("replay-sessions").before(spark, LATEST))
            ),
        )

    def add(self, done: Ingested, batch: int, written: bool = True) -> None:
        """Ids count as seen only if the events were ``written``."""
        self._seen().add(done.seen if written else done.seen.limit(0), batch)
        self._links().add(done.links, batch)
        self._sessions().add(done.sessions, batch)

    def add_replay(self, done: Ingested, run: int) -> None:
        self._links("replay-links").add(done.links, run)
        self._sessions("replay-sessions").add(done.sessions, run)
