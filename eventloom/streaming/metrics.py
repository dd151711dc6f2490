"""The ingest counters of a running stream."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from eventloom.operators.quality import metric_columns


def observe_stream(outcomes: DataFrame, name: str = "ingest") -> DataFrame:
    """Count as a side effect of the stream; the counts come with each progress report."""
    return outcomes.observe(name, *metric_columns())


class IngestCounters(StreamingQueryListener):
    """Adds up the counts of every trigger. Register with ``spark.streams.addListener``."""

    def __init__(self, name: str = "ingest") -> None:
        self.name = name
        self.totals: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.name)
        if counts is not None:
            self.totals.update({key: value or 0 for key, value in counts.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
