"""Progress of long jobs: counts that Spark takes on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """A stream whose batches report the number of rows and further counts under a name; nothing is computed twice."""
    return stream.observe(name, F.count("*").alias("rows"), *(c.alias(n) for n, c in counts.items()))


class Progress(StreamingQueryListener):
    """Sums what counted() reports over batches, and tells each time another `every` rows are done: tell(totals)."""

    def __init__(self, name: str, every: int, tell: Callable[[dict], None]):
        self.name, self.every, self.tell, self.totals = name, every, tell, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        before = self.totals.get("rows", 0) // self.every
        for field, value in seen.asDict().items():
            self.totals[field] = self.totals.get(field, 0) + (value or 0)
        if self.totals.get("rows", 0) // self.every > before:
            self.tell(dict(self.totals))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
