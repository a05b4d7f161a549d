"""Counters and histograms gathered while a plan runs, and progress of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of the buckets for result counts, and for latencies in seconds.
RESULT_COUNTS = (0, 1, 5, 10, 20, 50, 100)
LATENCIES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what it will report once it has run: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """The smallest bound that is not below the value; null beyond the last."""
    out = F.when(value <= bounds[0], F.lit(bounds[0]))
    for b in bounds[1:]:
        out = out.when(value <= b, F.lit(b))
    return out


def histogram(df: DataFrame, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    return df.groupBy(bucket(value, bounds).alias("le")).agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Calls back with the name, batch number and rows of each micro-batch."""

    def __init__(self, tell: Callable[[str | None, int, int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
