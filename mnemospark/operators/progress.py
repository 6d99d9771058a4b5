"""What passes through a job's stages while it runs: rows, nulls of each column and failures, told to a callback.

Metrics ride along in the query (``observe``), so nothing is computed twice. A batch stage reports when its action ends, a stream after every
micro-batch through a listener.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: stage, metrics: rows, nulls_<column> and failures (only where a test of failure is given); streams add batch.
Callback = Callable[[str, dict], None]


def metrics(columns: list[str], failed: Column | None = None) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]]
    return out if failed is None else [*out, F.count_if(failed).alias("failures")]


class Progress:
    """Observed stages of batch jobs; ``report`` after an action tells the callback what each of them saw."""

    def __init__(self, callback: Callback):
        self.callback, self.open = callback, []

    def stage(self, df: DataFrame, name: str, failed: Column | None = None) -> DataFrame:
        seen = Observation(name)
        self.open.append((name, seen))
        return df.observe(seen, *metrics(df.columns, failed))

    def report(self) -> None:
        """Call after the action that ran the stages; a stage that no action has run would never answer."""
        for name, seen in self.open:
            self.callback(name, dict(seen.get))
        self.open = []


class _Listener(StreamingQueryListener):
    def __init__(self, names: set[str], callback: Callback):
        self.names, self.callback = names, callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name in self.names:
                self.callback(name, row.asDict() | {"batch": event.progress.batchId})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            for name in self.names:
                self.callback(name, {"error": event.exception})


def stream_stage(df: DataFrame, name: str, failed: Column | None = None) -> DataFrame:
    """A stage of a stream whose metrics ``listen`` hears under name."""
    return df.observe(name, *metrics(df.columns, failed))


def listen(spark: SparkSession, names: list[str], callback: Callback) -> Callable[[], None]:
    """Tells the callback the metrics of each micro-batch of stages by name; returns what ends it."""
    heard = _Listener(set(names), callback)
    spark.streams.addListener(heard)
    return lambda: spark.streams.removeListener(heard)
