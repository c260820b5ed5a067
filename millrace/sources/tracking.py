"""Metrics of a run, step by step, to any number of backends.

Values come as Python numbers, one call a step; tables of metrics go through :func:`io.append_metrics` instead.
Metrics of a job or stream come from :func:`observed` and :class:`StreamMetrics`: Spark computes them while the rows pass,
so nothing is read twice.
Backends write through the session, so a path may be on any file system; none needs a network.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.registry import Registry
from .io import append_metrics

#: Backend: (session, path) -> a function of (data, step).
BACKENDS: Registry = Registry("tracking backend")
Log = Callable[[dict[str, float], int], None]


def finite(data: dict[str, object]) -> dict[str, float | None]:
    """Numbers as doubles, non-finite ones as null; whatever is no number is left out."""
    out: dict[str, float | None] = {}
    for name, x in data.items():
        try:
            v = float(x)  # numbers, booleans, numpy scalars
        except (TypeError, ValueError):
            continue
        out[name] = v if math.isfinite(v) else None
    return out


@BACKENDS.register("console")
def _console(spark: SparkSession, path: str | None) -> Log:
    return lambda data, step: print(f"step:{step} - " + " - ".join(f"{k}:{v}" for k, v in finite(data).items()), flush=True)


@BACKENDS.register("json")
def _json(spark: SparkSession, path: str | None) -> Log:
    return lambda data, step: append_metrics(spark.createDataFrame(list(finite(data).items()), "name string, value double"), path, step)


@BACKENDS.register("parquet")
def _parquet(spark: SparkSession, path: str | None) -> Log:
    def log(data: dict[str, float], step: int) -> None:
        spark.createDataFrame([(step, k, v) for k, v in finite(data).items()], "step int, name string, value double").write.mode("append").parquet(path)

    return log


class Tracking:
    """Logs to all backends named; an unknown name is an error, further backends can be registered."""

    def __init__(self, spark: SparkSession, backends: list[str], path: str | None = None):
        self.logs = {name: BACKENDS.lookup(name)(spark, f"{path}/{name}" if path else None) for name in backends}

    def log(self, data: dict[str, float], step: int, backends: list[str] | None = None) -> None:
        for name, log in self.logs.items():
            if backends is None or name in backends:
                log(data, step)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation of aggregates over them that is filled by the first action on the rows."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen


def log_observed(run: Tracking, seen: Observation, step: int) -> dict:
    """Logs what an action has observed (waits for it) and returns it."""
    found = dict(seen.get)
    run.log(found, step)
    return found


class StreamMetrics(StreamingQueryListener):
    """Logs the observed metrics of every micro-batch of a stream, with the batch's number as the step.

    ``df.observe(name, ...)`` on the stream names them; other names are left alone.  A listener must not run jobs while
    Spark calls it, so the values are kept until ``flush``, which returns how many batches it logged.  A batch that is
    replayed after a restart is logged again, by the same step."""

    def __init__(self, run: Tracking, name: str):
        self.run, self.name, self.waiting = run, name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows > 0:
            self.waiting.append((event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> int:
        ready, self.waiting = self.waiting, []
        for step, found in ready:
            self.run.log(found, step)
        return len(ready)


def tracked_stream(source: DataFrame, run: Tracking, name: str, metrics: dict[str, Column], path: str, checkpoint: str) -> int:
    """Writes a stream to Parquet as far as it is there and logs the metrics of each micro-batch; returns how many there were."""
    spark, listener = source.sparkSession, StreamMetrics(run, name)
    spark.streams.addListener(listener)
    try:
        rows = source.observe(name, *(c.alias(k) for k, c in metrics.items()))
        query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # events are delivered behind the query
    finally:
        spark.streams.removeListener(listener)
    return listener.flush()
