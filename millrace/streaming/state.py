"""Operators whose state lives in the stream: an adaptive coefficient per run, and first-in-first-out failure queues.

Both are processors of ``transformWithStateInPandas``: value and list state per key, kept in the state store and
restored from the checkpoint, so a query that starts again goes on where it ended, and one that is replayed gives the
same rows.  Keys spread over the cluster; a key's rows of a micro-batch are put in order of their step.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these processors need; the session's own setting returns after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class AdaptiveCoefficient(StatefulProcessor):
    """The coefficient of a KL penalty: after each step it grows or shrinks by at most a fifth of n / horizon."""

    def __init__(self, beta: float, target: float, horizon: float):
        self.beta, self.target, self.horizon = beta, target, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("beta", "beta double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, "step")
        beta = self.state.get()[0] if self.state.exists() else self.beta
        after = []
        for kl, n in zip(frame["kl"], frame["n"], strict=True):
            if pd.notna(kl) and pd.notna(n):
                beta *= 1 + max(-0.2, min(0.2, kl / self.target - 1)) * n / self.horizon
            after.append(beta)
        self.state.update((beta,))
        yield pd.DataFrame({"run": key[0], "step": frame["step"].to_numpy(), "beta": after})

    def close(self) -> None:
        pass


def adaptive_coefficients(steps: DataFrame, beta: float, target: float, horizon: float) -> DataFrame:
    """run, step, beta after it, from a stream of run, step, kl and n (what a step counts).

    A step without kl or n leaves the coefficient as it is; rows of a step that come in a later micro-batch than those of
    the next one are taken when they come."""
    rows = steps.select(F.col("run").cast("long"), F.col("step").cast("long"), F.col("kl").cast("double"), F.col("n").cast("long"))
    return rows.groupBy("run").transformWithStateInPandas(AdaptiveCoefficient(beta, target, horizon), "run long, step long, beta double", "Append", "None")


class FailureQueue(StatefulProcessor):
    """Failed prompts wait in order; enough of them, and enough steps since the last time, let the first ones go."""

    COLUMNS = ["buffer", "step", "chunk", "place", "prompt", "recycle_count"]

    def __init__(self, size: int, trigger: int, rounds: int, cooldown: int, max_recycle: int):
        self.size, self.trigger, self.rounds, self.cooldown, self.max_recycle = size, trigger, rounds, cooldown, max_recycle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "prompt string, recycle_count long")
        self.drained = handle.getValueState("drained", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A key's rows of a micro-batch are many: they are kept as numbers and packed text, and rows go out in parts.
        parts = [(f["step"].to_numpy(), f["place"].to_numpy(), f["recycle_count"].to_numpy(), (f["success"] != True).to_numpy(), pa.array(f["prompt"], pa.string())) for f in rows]  # noqa: E712  null is no success
        steps, places, counts, lost = (np.concatenate([p[k] for p in parts]) for k in range(4))
        prompts = pa.chunked_array([p[4] for p in parts])
        lost &= counts < self.max_recycle
        order = np.lexsort((places, steps))
        steps = steps[order]
        ends = np.append(np.flatnonzero(steps[1:] != steps[:-1]) + 1, len(steps))
        queue = deque(self.waiting.get())
        known, out = len(queue), []
        last = self.drained.get()[0] if self.drained.exists() else None
        begin = 0
        for end in ends:
            step, here = int(steps[begin]), order[begin:end]
            queue += [(int(i), int(counts[i])) for i in here[lost[here]]]  # a row's number until its prompt is needed
            begin = end
            if len(queue) >= self.trigger and (last is None or step - last > self.cooldown):
                last, known = step, -1
                for i in range(min(len(queue), self.size * self.rounds)):
                    prompt, count = queue.popleft()
                    out.append((key[0], step, i // self.size, i, prompts[prompt].as_py() if isinstance(prompt, int) else prompt, count + 1))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=self.COLUMNS)
                out = []
        left = [(prompts[p].as_py() if isinstance(p, int) else p, count) for p, count in queue]
        if known < 0:
            self.waiting.put(left) if left else self.waiting.clear()
            self.drained.update((last,))
        elif len(left) > known:
            self.waiting.appendList(left[known:])
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def failure_queue(attempts: DataFrame, size: int, trigger: int, rounds: int = 1, cooldown: int = 0, max_recycle: int = 3) -> DataFrame:
    """buffer, step, chunk, place, prompt, recycle_count of the prompts that are tried again, from a stream of buffer,
    step, place (order within the step), prompt, success and recycle_count.

    A buffer's failures below ``max_recycle`` wait first in, first out.  After a step of it in which at least
    ``trigger`` wait and more than ``cooldown`` steps have passed since the last time, up to ``rounds`` chunks of ``size``
    go, with their count raised.  Several buffers (say, by a hash of the prompt) share the work."""
    rows = attempts.select(F.col("buffer").cast("long"), F.col("step").cast("long"), F.col("place").cast("long"), "prompt", "success", F.coalesce(F.col("recycle_count"), F.lit(0)).cast("long").alias("recycle_count"))
    return rows.groupBy("buffer").transformWithStateInPandas(FailureQueue(size, trigger, rounds, cooldown, max_recycle), "buffer long, step long, chunk long, place long, prompt string, recycle_count long", "Append", "None")
