"""Stateful flows on Structured Streaming: resumable batch scoring, the buffer of failed prompts, accumulation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import with_positions
from ..sources.files import Files


def run_batches(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies a batch transformation to every micro-batch and writes it to ``path/batch=<id>``.

    A batch that is replayed after a failure overwrites its own folder, so the output is exactly-once.
    """

    def each(df: DataFrame, batch: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accumulate_groups(source: DataFrame, path: str, checkpoint: str, wanted: int, spark: SparkSession, most_batches: int = 1000) -> bool:
    """Dynamic sampling until enough: micro-batches are taken one by one, the groups whose scores vary are appended,
    and no further batch is taken once ``wanted`` of them are there.  Returns whether they are.

    The source decides how much a micro-batch holds (``maxFilesPerTrigger`` and the like); a group's rows come in one.
    How many groups a batch gave is kept beside its rows, so nothing that is written is counted again, and a restart
    goes on where the last call ended.  More than ``most_batches`` is an error, as a source that never has enough groups
    would be read for ever.
    """
    from ..operators.groups import dynamic_sampling

    files, counts = Files(spark), f"{path.rstrip('/')}-groups"

    def there() -> int:
        found = dict(sorted(tuple(map(int, name.split("="))) for name in files.names(counts)))  # batch=groups
        return sum(found.values())

    enough = [there() >= wanted]
    if enough[0]:
        return True
    found: list[StreamingQuery] = []
    taken = [0]

    def each(df: DataFrame, batch: int) -> None:
        if enough[0] or taken[0] >= most_batches:  # the stop is under way: the batch stays uncommitted and is taken next time
            raise _Enough
        taken[0] += 1
        dynamic_sampling(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        files.make_dirs(f"{counts}/{batch}={spark.read.parquet(f'{path}/batch={batch}').select('uid').distinct().count()}")
        enough[0] = there() >= wanted

    found.append(source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        found[0].awaitTermination()
    except StreamingQueryException:
        if not enough[0] and taken[0] < most_batches:
            raise
    if not enough[0] and taken[0] >= most_batches:
        raise RuntimeError(f"{most_batches} batches hold fewer than {wanted} groups")
    return enough[0]


class _Enough(Exception):
    """Ends a query before a batch that is not needed any more."""


_STATE = "n long"
_OUT = "prompt string, recycle_count long, event string"


def _recycle(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    frames = list(frames)
    frame = frames[0] if len(frames) == 1 else pd.concat(frames)
    # A micro-batch's rows have no order of their own: their order column gives it.
    if not frame["order"].is_monotonic_increasing:
        frame = frame.sort_values("order", kind="stable")
    counts, events = [], []
    for ok, limit in zip(frame["success"].tolist(), frame["max_recycle"].tolist(), strict=True):
        seen = 0 if ok else seen + 1
        counts.append(seen)
        events.append("solved" if ok else "retry" if seen < limit else "dropped")
        if seen >= limit:
            seen = 0
    state.update((seen,))
    yield pd.DataFrame({"prompt": [key[0]] * len(counts), "recycle_count": counts, "event": events})


def recycle_failures(stream: DataFrame, max_recycle: int = 3, order: str | None = None) -> DataFrame:
    """Per prompt a counter of failures in a row (columns prompt, success): retry below the limit, dropped at it, solved resets.

    A prompt with several rows in one micro-batch needs an order column."""
    rows = stream.select("prompt", "success", F.lit(max_recycle).alias("max_recycle"), F.col(order).alias("order") if order else F.lit(0).alias("order"))
    return rows.groupBy("prompt").applyInPandasWithState(_recycle, _OUT, _STATE, "append", "NoTimeout")


_ROWS = "prompt string, recycle_count long, arrived long, place long"


class FailureBuffer:
    """FIFO of failed prompts as a state table: every version is an immutable folder ``v=<version>`` that counts once
    it is whole (its ``_SUCCESS`` is there), and the newest one is the state.  A new instance on the same path goes on
    with it, the step of the last drain included.

    ``add`` appends failures; ``drain`` gives up to ``rounds`` chunks of ``size`` prompts in order of arrival once
    ``trigger`` prompts wait and more than ``cooldown`` steps have passed since the last drain; ``chunks`` numbers them;
    ``give_back`` keeps those that may be recycled again.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, trigger: int, rounds: int = 1, cooldown: int = 0, max_recycle: int = 3):
        self.spark, self.path = spark, path.rstrip("/")
        self.size, self.trigger, self.rounds, self.cooldown, self.max_recycle = size, trigger, rounds, cooldown, max_recycle
        self.files = Files(spark)
        whole = [int(name.removeprefix("v=")) for name in self.files.names(self.path) if name.startswith("v=") and self.files.exists(f"{self.path}/{name}/_SUCCESS")]
        self.version = max(whole, default=0)
        steps = [int(name.removeprefix("drained=")) for name in self.files.names(f"{self.path}/steps") if name.startswith("drained=")]
        self.last = max(steps, default=-cooldown - 1)

    def table(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/v={self.version}")

    def _save(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={self.version + 1}")
        self.version += 1

    def _placed(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``new`` rows after all old ones, in the order of their prompts."""
        last = old.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_last"))
        placed = with_positions(new, "prompt", out="place").join(F.broadcast(last)).withColumn("place", F.col("place") + F.col("_last") + 1)  # one row
        return old.select("prompt", "recycle_count", "arrived", "place").unionByName(placed.select("prompt", "recycle_count", "arrived", "place"))

    def add(self, prompts: DataFrame, step: int) -> None:
        count = F.coalesce(F.col("recycle_count"), F.lit(0)).cast("long") if "recycle_count" in prompts.columns else F.lit(0).cast("long")
        self._save(self._placed(self.table(), prompts.select("prompt", count.alias("recycle_count"), F.lit(step).cast("long").alias("arrived"))))

    def drain(self, step: int) -> DataFrame | None:
        if step - self.last <= self.cooldown or self.table().count() < self.trigger:
            return None
        self.last = step
        self.files.make_dirs(f"{self.path}/steps/drained={step}")
        return self.table().orderBy("place").limit(self.size * self.rounds)

    def chunks(self, drained: DataFrame) -> DataFrame:
        """Adds the number of the chunk of ``size`` prompts; a drained table is small."""
        return drained.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("place")) - 1) / self.size).cast("int"))

    def give_back(self, drained: DataFrame, failed: DataFrame, step: int) -> None:
        """Drained prompts leave; those that failed again come back last, with their counter raised, while below the limit."""
        rest = self.table().join(drained.select("prompt"), "prompt", "left_anti")
        again = drained.join(failed.select("prompt"), "prompt", "left_semi").where(F.col("recycle_count") + 1 < self.max_recycle)
        self._save(self._placed(rest, again.select("prompt", (F.col("recycle_count") + 1).alias("recycle_count"), F.lit(step).cast("long").alias("arrived"))))


class PromptBuffer:
    """Rows that wait for a full batch: a staged table with dense positions and a cursor that only moves forward.

    ``take`` gives ``count`` rows, or, if fewer wait, as many as the number of workers divides; a new instance on the
    same path goes on at the cursor."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.parts = sorted(int(n.removeprefix("part=")) for n in self.files.names(self.path) if n.startswith("part=") and self.files.exists(f"{self.path}/{n}/_SUCCESS"))
        self.cursor = max([int(n.removeprefix("at=")) for n in self.files.names(f"{self.path}/cursor") if n.startswith("at=")], default=0)

    def table(self) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/part={p}" for p in self.parts]) if self.parts else None

    def size(self) -> int:
        return self.table().count() - self.cursor if self.parts else 0

    def add(self, df: DataFrame, *order: str) -> None:
        before = self.table().count() if self.parts else 0
        part = self.parts[-1] + 1 if self.parts else 0
        with_positions(df, *order, out="place").withColumn("place", F.col("place") + before).write.mode("overwrite").parquet(f"{self.path}/part={part}")
        self.parts.append(part)

    def take(self, count: int, workers: int) -> DataFrame | None:
        waiting = self.size()
        count = count if count <= waiting else waiting // workers * workers
        if not count:
            return None
        rows = self.table().where((F.col("place") >= self.cursor) & (F.col("place") < self.cursor + count))
        self.cursor += count
        self.files.make_dirs(f"{self.path}/cursor/at={self.cursor}")
        return rows


class ResumableSampler:
    """A permutation per epoch by hash, with a cursor that can be saved: (epoch, position) restores it.

    An epoch's permutation is written once, with dense positions, in folders of at least ``span`` positions each, and
    of no more than ``FOLDERS`` in all; a batch then reads the folders of its range and nothing else.  How many
    positions a folder has is in its parent's name, so that a restored sampler finds them."""

    #: Most folders of an epoch; each costs a file or two, whose making takes longer than their rows do.
    FOLDERS = 256

    def __init__(self, df: DataFrame, key: str, path: str, seed: int = 47, span: int = 100_000):
        self.df, self.key, self.path, self.seed, self.span = df, key, path.rstrip("/"), seed, span
        self.files = Files(df.sparkSession)

    def _epoch(self, epoch: int) -> tuple[str, int]:
        """The epoch's folder and the positions of each folder in it."""
        path = f"{self.path}/epoch={epoch}"
        for name in self.files.names(path):
            if self.files.exists(f"{path}/{name}/_SUCCESS"):
                return f"{path}/{name}", int(name.removeprefix("width="))
        h = F.md5(F.concat(F.col(self.key).cast("string"), F.lit(f":{self.seed}:{epoch}")))
        placed = with_positions(self.df.withColumn("_h", h), "_h", self.key, out="_place").drop("_h")
        width = max(self.span, -(-placed.count() // self.FOLDERS))
        placed.withColumn("_span", F.floor(F.col("_place") / width).cast("long")).write.mode("overwrite").partitionBy("_span").parquet(f"{path}/width={width}")
        return f"{path}/width={width}", width

    def batch(self, epoch: int, position: int, size: int) -> DataFrame:
        path, width = self._epoch(epoch)
        rows = self.df.sparkSession.read.parquet(path)
        last = (position + size - 1) // width
        near = rows.where(F.col("_span").between(position // width, last) & (F.col("_place") >= position) & (F.col("_place") < position + size))
        return near.orderBy("_place").select(*self.df.columns)
