"""Session plumbing of the llm operators: tables, staged cuts of the lineage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as Spark holds rows in memory, up to which it is broadcast.
BROADCAST_BYTES = 24 << 20

#: Rows of an Arrow batch to and from Python, and of one call, so that a worker holds few texts at once.
CALL_ROWS = 1600
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: ASCII white space, the word rule of all contracts here, as a Java/RE2/Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a temporary folder; on a cluster that would be another
    folder on every machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def drop_staged(spark: SparkSession) -> None:
    """Deletes all staged tables of the shared folder; results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: the lineage ends there.

    A lost executor costs its running tasks only, and every reader sees the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if "/millrace/" in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the (staged) table's measured size is at most ``limit`` bytes; else a plain shuffle join.

    A row counts 24 bytes, 8 for each column, and the bytes of its strings.
    """
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    if rows is None or texts:
        found = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(F.col(f"`{c}`"))).alias(f"s{k}") for k, c in enumerate(texts))).first()
        rows, more = found["n"], sum(found[f"s{k}"] or 0 for k in range(len(texts)))
    else:
        more = 0
    return F.broadcast(df) if rows * (24 + 8 * len(df.columns)) + more <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch from the default; a choice of its own stays."""
    if int(spark.conf.get(_BATCH)) == 10_000:
        spark.conf.set(_BATCH, str(CALL_ROWS))


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Runs a columns-to-columns function over Arrow batches.

    ``make`` is called once a task and returns the function; its input is column name -> Python list,
    its output must hold every column of ``schema`` (any number of rows).
    """
    spark = df.sparkSession
    target = pa_schema(spark, schema)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, CALL_ROWS):
                batch = whole.slice(at, CALL_ROWS)
                out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in target for v in [out[f.name]]]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        del fn
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers are reused, and idle ones count like busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
