"""Sources and sinks: any Hadoop path, declared schemas, resumable batch output."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files
from .schemas import SCHEMAS


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One or more files or folders as one table; no path is an error.  Listing order plays no part."""
    if not paths:
        raise ValueError("no input files")
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_dataset(spark: SparkSession, name: str, *folders: str) -> DataFrame:
    """A dataset by name from the first folder that holds it, as ``name`` or ``name.parquet``; nothing is fetched from
    anywhere else, so a dataset in none of them is an error."""
    files = Files(spark)
    for folder in folders:
        for path in (f"{folder.rstrip('/')}/{name}", f"{folder.rstrip('/')}/{name}.parquet"):
            if files.exists(path):
                return spark.read.parquet(path)
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders) or 'no folder'}")


def save_batch(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A batch and what is known of it as a whole (JSON values), together in one folder."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of id and contents ("title\\ntext"), with title and text apart."""
    df = spark.read.schema(SCHEMAS["corpus"]).json(path)
    at = F.instr("contents", "\n")
    title = F.when(at > 0, F.left("contents", at - 1)).otherwise(F.col("contents"))
    text = F.when(at > 0, F.substring(F.col("contents"), at + 1, F.length("contents"))).otherwise(F.lit(""))
    return df.withColumns({"title": title, "text": text})


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def difficulty_path(folder: str, threshold: float, n: int, inclusive: bool = False) -> str:
    """``corpus_d{gt|ge}{threshold}_n{n}.parquet`` with a p for the decimal point."""
    return f"{folder}/corpus_d{'ge' if inclusive else 'gt'}{f'{threshold:g}'.replace('.', 'p')}_n{n}.parquet"


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """A folder per batch; writing a batch again replaces that batch only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def without_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the written ones (resume)."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def dump_generations(df: DataFrame, path: str, step: int) -> None:
    """input, output, score, step and all further columns, a JSON object a row."""
    first = ["input", "output", "score"]
    df.select(*first, F.lit(step).alias("step"), *[c for c in df.columns if c not in first]).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str, step: int) -> None:
    """Appends a metrics table (name, value) with its step; non-finite values become null."""
    v = F.col("value").cast("double")
    clean = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    df.select(F.lit(step).alias("step"), "name", clean.alias("value")).write.mode("append").json(path)


def dump_arrays(df: DataFrame, path: str, keys: list[str], element: str = "float") -> None:
    """Selected array columns cast to a smaller element type."""
    arrays = {c: f"array<{element}>" for c, t in df.dtypes if c in keys and t.startswith("array<") and re.search("double|float|int", t)}
    df.select(*[F.col(c).cast(arrays[c]) if c in arrays else F.col(c) for c in keys]).write.mode("overwrite").parquet(path)


def flat_columns(df: DataFrame, sep: str = "/") -> list:
    """Select list that flattens nested structs to columns with joined names."""
    out = []

    def walk(schema, path):
        for f in schema.fields:
            here = [*path, f.name]
            if hasattr(f.dataType, "fields"):
                walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))

    walk(df.schema, [])
    return out
