"""Registry of queries and the inputs that they share: rollouts, tokens and reasoning texts made from the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import work_partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, the SQL that it must agree with."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a table of few bytes is one scan task, which work of much time a row would not leave."""
    return df.repartition(work_partitions(df.sparkSession))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, for queries that write and read back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/millrace-queries/{name}-{uuid.uuid4().hex}"


#: SQL of :func:`functions.text.hashed_unit`.
UNIT = "(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"


def r6(c, digits: int = 6):
    """Rounded for comparison, with negative zero removed."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """A row per event as a response: uid, k, value, score (1 for a purchase), on_policy, length, event_type."""
    # Named before the window, so that later windows over uid reuse its partitioning.
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumnRenamed("user_id", "uid").select(
        "uid", (F.row_number().over(w) - 1).alias("k"), "event_id", "value",
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("score"),
        (F.col("event_type") != "view").alias("on_policy"), (1 + F.col("event_id") % 37).alias("length"), "event_type",
    )


ROLLOUTS = """r AS (SELECT user_id AS uid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS k, event_id, value,
  CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, event_type <> 'view' AS on_policy, (1 + event_id % 37)::BIGINT AS length, event_type FROM events)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """A row per line item as a token of its order: uid, k, pos, reward, value, logp, old, ref, adv and the masks."""
    w = Window.partitionBy("uid").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = F.col
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "uid").select(
        "uid", F.lit(0).alias("k"), (F.row_number().over(w) - 1).alias("pos"), c("l_discount").alias("reward"), c("l_tax").alias("value"),
        (-5.0 * c("l_discount") - 0.02).alias("logp"), (-5.0 * c("l_tax") - 0.05).alias("old"), (-3.0 * c("l_tax") - 0.1).alias("ref"), (c("l_quantity") / 25.0 - 1.0).alias("adv"),
        (c("l_returnflag") != "R").alias("mask"), (c("l_linestatus") == "F").alias("prefix"), (c("l_returnflag") == "A").alias("se"), (c("l_linenumber") % 5 != 0).alias("reward_mask"),
    )


TOKENS = """t AS (SELECT l_orderkey AS uid, 0 AS k, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS pos, l_discount AS reward, l_tax AS value,
  -5.0::DOUBLE * l_discount - 0.02::DOUBLE AS logp, -5.0::DOUBLE * l_tax - 0.05::DOUBLE AS old, -3.0::DOUBLE * l_tax - 0.1::DOUBLE AS ref, l_quantity / 25.0::DOUBLE - 1.0::DOUBLE AS adv,
  (l_returnflag <> 'R')::INT::DOUBLE AS m, (l_linestatus = 'F')::INT::DOUBLE AS p, (l_returnflag = 'A')::INT::DOUBLE AS se, (l_linenumber % 5 <> 0)::INT::DOUBLE AS rm FROM lineitem)"""


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's next turn: conv_id, turn, problem, response."""
    c = table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"])


EXCHANGES = """x AS (SELECT u.conv_id, u.turn, u.text AS problem, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges with a solution whose think tags vary: none, opening only, closing only, both."""
    way = F.pmod(F.col("conv_id") + F.col("turn") / 2, F.lit(4)).cast("int")
    r = F.col("response")
    solution = F.when(way == 0, r).when(way == 1, F.concat(F.lit("<think>\n"), r)).when(way == 2, F.concat(r, F.lit("</think>\nanswer"))).otherwise(F.concat(F.lit("<think>"), r, F.lit("</think>\n\nanswer ")))
    return exchanges(spark, d).withColumn("solution", solution)


MARKED = EXCHANGES + """, y AS (SELECT *, CASE CAST(floor((conv_id + turn / 2.0) % 4) AS INT) WHEN 0 THEN response WHEN 1 THEN '<think>' || chr(10) || response
  WHEN 2 THEN response || '</think>' || chr(10) || 'answer' ELSE '<think>' || response || '</think>' || chr(10) || chr(10) || 'answer ' END AS solution FROM x)"""
