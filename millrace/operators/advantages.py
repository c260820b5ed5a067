"""Group-relative advantages over rollouts: a row per response with a group ``uid``, an order ``k`` and a ``score``.

Statistics of a group are broadcast to its rows by one window over ``uid`` (one exchange), never by a
self-join.  A result adds the column ``advantage``; ``over_tokens`` spreads it over a response mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import discounted_returns, gae
from .layout import with_positions
from .registry import Registry

ESTIMATORS = Registry("advantage estimator")
EPS = 1e-6


def _group(uid: str = "uid"):
    return Window.partitionBy(uid)


def over_tokens(advantage: Column | str, mask: Column | str) -> Column:
    a = F.col(advantage) if isinstance(advantage, str) else advantage
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.transform(m, lambda x: a * x.cast("double"))


@ESTIMATORS.register("grpo")
def grpo(df: DataFrame, score: str = "score", eps: float = EPS, scale: bool = True) -> DataFrame:
    """(s - mean) / (sample deviation + eps); a group of one keeps mean 0 and deviation 1."""
    n, s = F.count("*").over(_group()), F.col(score)
    mean = F.when(n == 1, 0.0).otherwise(F.avg(score).over(_group()))
    dev = F.when(n == 1, 1.0).otherwise(F.stddev_samp(score).over(_group()))
    return df.withColumn("advantage", (s - mean) / (dev + eps) if scale else s - mean)


@ESTIMATORS.register("grpo_split")
def grpo_split(df: DataFrame, on_policy: str = "on_policy", score: str = "score", eps: float = EPS, scale: bool = True, strict: bool = False) -> DataFrame:
    """Statistics of the on-policy rows, applied to all rows of the group.

    A deviation of 0 counts as 1.  A group without on-policy rows has a null advantage, or with ``strict`` fails.
    """
    on = F.when(F.col(on_policy), F.col(score))
    n = F.count(on).over(_group())
    mean = F.when(n == 1, 0.0).when(n > 1, F.avg(on).over(_group()))
    dev = F.when(n == 1, 1.0).when(n > 1, F.stddev_samp(on).over(_group()))
    dev = F.when(dev == 0, 1.0).otherwise(dev)
    out = (F.col(score) - mean) / (dev + eps) if scale else F.col(score) - mean
    if strict:
        out = F.when(n == 0, F.raise_error(F.lit("a group has no on-policy rows")).cast("double")).otherwise(out)
    return df.withColumn("advantage", out)


@ESTIMATORS.register("grpo_passk")
def grpo_passk(df: DataFrame, score: str = "score", order: str = "k", eps: float = EPS, scale: bool = True) -> DataFrame:
    """Only a group's best row gets (best - second best), ties to the first; a group of one fails."""
    best_first = _group().orderBy(F.desc(score), order)
    n = F.count("*").over(_group())
    second = F.max(F.when(F.col("_place") == 2, F.col(score))).over(_group())
    out = df.withColumn("_place", F.row_number().over(best_first))
    gain = F.col(score) - second
    if scale:
        gain = gain / (F.stddev_samp(score).over(_group()) + eps)
    checked = F.when(n < 2, F.raise_error(F.lit("pass@k needs two responses a group")).cast("double")).when(F.col("_place") == 1, gain).otherwise(0.0)
    return out.withColumn("advantage", checked).drop("_place")


@ESTIMATORS.register("rloo")
def rloo(df: DataFrame, score: str = "score") -> DataFrame:
    """Score minus the mean of the others; a group of one keeps its score."""
    n, total = F.count("*").over(_group()), F.sum(score).over(_group())
    return df.withColumn("advantage", F.when(n > 1, F.col(score) - F.try_divide(total - F.col(score), n - 1)).otherwise(F.col(score).cast("double")))


@ESTIMATORS.register("opo")
def opo(df: DataFrame, length: str = "length", score: str = "score") -> DataFrame:
    """Score minus the length-weighted mean score; a group of one has baseline 0."""
    n = F.count("*").over(_group())
    base = F.try_divide(F.sum(F.col(length) * F.col(score)).over(_group()), F.sum(length).over(_group()))
    return df.withColumn("advantage", F.col(score) - F.when(n > 1, base).otherwise(0.0))


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def rfpp_baseline(df: DataFrame, length: str = "length", score: str = "score") -> DataFrame:
    """s - mean (mean 0 for a group of one), then whitened over all response tokens of the batch.

    The batch's moments are one global aggregation of per-row moments; a one-row table is joined back.
    """
    n = F.count("*").over(_group())
    raw = df.withColumn("_raw", F.col(score) - F.when(n > 1, F.avg(score).over(_group())).otherwise(0.0))
    moments = raw.agg(F.sum(length).alias("_n"), F.sum(F.col(length) * F.col("_raw")).alias("_s")).withColumn("_mean", F.col("_s") / (F.col("_n") + 1e-8))
    spread = raw.join(F.broadcast(moments.select("_n", "_mean"))).agg(
        F.first("_n").alias("_n"), F.first("_mean").alias("_mean"), (F.sum(F.col(length) * F.pow(F.col("_raw") - F.col("_mean"), 2)) / (F.first("_n") + 1e-8)).alias("_var")
    )
    unbiased = F.col("_var") * F.try_divide(F.col("_n").cast("double"), F.col("_n") - 1)
    both = raw.join(F.broadcast(spread))  # one row
    return both.withColumn("advantage", (F.col("_raw") - F.col("_mean")) / F.sqrt(unbiased + 1e-8)).drop("_raw", "_n", "_mean", "_var")


@ESTIMATORS.register("remax")
def remax(df: DataFrame, rewards: str = "rewards", baseline: str = "baseline") -> DataFrame:
    """Per token: reverse running sum of the rewards, minus the baseline."""
    return df.withColumn("returns", discounted_returns(rewards, 1.0)).withColumn("advantage", F.transform("returns", lambda r: r - F.col(baseline)))


@ESTIMATORS.register("reinforce_plus_plus", "reinforce")
def rfpp(df: DataFrame, rewards: str = "rewards", gamma: float = 1.0) -> DataFrame:
    return df.withColumn("returns", discounted_returns(rewards, gamma)).withColumn("advantage", F.col("returns"))


@ESTIMATORS.register("gae")
def gae_estimator(df: DataFrame, rewards: str = "rewards", values: str = "values", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """advantage (not whitened) and returns = advantage + value, per token."""
    out = df.withColumn("advantage", gae(rewards, values, gamma, lam))
    return out.withColumn("returns", F.zip_with("advantage", values, lambda a, v: a + v.cast("double")))


def softmean(x: Column | str, beta: float) -> Column:
    """ln(mean(exp(beta x))) / beta as an aggregate, shifted by the maximum for stability; the mean for beta 0."""
    c = F.col(x) if isinstance(x, str) else x
    if beta == 0:
        return F.avg(c)
    top = F.max(c) if beta > 0 else F.min(c)
    # exp(beta (x - top)) needs the maximum first: it is a window in the caller's plan or a second aggregate.
    return top + F.ln(F.avg(F.exp(F.lit(beta) * c)) / F.exp(F.lit(beta) * top)) / F.lit(beta)


@ESTIMATORS.register("sppo")
def sppo(df: DataFrame, beta: float = 1.0, score: str = "score") -> DataFrame:
    """Score minus the soft mean of the whole batch."""
    top = df.agg((F.max(score) if beta >= 0 else F.min(score)).alias("_top"))
    base = F.avg(score) if beta == 0 else F.first("_top") + F.ln(F.avg(F.exp(F.lit(beta) * (F.col(score) - F.col("_top"))))) / F.lit(beta)
    one = df.join(F.broadcast(top)).agg(base.alias("_base"))  # one row each
    return df.join(F.broadcast(one)).withColumn("advantage", F.col(score) - F.col("_base")).drop("_base")


def prime_rloo(df: DataFrame, reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Per sequence the masked mean reward, minus the mean of the group's other sequences (n - 1 of them)."""
    total = F.aggregate(F.zip_with(reward, mask, lambda r, m: r.cast("double") * m.cast("double")), F.lit(0.0), lambda a, x: a + x)
    count = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = df.withColumn("_mean", total / (count + 1e-8))
    n = F.count("*").over(_group())
    others = F.try_divide(F.sum("_mean").over(_group()) - F.col("_mean"), n - 1)
    return out.withColumn("advantage", F.when(n > 1, F.col("_mean") - others).otherwise(F.col("_mean"))).drop("_mean")


def preference_pairs(df: DataFrame, score: str = "score", order: str = "k") -> DataFrame:
    """chosen (boolean): of each group's rows the best one, ties to the first."""
    return df.withColumn("chosen", F.row_number().over(_group().orderBy(F.desc(score), order)) == 1)


def weights_pf_ppo(df: DataFrame, how: str = "pow", power: float = 2.0, score: str = "score") -> DataFrame:
    """Resampling weights: |s|^p, or 1 for a batch's extremes and 0 else (max_min), or 0.4 at the
    maximum and 0.1 else (max_random); 1e-8 is added."""
    s = F.col(score)
    if how == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), power) + 1e-8)
    ends = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    both = df.join(F.broadcast(ends))
    if how == "max_min":
        w = F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0)
    elif how == "max_random":
        w = F.when(s == F.col("_hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown weighting {how!r}")
    return both.withColumn("weight", w + 1e-8).drop("_hi", "_lo")


def resample(df: DataFrame, key: list[str], weight: str = "weight", seed: str = "resample") -> DataFrame:
    """As many draws with replacement as there are rows, with chances in proportion to the weights: draw (from 0) and the
    row drawn.

    Draw i takes the row whose span of the cumulated weights holds a number hashed from i.  Spans and numbers meet in
    buckets of the weight's range, so a bucket holds about as many draws as rows and nothing is paired beyond it."""
    placed = with_positions(df, *key, out="_pos")
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Cumulated weights in two levels: within runs of positions, and over the runs.
    total = placed.agg(F.count("*").alias("_n"), F.sum(weight).alias("_all"))
    runs = placed.join(F.broadcast(total)).withColumn("_run", F.floor(F.col("_pos") * n_parts / F.col("_n")))  # one row
    inside = Window.partitionBy("_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_upto", F.sum(weight).over(inside)).withColumn("_from", F.coalesce(F.lag("_upto").over(Window.partitionBy("_run").orderBy("_pos")), F.lit(0.0)))
    before = runs.groupBy("_run").agg(F.max("_upto").alias("_sum"))
    over = Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_run", F.coalesce(F.sum("_sum").over(over), F.lit(0.0)).alias("_before"))  # a row a partition
    # A span ends where the next one begins, to the last bit; the last one ends at 1.
    end = F.when(F.col("_pos") == F.col("_n") - 1, 1.0).otherwise((F.col("_before") + F.col("_upto")) / F.col("_all"))
    spans = runs.join(F.broadcast(before), "_run").withColumns({"_hi": end, "_lo": (F.col("_before") + F.col("_from")) / F.col("_all")})
    bucket = lambda x: F.floor(x * F.col("_n")).cast("long")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), F.greatest(bucket(F.col("_lo")), bucket(F.col("_hi"))))))
    draws = placed.join(F.broadcast(total)).select(F.col("_pos").alias("draw"), "_n")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    draws = draws.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * F.col("_n")).cast("long")).drop("_n")
    hit = draws.join(spans, "_bucket").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return hit.select("draw", *df.columns)
