"""Masked statistics over token tables in long form (a row per token: uid, k, pos, value columns, mask).

Everything is one or two levels of aggregation with map-side combining; global moments are one-row tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def _field(name: str):
    return lambda t: t[name]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_long(df: DataFrame, ids: list[str], arrays: list[str]) -> DataFrame:
    """One row per token: ids, pos and the arrays' elements under their names."""
    return df.select(*ids, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_t")).select(*ids, "pos", *(F.col("_t")[a].alias(a) for a in arrays))


def to_arrays(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """The inverse of :func:`to_long`: arrays in the order of pos."""
    rows = df.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_t"))
    return rows.select(*ids, *(F.transform("_t", _field(c)).alias(c) for c in columns))


def masked_sum(value: Column | str, mask: Column | str) -> Column:
    return F.sum(_c(value) * _c(mask).cast("double"))


def masked_mean(value: Column | str, mask: Column | str) -> Column:
    """Sum over the mask divided by (its size + 1e-8), as an aggregate."""
    return F.sum(_c(value) * _c(mask).cast("double")) / (F.sum(_c(mask).cast("double")) + EPS)


def moments(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: n, mean and unbiased variance of the masked values; fails on a mask of one or none, as its variance is undefined."""
    m = F.col(mask).cast("double")
    first = df.agg(F.sum(m).alias("n"), masked_mean(value, mask).alias("mean"))
    second = df.join(F.broadcast(first)).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum(F.pow(F.col(value) - F.col("mean"), 2) * m) / (F.first("n") + EPS)).alias("v"))
    bad = F.coalesce(F.col("n"), F.lit(0.0)) <= 1
    return second.select("n", "mean", F.when(bad, F.raise_error(F.lit("a masked variance needs two values")).cast("double")).otherwise(F.col("v") * F.try_divide(F.col("n"), F.col("n") - 1)).alias("variance"))


def whiten(df: DataFrame, value: str, mask: str, shift_mean: bool = True, out: str = "whitened") -> DataFrame:
    """(v - mean) / sqrt(variance + 1e-8) at every position, masked ones included; without shift_mean the mean is added back."""
    one = moments(df, value, mask).select(F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    x = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + EPS)
    return df.join(F.broadcast(one)).withColumn(out, x if shift_mean else x + F.col("_m")).drop("_m", "_v")  # one row


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str, width: int | None = None, seq: tuple[str, ...] = ("uid", "k")) -> DataFrame:
    """One row ``loss``: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm (needs the padded width)."""
    if mode not in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        raise ValueError(f"unknown loss aggregation {mode!r}")
    m = F.col(mask).cast("double")
    if mode == "token-mean":
        return df.agg(masked_mean(loss, mask).alias("loss"))
    per = df.groupBy(*seq).agg(F.sum(F.col(loss) * m).alias("s"), F.sum(m).alias("n"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.try_divide(F.col("s"), F.col("n"))).alias("loss"))
    if not width:
        raise ValueError("the padded width is needed")
    return per.agg((F.sum("s") / F.lit(float(width))).alias("loss"))


def kl_penalty(logp: Column | str, ref: Column | str, kind: str) -> Column:
    """k1 / kl, abs, k2 / mse, k3 / low_var_kl per token."""
    d = _c(logp) - _c(ref)
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return F.lit(0.5) * d * d
    if kind in ("k3", "low_var_kl"):
        r = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(r) - r - 1))
    raise NotImplementedError(f"KL penalty {kind!r}")


def apply_kl(df: DataFrame, beta: float, kind: str = "kl", reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Token rewards minus beta * KL * mask."""
    return df.withColumn("kl", kl_penalty("logp", "ref", kind) * F.col(mask).cast("double")).withColumn("token_reward", F.col(reward) - F.lit(beta) * F.col("kl"))


def current_kl(df: DataFrame, kind: str = "kl", mask: str = "mask", seq: tuple[str, ...] = ("uid", "k")) -> DataFrame:
    """Mean over sequences of their masked mean KL, in one row."""
    per = df.groupBy(*seq).agg(masked_mean(kl_penalty("logp", "ref", kind), mask).alias("m"))
    return per.agg(F.avg("m").alias("current_kl"))


def adaptive_kl(beta: float, steps: list[tuple[float, int]], target: float, horizon: float) -> list[float]:
    """The controller's coefficients after each (current_kl, n_steps): beta grows or shrinks by at most a fifth of n / horizon."""
    out = []
    for kl, n in steps:
        beta *= 1 + max(-0.2, min(0.2, kl / target - 1)) * n / horizon
        out.append(beta)
    return out


def ess_batch(df: DataFrame, ratio: str, mask: str) -> DataFrame:
    """(sum r)^2 / (sum r^2 + 1e-8) / n over the masked ratios, in one row."""
    m = F.col(mask).cast("double")
    one = df.agg(F.sum(F.col(ratio) * m).alias("s"), F.sum(F.col(ratio) * F.col(ratio) * m).alias("q"), F.sum(m).alias("n"))
    return one.select(F.coalesce(F.try_divide(F.pow("s", F.lit(2.0)) / (F.col("q") + EPS), F.col("n")), F.lit(0.0)).alias("ess"))


def ess_sequence(df: DataFrame, ratio: str, mask: str, cap: float = 100.0, seq: tuple[str, ...] = ("uid", "k")) -> DataFrame:
    """The same per sequence with ratios capped; a sequence without tokens has 1."""
    r, m = F.least(F.col(ratio), F.lit(cap)), F.col(mask).cast("double")
    per = df.groupBy(*seq).agg(F.sum(r * m).alias("s"), F.sum(r * r * m).alias("q"), F.sum(m).alias("n"))
    return per.select(*seq, F.when(F.col("n") > 0, F.try_divide(F.pow("s", F.lit(2.0)) / (F.col("q") + EPS), F.col("n"))).otherwise(1.0).alias("ess"))


#: Fixed bin edges of the ratio and of its logarithm; the middle bin of the logarithm is closed at both ends.
RATIO_EDGES, LOG_RATIO_EDGES = (0.5, 1.0, 1.5, 2.0), (-0.7, -0.2, 0.2, 0.7)


def ratio_histogram(df: DataFrame, ratio: str, mask: str, log: bool = False) -> DataFrame:
    """One row: min, max, mean and the counts of five uneven bins of the ratio (or of its logarithm); zeros if nothing is masked in."""
    v = F.when(F.col(mask), F.ln(F.col(ratio)) if log else F.col(ratio))
    e = LOG_RATIO_EDGES if log else RATIO_EDGES
    upper = (v <= e[2], v > e[2], v <= e[3], v > e[3]) if log else (v < e[2], v >= e[2], v < e[3], v >= e[3])
    bins = (v < e[0], (v >= e[0]) & (v < e[1]), (v >= e[1]) & upper[0], upper[1] & upper[2], upper[3])
    zero = F.lit(0.0)
    return df.agg(F.coalesce(F.min(v), zero).alias("ratio_min"), F.coalesce(F.max(v), zero).alias("ratio_max"), F.coalesce(F.avg(v), zero).alias("ratio_mean"), *(F.count_if(b).alias(f"bin_{i}") for i, b in enumerate(bins)))


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Per metric: the maximum if its name holds "max", else the minimum if it holds "min", else the mean."""
    how = F.when(F.contains(F.col(name), F.lit("max")), F.max(value)).when(F.contains(F.col(name), F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(how.alias(value))


def data_metrics(df: DataFrame, columns: list[str], max_length: int | None = None, length: str = "length") -> DataFrame:
    """One row of mean / max / min per column, and the share of responses cut at the maximal length."""
    out = [f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.avg, F.max, F.min)]
    clip = [F.avg((F.col(length) == max_length).cast("double")).alias("clip_ratio")] if max_length is not None else []
    return df.agg(*out, *clip)


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    """1 - var(returns - values) / (var(returns) + 1e-5), sample variances, in one row."""
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def throughput(tokens: Column | str, seconds: Column | str, devices: int) -> Column:
    return _c(tokens) / (_c(seconds) * F.lit(devices))


def timing_per_token(df: DataFrame) -> DataFrame:
    """(stage, seconds, prompt_tokens, response_tokens) -> milliseconds a token; generation counts response tokens only."""
    tokens = F.when(F.col("stage") == "gen", F.col("response_tokens")).otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    return df.withColumn("ms_per_token", F.try_divide(F.col("seconds") * 1000, tokens))


def positions(df: DataFrame, mask: str = "mask", seq: tuple[str, ...] = ("uid",)) -> DataFrame:
    w = Window.partitionBy(*seq).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("position_id", F.greatest(F.sum(F.col(mask).cast("int")).over(w) - 1, F.lit(0)))


def reverse_cumsum(df: DataFrame, value: str, seq: tuple[str, ...] = ("uid",), out: str = "returns") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*seq).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)))


def until_first(df: DataFrame, is_end: Column, seq: tuple[str, ...] = ("uid",)) -> DataFrame:
    """response_mask: 1 up to and including the first end token."""
    before = F.coalesce(F.sum(is_end.cast("int")).over(Window.partitionBy(*seq).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("response_mask", (before == 0).cast("int"))


def preference_metrics(df: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """One row over sequences (score, reward, chosen_logp, rejected_logp, logit, response_length, prompt_length):
    mean / max / min of scores, rewards and lengths, the clipped shares, and the means of the log-probabilities."""
    spread = [f(c).alias(f"{c}_{n}") for c in ("score", "reward", "response_length", "prompt_length") for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    means = [F.avg(c).alias(c) for c in ("chosen_logp", "rejected_logp", "logit")]
    clips = [F.avg((F.col(c) == top).cast("double")).alias(f"{c}_clip") for c, top in (("response_length", max_response), ("prompt_length", max_prompt))]
    return df.agg(*spread, *means, *clips)


def sequence_means(df: DataFrame, columns: list[Column | str], seq: tuple[str, ...] = ("uid",), mask: str = "mask") -> DataFrame:
    """Per sequence the mean of each column over its masked tokens; null without any."""
    m = F.col(mask).cast("double")
    return df.groupBy(*seq).agg(*(F.try_divide(F.sum(_c(c) * m), F.sum(m)).alias(f"mean_{c if isinstance(c, str) else k}") for k, c in enumerate(columns)))


def slice_moments(df: DataFrame, seq: tuple[str, ...] = ("uid",), low: float = 1e-3, high: float = 10.0) -> DataFrame:
    """One row: mean and (population) variance of the probability and of the clipped ratio over the masked tokens of
    on-policy sequences, of off-policy ones without and with an explanation (prefix, se: a token of it marks the whole
    sequence).  An empty slice has mean and variance 0."""
    w = Window.partitionBy(*seq)
    kinds = df.withColumns({"_off": F.max(F.col("prefix").cast("int")).over(w) == 1, "_se": F.max(F.col("se").cast("int")).over(w) == 1})
    parts = {"on": ~F.col("_off"), "off_standard": F.col("_off") & ~F.col("_se"), "off_se": F.col("_se")}
    values = {"prob": F.exp("logp"), "ratio": F.greatest(F.lit(low), F.least(F.lit(high), F.exp(F.col("logp") - F.col("old"))))}
    m, out = F.col("mask").cast("double"), []
    for name, v in values.items():
        for part, inside in parts.items():
            wt = F.when(inside, m).otherwise(0.0)
            n = F.sum(wt) + EPS
            mean = F.sum(v * wt) / n
            # The mean of squares around the mean, from sums of one pass.
            square = F.sum(v * v * wt) - 2 * mean * F.sum(v * wt) + mean * mean * F.sum(wt)
            out += [mean.alias(f"{name}_{part}_mean"), (square / n).alias(f"{name}_{part}_var")]
    return kinds.agg(*out)


def token_data_metrics(df: DataFrame, max_response: int, max_prompt: int, seq: tuple[str, ...] = ("uid", "k"), use_critic: bool = True) -> DataFrame:
    """All metrics of a batch in one row, from a token table (score, reward, adv, returns, value, mask, prefix,
    prompt_length): mean / max / min of the sequences' summed scores and rewards, of masked advantages, returns and
    values, explained variance, lengths with the share at their limit, and scores and lengths on and off policy.

    Two levels of partial aggregation: sums of a sequence, then of all."""
    m = F.col("mask").cast("int") == 1
    masked = {"advantages": F.col("adv"), "returns": F.col("returns")} | ({"values": F.col("value"), "_d": F.col("returns") - F.col("value")} if use_critic else {})
    sums = [f(F.when(m, v)).alias(f"{f.__name__}_{name}") for name, v in masked.items() for f in (F.sum, F.max, F.min)]
    squares = [F.sum(F.when(m, v * v)).alias(f"sq_{name}") for name, v in masked.items() if name in ("returns", "_d")]
    per = df.groupBy(*seq).agg(
        F.sum("score").alias("score"), F.sum("reward").alias("rewards"), F.count("*").alias("response_length"), F.first("prompt_length").alias("prompt_length"), F.max(F.col("prefix").cast("int")).alias("_off"), F.count_if(m).alias("_n"), *sums, *squares,
    )
    n = F.sum("_n")
    out = [f(c).alias(f"{c}_{name}") for c in ("score", "rewards") for f, name in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    for name in masked:
        if name != "_d":
            out += [F.try_divide(F.sum(f"sum_{name}"), n).alias(f"{name}_mean"), F.max(f"max_{name}").alias(f"{name}_max"), F.min(f"min_{name}").alias(f"{name}_min")]
    if use_critic:
        var = lambda name: F.try_divide(F.sum(f"sq_{name}") - F.pow(F.sum(f"sum_{name}"), F.lit(2.0)) / n, n - 1)
        out.append((1 - var("_d") / (var("returns") + 1e-5)).alias("vf_explained_var"))
    for c, top in (("response_length", max_response), ("prompt_length", max_prompt)):
        out += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.avg((F.col(c) == top).cast("double")).alias(f"{c}_clip_ratio")]
    off = F.col("_off") == 1
    out += [F.avg(F.when(side, F.col(c))).alias(f"{c}_{name}_mean") for c in ("score", "response_length") for side, name in ((~off, "on"), (off, "off"))]
    return per.agg(*out, F.try_divide(F.count_if(off), F.count_if(~off)).alias("off_on_example_ratio"))


def off_policy_ratio_stats(df: DataFrame, batch: str, seq: tuple[str, ...] = ("uid", "k"), low: float = -20.0, high: float = 10.0) -> DataFrame:
    """Per mini-batch with off-policy sequences (any prefix token): masked mean, unbiased variance and effective sample
    share of the ratio, whose logarithm is clamped."""
    off = df.withColumn("_off", F.max(F.col("prefix").cast("int")).over(Window.partitionBy(*seq))).filter("_off = 1")
    r, m = F.exp(F.greatest(F.lit(low), F.least(F.lit(high), F.col("logp") - F.col("old")))), F.col("mask").cast("double")
    per = off.groupBy(batch).agg(F.sum(r * m).alias("_s"), F.sum(r * r * m).alias("_q"), F.sum(m).alias("_n"))
    mean = F.col("_s") / (F.col("_n") + EPS)
    around = (F.col("_q") - 2 * mean * F.col("_s") + mean * mean * F.col("_n")) / (F.col("_n") + EPS)
    ess = F.coalesce(F.try_divide(F.col("_s") * F.col("_s") / (F.col("_q") + EPS), F.col("_n")), F.lit(0.0))
    return per.select(batch, mean.alias("ratio_mean"), F.when(F.col("_n") > 1, around * F.try_divide(F.col("_n"), F.col("_n") - 1)).alias("ratio_var"), ess.alias("ratio_ess"))
