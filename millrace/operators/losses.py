"""Policy-gradient, supervised and preference losses as column arithmetic over token tables (long form).

Columns of a token table: old, logp (log-probabilities before and now), adv, mask (response), and for mixed
batches prefix (off-policy token), se, reward_mask.  A loss is one pass: per-token expressions, then one
aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import Registry
from .selection import at_or_above, kth_largest
from .stats import EPS, agg_loss, ess_sequence, masked_mean

POLICY_LOSSES = Registry("policy loss")


def clamp(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    x = x if hi is None else F.least(x, hi if isinstance(hi, Column) else F.lit(hi))
    return x if lo is None else F.greatest(x, lo if isinstance(lo, Column) else F.lit(lo))


def log_ratio(bound: float = 20.0) -> Column:
    return clamp(F.col("logp") - F.col("old"), -bound, bound)


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def _clipped(ratio: Column, low: float, high: float, dual: float | None) -> dict[str, Column]:
    plain = -F.col("adv") * ratio
    cut = -F.col("adv") * clamp(ratio, low, high)
    worse = F.greatest(plain, cut)
    floor = -F.col("adv") * F.lit(dual) if dual else worse
    return {"plain": plain, "cut": cut, "worse": worse, "floor": floor, "loss": F.when(F.col("adv") < 0, F.least(floor, worse)).otherwise(worse)}


@POLICY_LOSSES.register("vanilla", "ppo")
def ppo_loss(df: DataFrame, clip: float = 0.2, low: float | None = None, high: float | None = None, dual: float = 3.0, mode: str = "token-mean", **shape) -> DataFrame:
    """One row: loss, clipfrac, ppo_kl, clipfrac_lower and the contributions of positive and negative advantages."""
    if dual <= 1.0:
        raise ValueError("the dual clip bound must exceed 1")
    c = _clipped(F.exp(log_ratio()), 1 - (clip if low is None else low), 1 + (clip if high is None else high), dual)
    tokens = df.withColumns({
        "_loss": c["loss"], "_kl": -log_ratio(), "_clip": (c["cut"] > c["plain"]).cast("double"),
        "_low": ((c["worse"] > c["floor"]) & (F.col("adv") < 0)).cast("double"),
    })
    m = _num("mask")
    denom = F.greatest(F.sum(m), F.lit(1.0))
    side = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_loss") * m)), F.lit(0.0)) / denom
    stats = tokens.agg(masked_mean("_clip", "mask").alias("clipfrac"), masked_mean("_kl", "mask").alias("ppo_kl"), masked_mean("_low", "mask").alias("clipfrac_lower"), side(F.col("adv") > 0).alias("pos_contrib"), side(F.col("adv") < 0).alias("neg_contrib"))
    return agg_loss(tokens, "_loss", "mask", mode, **shape).join(F.broadcast(stats))  # one row each


def _covariances(df: DataFrame, share: float) -> tuple[DataFrame, int]:
    """_cov of advantage and log-probability over the masked tokens, and how many of them a share is (at least one).
    The moments are one row."""
    on = F.col("mask").cast("int") == 1
    one = df.agg(F.avg(F.when(on, F.col("adv"))).alias("a"), F.avg(F.when(on, F.col("logp"))).alias("l"), F.greatest(F.lit(1), F.floor(F.count_if(on) * share)).alias("cut")).first()
    cov = (F.col("adv") - F.lit(one["a"])) * (F.col("logp") - F.lit(one["l"]))
    return df.withColumn("_cov", F.when(on, cov)), int(one["cut"])


@POLICY_LOSSES.register("kl_cov")
def kl_cov_loss(df: DataFrame, share: float = 0.2, weight: float = 1.0) -> DataFrame:
    """Plain ratio loss; the tokens with the highest covariance of advantage and log-probability (a share of the
    masked ones, at least one; ties by uid, k, pos) get weight * |log ratio| on top.  The cut is found by selection."""
    tokens, cut = _covariances(df, share)
    last = kth_largest(tokens, cut, "_cov", "uid", "k", "pos")
    tokens = tokens.withColumns({"_base": -F.col("adv") * F.exp(F.col("logp") - F.col("old")), "_abs": F.abs(F.col("logp") - F.col("old"))})
    top = at_or_above(last, "_cov", "uid", "k", "pos").cast("double")
    return tokens.withColumn("_loss", F.col("_base") + top * weight * F.col("_abs")).agg(masked_mean("_loss", "mask").alias("loss"), masked_mean("_abs", "mask").alias("mean_abs_kl"))


@POLICY_LOSSES.register("clip_cov")
def clip_cov_loss(df: DataFrame, share: float = 0.0002, lb: float = 1.0, ub: float = 5.0, clip: float = 0.2, seed: str = "clip-cov") -> DataFrame:
    """The clipped loss, with the loss of a hash-chosen share of tokens whose covariance lies between the bounds set to zero.

    Tokens that are clipped anyway can't be chosen; the choice is by MD5, so that reruns and other engines agree."""
    c = _clipped(F.exp(F.col("logp") - F.col("old")), 1 - clip, 1 + clip, None)
    tokens, cut = _covariances(df, share)
    tokens = tokens.withColumns({"_worse": c["worse"], "_clip": c["cut"] > c["plain"]})
    free = F.coalesce((F.col("_cov") > lb) & (F.col("_cov") < ub) & ~F.col("_clip"), F.lit(False))
    tokens = tokens.withColumn("_hash", F.when(free, F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in ("uid", "k", "pos"))))))
    # The smallest hashes: largest negative of their first 52 bits, then by the whole hash.
    tokens = tokens.withColumn("_first", -F.conv(F.substring("_hash", 1, 13), 16, 10).cast("double"))
    chosen = at_or_above(kth_largest(tokens, cut, "_first", "_hash", "uid", "k", "pos"), "_first", "_hash", "uid", "k", "pos")
    return tokens.withColumn("_loss", F.when(chosen, 0.0).otherwise(F.col("_worse"))).agg(masked_mean("_loss", "mask").alias("loss"))


def value_loss(df: DataFrame, clip: float, mode: str = "token-mean") -> DataFrame:
    """Half the larger of the plain and the clipped squared error (columns value, new_value, returns), with the clipped share."""
    cut = clamp(F.col("new_value"), F.col("value") - clip, F.col("value") + clip)
    plain, clipped = F.pow(F.col("new_value") - F.col("returns"), 2), F.pow(cut - F.col("returns"), 2)
    tokens = df.withColumns({"_loss": 0.5 * F.greatest(plain, clipped), "_clip": (clipped > plain).cast("double")})
    return agg_loss(tokens, "_loss", "mask", mode).join(F.broadcast(tokens.agg(masked_mean("_clip", "mask").alias("clipfrac"))))


def sft_loss(df: DataFrame) -> DataFrame:
    return df.withColumn("_nll", -F.col("logp")).agg(masked_mean("_nll", "mask").alias("loss"))


# -- mixed on- and off-policy batches ------------------------------------------------------------------


def _prob() -> Column:
    return F.exp(F.col("logp"))


def _div(x: Column, a: float) -> Column:
    return x / (x + F.lit(a))


def off_ratio(strategy: str, reshape: str) -> Column:
    """Importance weight of an off-policy token.  ``_ess`` (per sequence) is joined by the caller for ``sequence``."""
    p, r, old = _prob(), F.exp(log_ratio()), F.exp(F.col("old"))
    if strategy == "no_reshape":
        return p
    if strategy == "rlpluss":
        return 2 * p / (old + 0.5 * (old + 1))
    if strategy == "luffy":
        floor = F.when(old > 0.9, 1.0).otherwise(clamp(old, lo=0.1))
        table = {"no_reshape": p, "p_div_p_0.1": _div(p, 0.1), "dft": p / floor, "masked_sft": F.col("logp") * (p > 0.1).cast("double"), "sft": F.col("logp")}
        return table.get(reshape, _div(p, 0.1))
    if strategy in ("se", "se_filter"):
        table = {
            "sequence": r * F.col("_ess"), "p_div_p_0.1": _div(r, 0.1), "rlpluss": p * F.sqrt(1 - p), "vanilla": r, "filter": r * _num("reward_mask"),
            "cispo": r * _num("reward_mask") * F.col("logp"), "luffy": _div(p, 0.1), "se_shaping": _div(r, 0.1), "se_rlpluss": r * F.sqrt(1 - p),
            "dynamic_clip": F.least(r, F.greatest(1 / (p + 1e-8), F.lit(1.2))), "dft": p * F.col("logp"),
        }
        return table.get(reshape, r)
    if strategy == "se_luffy":
        return r * F.col("_ess") * _num("se") + _div(r, 0.1) * (1 - _num("se")) if reshape == "sequence" else p
    raise ValueError(f"unknown off-policy strategy {strategy!r}")


def on_off_policy_loss(df: DataFrame, strategy: str = "luffy", reshape: str = "p_div_p_0.1", clip: float = 0.2, low: float | None = None, high: float | None = None, off_max: float | None = None, off_min: float | None = None, all_max: float | None = None, remove_clip: bool = False, target_prob: str | None = None) -> DataFrame:
    """One row: loss, on_loss, off_loss, on_clipfrac, ppo_kl, mean ratios and probabilities, and the clipped shares of off-policy ratios."""
    if target_prob is None and reshape == "sequence" and strategy in ("se", "se_filter", "se_luffy"):
        both = df.withColumns({"_r": F.exp(log_ratio()), "_pm": _num("prefix") * _num("mask")})
        df = both.join(ess_sequence(both, "_r", "_pm").withColumnRenamed("ess", "_ess"), ["uid", "k"])
    r = F.exp(log_ratio())
    c = _clipped(r, 1 - (clip if low is None else low), max(1 + (clip if high is None else high), 1 + clip), 3.0)
    on = c["plain"] if remove_clip else c["loss"]
    w = off_ratio(strategy, reshape) if target_prob is None else _prob() / (F.col(target_prob) + 1e-6) * _num("prefix")
    if off_max is not None:
        w = clamp(w, hi=off_max)
    if off_min is not None:
        w = clamp(w, lo=off_min)
    if strategy == "rlpluss":
        off = -w * F.col("adv") * F.sqrt(1 - _prob())
    elif strategy in ("se", "se_filter", "luffy"):
        off = -w if reshape in ("masked_sft", "dft", "sft") else -w * clamp(F.col("adv"), lo=0.0)
    else:
        off = -w * F.col("adv")
    pre, m, rm = _num("prefix"), _num("mask"), _num("reward_mask")
    tokens = df.withColumns({"_on": on, "_off": off, "_w": w, "_r": r, "_p": _prob(), "_oldp": F.exp(F.col("old")), "_kl": -log_ratio(), "_clip": (c["cut"] > c["plain"]).cast("double"), "_offm": pre * m, "_onm": (1 - pre) * m})
    keep = (F.col("_p") <= all_max).cast("double") if all_max is not None else F.lit(1.0)
    tokens = tokens.withColumns({"_loss": (F.col("_off") * pre * rm + F.col("_on") * (1 - pre) * rm) * keep, "_m": m * keep})
    share = lambda at: masked_mean((F.col("_w") == at).cast("double"), "_offm") if at is not None else F.lit(0.0)
    return tokens.agg(
        masked_mean("_loss", "_m").alias("loss"), masked_mean("_on", "_onm").alias("on_loss"), masked_mean("_off", "_offm").alias("off_loss"),
        (F.lit(0.0) if remove_clip else masked_mean("_clip", "mask")).alias("on_clipfrac"), masked_mean("_kl", "mask").alias("ppo_kl"),
        masked_mean("_p", "_offm").alias("off_prob"), masked_mean("_oldp", "_onm").alias("on_prob"), masked_mean("_w", "_offm").alias("off_ratio"), masked_mean("_r", "_onm").alias("on_ratio"),
        share(off_max).alias("off_max_clipfrac"), share(off_min).alias("off_min_clipfrac"),
    )


def sft_weight(reshape: str, threshold: float = 0.2, tau: float = 0.01) -> tuple[Column, Column]:
    """(supervised part, reinforcement part) of an off-policy token's loss."""
    lp, p, adv, zero = F.col("logp"), _prob(), F.col("adv"), F.lit(0.0)
    if reshape == "high_mask":
        return -lp * (p > 0.9).cast("double"), zero
    if reshape == "low_mask":
        return -lp * (p < 0.1).cast("double"), zero
    if reshape == "low_sft_other_rl":
        gate = 1 / (1 + F.exp(-(F.lit(threshold) - p) / F.lit(max(tau, 1e-6))))
        return -gate * clamp(adv, lo=0.0) * p, -(1 - gate) * adv * p
    if reshape == "reweight_f":
        return -lp * F.col("weight"), zero
    if reshape == "sft_clip_adv":
        return -lp * clamp(adv, lo=0.0), zero
    if reshape == "weighted_sft":
        return -clamp(p / 0.5, hi=1.0) * lp, zero
    return -lp, zero  # vanilla and all else


def on_off_sft_loss(df: DataFrame, strategy: str = "rl-sft", reshape: str = "vanilla", clip: float = 0.2, mask_negative: bool = False, threshold: float = 0.2, tau: float = 0.01, low: float | None = None, high: float | None = None, remove_clip: bool = False, all_max: float | None = None) -> DataFrame:
    """One row: loss = 0.4 off + 0.6 on, with the shares of either side and of the supervised part.

    ``all_max`` leaves tokens above that probability out of the contributions and shares, not out of the loss."""
    kinds = {"rl-sft": "rl", "sft-sft": "sft", "none-sft": "none"}
    if strategy not in kinds:
        raise ValueError(f"unknown strategy {strategy!r}")
    adv, pre, m, rm = F.col("adv"), _num("prefix"), _num("mask"), _num("reward_mask")
    sides = _clipped(F.exp(log_ratio()), 1 - (clip if low is None else low), max(1 + (clip if high is None else high), 1 + clip), 3.0)
    on = {"rl": sides["plain"] if remove_clip else sides["loss"], "sft": -F.col("logp") * (adv > 0).cast("double"), "none": F.lit(0.0)}[kinds[strategy]]
    live = (adv >= 0).cast("double") if mask_negative and strategy == "rl-sft" else F.lit(1.0)
    sft, rl = sft_weight(reshape, threshold, tau)
    tokens = df.withColumns({"_on": on * live * (1 - pre) * rm, "_sft": sft * pre * rm, "_rl": rl * pre * rm, "_onm": (1 - pre) * m * rm * ((adv >= 0).cast("double") if mask_negative else F.lit(1.0)), "_offm": pre * m * rm, "_kl": -log_ratio(), "_low": (F.exp(F.col("old")) < threshold).cast("double")})
    tokens = tokens.withColumn("_off", F.col("_sft") + F.col("_rl"))
    keep = (_prob() <= all_max).cast("double") if all_max is not None else F.lit(1.0)
    tokens = tokens.withColumn("_keep", keep)
    denom = F.greatest(F.sum(m * rm * F.col("_keep")), F.lit(1.0))
    part = lambda c: F.sum(F.col(c) * F.col("_keep")) / denom
    one = tokens.agg(
        masked_mean("_off", "_offm").alias("off_loss"), masked_mean("_on", "_onm").alias("on_loss"), masked_mean("_kl", "mask").alias("ppo_kl"),
        part("_on").alias("on_contrib"), part("_off").alias("off_contrib"), part("_sft").alias("off_sft_contrib"), part("_rl").alias("off_rl_contrib"),
        (F.sum(F.col("_low") * F.col("_offm")) / F.greatest(F.sum("_offm"), F.lit(1.0))).alias("off_low_conf_share"),
    )
    both = F.greatest(F.abs("on_contrib") + F.abs("off_contrib"), F.lit(1e-8))
    return one.withColumns({"loss": 0.4 * F.col("off_loss") + 0.6 * F.col("on_loss"), "on_share": F.abs("on_contrib") / both, "off_share": F.abs("off_contrib") / both})


def luffy_loss(df: DataFrame, on_reshape: str = "no_reshape", off_reshape: str = "no_reshape", clip: float = 0.2, upper: float = 1.2, on_weight: float = 1.0, off_weight: float = 1.0, on_pow: float = 0.5, off_pow: float = 0.5, off_max: float | None = None, off_min: float | None = None) -> DataFrame:
    """Mixed loss with reshaped ratios on both sides: one row loss, on_loss, off_loss, on_clipfrac, off_ratio."""
    d, p, old = F.col("logp") - F.col("old"), _prob(), F.exp(F.col("old"))
    on_table = {"no_reshape": F.exp(d), "logp": d, "p_logp": F.exp(d) + on_weight * d, "square_root": F.sqrt(F.exp(d)), "pow": F.pow(F.exp(d), F.lit(on_pow)), "p_div_p_0.1": _div(p, 0.1) / _div(old, 0.1), "p_div_p_0.5": _div(p, 0.5) / _div(old, 0.5)}
    off_table = {"no_reshape": p, "logp": F.col("logp") * off_weight, "p_logp": F.col("logp") * off_weight + p, "square_root": F.sqrt(p), "p_div_p_0.1": _div(p, 0.1), "p_div_p_0.3": _div(p, 0.3), "p_div_p_0.5": _div(p, 0.5), "pow": F.pow(p, F.lit(off_pow))}
    for name, known in ((on_reshape, on_table), (off_reshape, off_table)):
        if name not in known:
            raise ValueError(f"unknown reshape {name!r}")
    c = _clipped(on_table[on_reshape], 1 - clip, max(upper, 1 + clip), None)
    w = clamp(off_table[off_reshape], off_min, off_max)
    pre, m = _num("prefix"), _num("mask")
    tokens = df.withColumns({"_on": c["worse"], "_off": -F.col("adv") * w, "_w": w, "_clip": (c["cut"] > c["plain"]).cast("double"), "_offm": pre * m, "_onm": (1 - pre) * m})
    tokens = tokens.withColumn("_loss", F.col("_off") * pre + F.col("_on") * (1 - pre))
    return tokens.agg(masked_mean("_loss", "mask").alias("loss"), masked_mean("_on", "_onm").alias("on_loss"), masked_mean("_off", "_offm").alias("off_loss"), masked_mean("_clip", "mask").alias("on_clipfrac"), masked_mean("_w", "_offm").alias("off_ratio"))


# -- preferences ---------------------------------------------------------------------------------------


def log_sigmoid(x: Column) -> Column:
    """-ln(1 + exp(-x)) without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(kind: str = "sigmoid", beta: float = 0.1, smoothing: float = 0.0, margin: str = "margin") -> Column:
    """Per pair, from the policy's log-ratio margin over the reference's: sigmoid (smoothed) or ipo."""
    x = F.col(margin)
    if kind == "sigmoid":
        return -log_sigmoid(beta * x) * (1 - smoothing) - log_sigmoid(-beta * x) * smoothing
    if kind == "ipo":
        return F.pow(x - 1 / (2 * beta), F.lit(2.0))
    raise ValueError(f"unknown preference loss {kind!r}")


def sppo_loss(eta: float = 1.0, reward: str = "reward") -> Column:
    """Squared distance of the sequence's log ratio from eta * reward."""
    return F.pow(F.col("log_ratio") - eta * F.col(reward), F.lit(2.0))


def sppo_batch_loss(df: DataFrame, rewards: DataFrame, eta: float = 1.0, seq: tuple[str, ...] = ("uid", "k")) -> DataFrame:
    """One row: mean of :func:`sppo_loss` over the sequences with any masked token, from a token table and a reward per
    sequence; mean log ratio and mean scaled reward beside it."""
    m = _num("mask")
    per = df.groupBy(*seq).agg((F.sum(F.col("logp") * m) - F.sum(F.col("old") * m)).alias("log_ratio"), F.max(m).alias("_any")).join(rewards, list(seq))
    return per.agg((F.sum(sppo_loss(eta) * F.col("_any")) / (F.sum("_any") + EPS)).alias("loss"), F.avg("log_ratio").alias("mean_log_ratio"), F.avg(eta * F.col("reward")).alias("mean_scaled_reward"))


def sequence_logp(logps, labels, average: bool = False, ignore: int = -100) -> Column:
    """Sum (or mean) of an array of token log-probabilities where the label isn't ignored."""
    live = F.filter(F.arrays_zip(F.col(logps).alias("p"), F.col(labels).alias("l")), lambda t: t["l"] != ignore)
    total = F.aggregate(live, F.lit(0.0), lambda a, t: a + t["p"])
    return F.try_divide(total, F.size(live)) if average else total


def entropy(logits: Column | str) -> Column:
    """Entropy of a softmax over an array of logits: logsumexp minus the expected logit."""
    x = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(x)
    z = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    expected = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top) * v) / z
    return top + F.ln(z) - expected


def logprob_at(logits: Column | str, label: Column | str) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    lab = F.col(label) if isinstance(label, str) else label
    top = F.array_max(x)
    return F.element_at(x, (lab + 1).cast("int")) - (top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def ce_dpo_loss(df: DataFrame, beta: float = 0.05) -> DataFrame:
    """Cross-entropy of acc against sigmoid(beta * q), q the sequence's summed log ratio: one row loss."""
    p = 1 / (1 + F.exp(-beta * F.col("q")))
    return df.agg(F.avg(-(F.col("acc") * F.ln(p) + (1 - F.col("acc")) * F.ln(1 - p))).alias("loss"))


def detach_dpo_loss(df: DataFrame, beta: float = 0.05, mode: str = "none") -> DataFrame:
    """One row loss over sequences (uid, q, acc): each q against the mean q of the group's samples on the other side.

    Modes none (mean), bon_acc and bon_rm (summed with weights n * share(not better)^(n - 1)).  One window a group.
    """
    group = Window.partitionBy("uid")
    success = F.when(F.col("acc") > 0, 1.0)
    n = F.count("*").over(group)
    # acc is 0 or 1, so the samples below a success are the failures, and those above a failure the successes.
    mean_of = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("q"))).over(group), F.lit(0.0))
    other = F.when(success.isNotNull(), mean_of(F.col("acc") <= 0)).otherwise(mean_of(F.col("acc") > 0))
    loss = -log_sigmoid((F.col("q") - other) * beta * F.when(success.isNotNull(), 1.0).otherwise(-1.0))
    if mode == "none":
        return df.select(loss.alias("_l")).agg(F.avg("_l").alias("loss"))
    if mode not in ("bon_acc", "bon_rm"):
        raise NotImplementedError(mode)
    by = "acc" if mode == "bon_acc" else "q"
    share = F.cume_dist().over(group.orderBy(by))
    return df.select((loss * n * F.pow(share, n - 1)).alias("_l")).agg(F.sum("_l").alias("loss"))


def sign_accuracy(df: DataFrame) -> DataFrame:
    """Share of sequences whose q has the sign of 2 acc - 1, in one row."""
    return df.agg(F.avg((F.signum("q") == F.signum(F.col("acc") * 2 - 1)).cast("double")).alias("accuracy"))
