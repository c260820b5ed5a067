"""Column builders over token arrays and number ranges.  Every builder is null-safe on empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hashed_unit


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def linspace(n: int, power: float = 1.0) -> Column:
    """n numbers from 0 to 1, raised to a power; a single one is 0."""
    if n < 1:
        raise ValueError("n must be positive")
    return F.array(*[F.lit((i / (n - 1)) ** power if n > 1 else 0.0) for i in range(n)])


def searchsorted(values: Column | str, x: Column) -> Column:
    """Index of the first element that is not below x (left side)."""
    return F.size(F.filter(_col(values), lambda v: v < x))


def pad(values: Column | str, length: int, fill, left: bool = False) -> Column:
    v = _col(values)
    missing = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(v)))
    return F.concat(missing, v) if left else F.concat(v, missing)


def truncate(values: Column | str, length: int, how: str = "right") -> Column:
    """Cuts to a length: ``left`` keeps the end, ``right`` the beginning, ``middle`` both ends, ``error`` raises."""
    v = _col(values)
    size = F.size(v)
    if how == "right":
        cut = F.slice(v, 1, length)
    elif how == "left":
        cut = F.slice(v, -length, length)
    elif how == "middle":
        head = length // 2
        cut = F.concat(F.slice(v, 1, head), F.slice(v, -(length - head), length - head))
    elif how == "error":
        cut = F.when(size > length, F.raise_error(F.lit(f"sequence longer than {length}")))
        return F.when(size <= length, v).otherwise(cut)
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(size <= length, v).otherwise(cut)


def remove_left_padding(values: Column | str, fill) -> Column:
    v = _col(values)
    first = F.array_position(F.transform(v, lambda x: (x != F.lit(fill)).cast("int")), 1)
    return F.when(first > 0, F.slice(v, first.cast("int"), F.size(v))).otherwise(F.slice(v, 1, 0))


def remove_right_padding(values: Column | str, fill) -> Column:
    return F.reverse(remove_left_padding(F.reverse(_col(values)), fill))


def position_ids(mask: Column | str) -> Column:
    """max(running sum of the mask - 1, 0) per position."""
    m = _col(mask)
    return F.transform(m, lambda _, i: F.greatest(F.aggregate(F.slice(m, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1, F.lit(0)))


def response_mask(ids: Column | str, *eos: int) -> Column:
    """1 up to and including the first end token."""
    v = _col(ids)
    ends = F.transform(v, lambda x: x.isin(*eos).cast("int"))
    first = F.array_position(ends, 1)
    return F.transform(v, lambda _, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def tail_mask(mask: Column | str, length: int) -> Column:
    """The last ``length`` entries, fewer if there are fewer."""
    m = _col(mask)
    return F.slice(m, F.greatest(F.size(m) - length + 1, F.lit(1)), F.lit(length))


def last_token_reward(length: Column | str, score: Column | str) -> Column:
    """array<double> of the given length, zero but for the score at its end."""
    n = _col(length)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.when(p == n - 1, _col(score).cast("double")).otherwise(F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def sft_loss_mask(prompt_len: Column | str, response_len: Column | str) -> Column:
    """Mask over prompt + response: the prompt's tokens but its last are 0, and so is the response's last token."""
    p, r = _col(prompt_len), _col(response_len)
    return F.transform(F.sequence(F.lit(0), p + r - 1), lambda i: F.when((i >= p - 1) & (i < p + r - 1), 1).otherwise(0))


def prefix_ratios(kind: str, n: int) -> Column:
    """Schedules of target prefixes over a prompt's samples: sparse (all zero but the last) or linear."""
    if kind == "sparse":
        return F.array(*[F.lit(1.0 if i == n - 1 else 0.0) for i in range(n)])
    if kind == "linear":
        return linspace(n)
    raise ValueError(f"unknown schedule {kind!r}")


def hybrid_response(target: Column | str, generated: Column | str, keep: Column | str) -> tuple[Column, Column]:
    """(tokens, prefix mask): the target's first ``keep`` tokens, then what was generated unless all is kept."""
    t, g, k = _col(target), _col(generated), F.least(_col(keep), F.size(_col(target)))
    tokens = F.when(k >= F.size(t), F.slice(t, 1, k)).otherwise(F.concat(F.slice(t, 1, k), g))
    return tokens, F.transform(tokens, lambda _, i: i < k)


def l2_normalize(v: Column | str) -> Column:
    x = _col(v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    return F.transform(x, lambda y: F.coalesce(F.try_divide(y.cast("double"), norm), F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def discounted_returns(rewards: Column | str, gamma: float) -> Column:
    """R_t = r_t + gamma R_{t+1} as a fold from the end.

    Each step appends to an array, which copies it: for thousands of tokens a sequence the long form
    (``stats.reverse_cumsum`` and windows) is the way.
    """
    r = _col(rewards)
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        now = x.cast("double") + F.lit(gamma) * acc["a"]
        return F.struct(now.alias("a"), F.array_append(acc["o"], now).alias("o"))

    return F.reverse(F.aggregate(F.reverse(r), start, step, lambda acc: acc["o"]))


def gae(rewards: Column | str, values: Column | str, gamma: float, lam: float) -> Column:
    """Generalised advantages (not whitened): reverse fold of delta + gamma * lambda * A; the mask plays no part."""
    pairs = F.reverse(F.arrays_zip(_col(rewards).alias("r"), _col(values).alias("v")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        now = x["r"].cast("double") + F.lit(gamma) * acc["v"] - x["v"].cast("double") + F.lit(gamma * lam) * acc["a"]
        return F.struct(now.alias("a"), x["v"].cast("double").alias("v"), F.array_append(acc["o"], now).alias("o"))

    return F.reverse(F.aggregate(pairs, start, step, lambda acc: acc["o"]))


def ratio_window(step: int, steps: int, largest: float, kind: str) -> tuple[float, float]:
    """Range of a prefix ratio at a training step: ten windows of falling (linear_max) or rising (reverse_linear) width.

    A step on a border belongs to the earlier window, one beyond all to the last.
    """
    at = next((i for i in range(10) if i * steps / 10 <= step <= (i + 1) * steps / 10), 9)
    if kind == "linear_max":
        return 0.0, (10 - at) * largest / 10
    if kind == "reverse_linear":
        return 0.0, (at + 1) * largest / 10
    if kind == "linear":
        fixed = largest * (1 - min(step / steps, 1.0))
        return fixed, fixed
    raise ValueError(f"unknown schedule {kind!r}")


def sampled_ratio(key: Column | str, low: float, high: float, seed: int = 0) -> Column:
    """A ratio in [low, high) by a hash of the key."""
    return F.lit(low) + hashed_unit(key, str(seed)) * F.lit(high - low)


def prefix_ratio(key: Column | str, place: Column | str, with_prefix: int, low: float, high: float, seed: int = 0, shared: bool = False) -> Column:
    """Ratio of a prompt's sample at ``place``: drawn for the first ``with_prefix`` samples (one for all of them if shared),
    0 for the others."""
    k, i = _col(key).cast("string"), _col(place)
    drawn = sampled_ratio(k if shared else F.concat_ws(":", k, i.cast("string")), low, high, seed)
    return F.when(i < with_prefix, drawn).otherwise(0.0)


def fixed_ratios(n: int, low: float, high: float) -> list[float]:
    """n ratios in equal steps from low to high."""
    return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]


def off_policy_prompt(prompt: Column | str, target: Column | str, keep: Column, width: int, fill: int, end: int | None = None) -> Column:
    """Prompt, then the target's first ``keep`` tokens (and the end token if all are kept), left-padded to a width."""
    t = _col(target)
    head = F.slice(t, F.lit(1), F.least(keep, F.size(t)))
    if end is not None:
        head = F.when(keep >= F.size(t), F.concat(head, F.array(F.lit(end)))).otherwise(head)
    return pad(F.concat(_col(prompt), head), width, fill, left=True)


def token_split_prefixes(points: Column | str, n: int) -> Column:
    """Prefix lengths for n samples from split points; a single point serves all."""
    p = _col(points)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.get(p, i)))


def off_policy_output(prompt: Column | str, response: Column | str, prompt_width: int, response_width: int, fill: int) -> dict[str, Column]:
    """Arrays of a sample whose whole response was given: prompts filled (or cut) on the left and responses on the right, both
    joined, attention_mask, position_ids, and prefix_mask and se_mask, true on all of the response's tokens."""
    p = pad(F.slice(_col(prompt), F.greatest(F.size(_col(prompt)) - prompt_width + 1, F.lit(1)), F.lit(prompt_width)), prompt_width, fill, left=True)
    r = pad(F.slice(_col(response), F.lit(1), F.lit(response_width)), response_width, fill)
    n_p, n_r = F.least(F.size(_col(prompt)), F.lit(prompt_width)), F.least(F.size(_col(response)), F.lit(response_width))
    flags = lambda n, width: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < n)
    left = F.transform(F.sequence(F.lit(0), F.lit(prompt_width - 1)), lambda i: i >= prompt_width - n_p)
    attention = F.concat(left, flags(n_r, response_width))
    # A place's position counts the tokens before it; places before the first token have 0, those after the last go on.
    positions = F.transform(F.sequence(F.lit(0), F.lit(prompt_width + response_width - 1)), lambda i: F.greatest(i - (prompt_width - n_p), F.lit(0)))
    return {"prompts": p, "responses": r, "input_ids": F.concat(p, r), "attention_mask": F.transform(attention, lambda x: x.cast("int")), "position_ids": positions, "prefix_mask": flags(n_r, response_width), "se_mask": flags(n_r, response_width)}
