"""Multi-turn requests: turn scores of an interaction, finalised token arrays, search and tool turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import gsm_flexible


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def turn_score(content: Column | str, truth: Column | str) -> Column:
    """struct<response, reward, terminate> of an interaction's last user turn: the content is read as an answer after
    ``#### ``, its last number is compared with the truth, and a right one ends the dialogue.  Fixed texts."""
    c = F.coalesce(_c(content), F.lit(""))
    answer = F.when(F.startswith(c, F.lit("#### ")), c).otherwise(F.concat(F.lit("#### "), c))
    right = F.coalesce(gsm_flexible(answer) == _c(truth), F.lit(False))
    text = F.when(right, "Your response is correct!").otherwise("Your response is incorrect! You need to reflect on your answer and try again.")
    return F.struct(text.alias("response"), right.cast("double").alias("reward"), right.alias("terminate"))


def finalised(df: DataFrame, max_model_len: int, max_response_len: int, generation_prompt: list[int], prompt: str = "prompt_ids", ids: str = "input_ids", others: tuple[str, ...] = ("attention_mask", "position_ids", "loss_mask")) -> DataFrame:
    """Token arrays of a finished request: a generation prompt that nothing followed goes from the end, all arrays are
    cut to the model's length, and response_ids (and response_<other>) are what follows the prompt, cut to its length.

    Arrays of different lengths are an error."""
    n = len(generation_prompt)
    tail = F.slice(F.col(ids), F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))
    open_ = F.lit(n > 0) & (tail == F.array(*map(F.lit, generation_prompt)).cast(dict(df.dtypes)[ids])) & (F.size(ids) >= n) if n else F.lit(False)
    keep = F.least(F.size(ids) - F.when(open_, n).otherwise(0), F.lit(max_model_len))
    uneven = F.lit(False)
    for o in others:
        uneven = uneven | (F.size(o) != F.size(ids))
    out = df.withColumn("_keep", F.when(uneven, F.raise_error(F.lit("arrays of different lengths")).cast("int")).otherwise(keep)).withColumn("_at", F.size(prompt))
    cut = {c: F.slice(c, F.lit(1), F.col("_keep")) for c in (ids, *others)}
    rest = lambda c: F.slice(cut[c], F.col("_at") + 1, F.lit(max_response_len))
    responses = {("response_ids" if c == ids else f"response_{c}"): rest(c) for c in (ids, *others)}
    return out.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in df.columns], *[v.alias(k) for k, v in responses.items()])


def pair_stack(df: DataFrame, width: int, end: int | None = None, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids") -> DataFrame:
    """input_ids and attention_mask as arrays of two rows, chosen and rejected: prompt and response (with the end token),
    filled with zeros on the right or cut there to the width."""

    def row(response: str) -> tuple[Column, Column]:
        kind = dict(df.dtypes)[prompt]
        whole = F.concat(F.col(prompt), F.col(response), *([F.array(F.lit(end)).cast(kind)] if end is not None else []))
        kept = F.slice(whole, F.lit(1), F.lit(width))
        fill = F.array_repeat(F.lit(0), F.lit(width) - F.size(kept))
        return F.concat(kept, fill.cast(kind)), F.concat(F.transform(kept, lambda _: F.lit(1)), fill)

    (a, am), (b, bm) = row(chosen), row(rejected)
    return df.select(*[c for c in df.columns if c not in (prompt, chosen, rejected)], F.array(a, b).alias("input_ids"), F.array(am, bm).alias("attention_mask"))
