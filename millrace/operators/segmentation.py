"""Segment boundaries, token split points and answer-leak control of thinking texts."""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from ..functions.answers import boxed_spans

# Fixed patterns of the boundary rules.
_MATH = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^\$\n]+?\$", re.DOTALL)
_SENTENCE_END = re.compile(r"[.!?]+[\)\]\"']?\s+")
_MATH_END = re.compile(r"(?:\$\$|\\\]|\\\)|\$)\s+(?=[A-Z\\$\d\(\[\"'])")
_PARAGRAPH = re.compile(r"\n\n+")
_TOKEN = re.compile(r"\w+|[^\w\s]")

Offsets = Callable[[str], list[int]]


def regex_token_ends(text: str) -> list[int]:
    """The default tokenizer: words and single punctuation marks; the end offset of each."""
    return [m.end() for m in _TOKEN.finditer(text)]


def _tokenizer(path: str):
    """A tokenizer file of the ``tokenizers`` library, read once a process; a task has a core, so it takes one thread."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


_TOKENIZERS: dict = {}


class FileOffsets:
    """Token end offsets by a tokenizer file.  Where the tokenizer's offsets don't follow the text, the tokens of each
    prefix are counted instead (``count``)."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> list[int]:
        ends = [end for _, end in _tokenizer(self.path).encode(text, add_special_tokens=False).offsets]
        if any(a > b for a, b in zip(ends, ends[1:], strict=False)) or any(e > len(text) for e in ends):
            raise ValueError("offsets don't follow the text")
        return ends

    def count(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)


#: Fixed: characters and texts that are encoded at once, as an encoding takes a hundred times the bytes of its ids.
ENCODED_CHARS, ENCODED_TEXTS = 1 << 18, 64


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, few enough to encode at once."""
    group, chars = [], 0
    for text in texts:
        if group and (len(group) >= ENCODED_TEXTS or chars + len(text) > ENCODED_CHARS):
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


def encoded(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """Token ids of texts by a tokenizer file, without special tokens, in Arrow batches; null stays null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        ids = [np.array(e.ids, np.int32) for group in _groups(texts[some].tolist()) for e in _tokenizer(path).encode_batch(group, add_special_tokens=False)]
        return pd.Series(ids, index=texts.index[some], dtype=object).reindex(texts.index).where(some, None)

    return df.withColumn(out, encode(text))


def decoded(df: DataFrame, ids: str, path: str, out: str = "text", skip_special: bool = True) -> DataFrame:
    """Token ids as text, by a tokenizer file, in Arrow batches."""

    @F.pandas_udf(StringType())
    def decode(rows: pd.Series) -> pd.Series:
        some = rows.notna()
        texts = _tokenizer(path).decode_batch([list(map(int, r)) for r in rows[some]], skip_special_tokens=skip_special)
        return pd.Series(texts, index=rows.index[some], dtype=object).reindex(rows.index).where(some, None)

    return df.withColumn(out, decode(ids))


def paragraph_boundaries(text: str) -> list[int]:
    ends = [m.end() for m in _PARAGRAPH.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def sentence_boundaries(text: str) -> list[int]:
    """Starts of the sentences after the first, and the end of the text; none for an empty text.

    Punctuation inside mathematics doesn't end a sentence; a closing delimiter before a likely sentence start
    and a paragraph break do.
    """
    if not text:
        return []
    masked = _MATH.sub(lambda m: re.sub(r"[.!?]", "_", m.group()), text)
    ends = {m.end() for rule, where in ((_SENTENCE_END, masked), (_MATH_END, text), (_PARAGRAPH, text)) for m in rule.finditer(where)}
    return sorted(ends | {len(text)})


def boundaries(text: str, unit: str) -> list[int]:
    if unit not in ("sentence", "paragraph"):
        raise ValueError(f"unknown split unit {unit!r}")
    return sentence_boundaries(text) if unit == "sentence" else paragraph_boundaries(text)


def split_points(text: str | None, stages: int = 8, power: float = 1.0, unit: str = "sentence", ratio: float | None = None, token_ends: Offsets = regex_token_ends) -> list[int]:
    """Token counts of growing prefixes that end at a boundary: for each ratio the first boundary at or after ratio * length.

    If the tokenizer gives no usable offsets (it raises) and can count, the tokens of each prefix are counted."""
    ratios = [ratio] if ratio is not None else [(i / (stages - 1)) ** power if stages > 1 else 0.0 for i in range(stages)]
    if not text:
        return [0] * len(ratios)
    cuts = boundaries(text, unit)
    try:
        ends = token_ends(text)
    except Exception:
        if not hasattr(token_ends, "count"):
            raise
        ends = None
    out = []
    for r in ratios:
        if r == 0:
            out.append(0)
            continue
        i = bisect_left(cuts, r * len(text))
        cut = cuts[min(i, len(cuts) - 1)]
        if ends is None:
            out.append(token_ends.count(text[:cut]))
            continue
        out.append(len(ends) if cut >= len(text) else bisect_left(ends, cut))
    return out


def with_split_points(df: DataFrame, text: str = "think", out: str = "token_split_points", **rule) -> DataFrame:
    """Adds array<int> of split points by an Arrow UDF: offsets of three patterns on two texts are beyond the built-ins."""

    @F.pandas_udf("array<int>")
    def points(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_points(t, **rule))

    return df.withColumn(out, points(text))


def with_boundaries(df: DataFrame, text: str = "text", unit: str = "paragraph", out: str = "ends") -> DataFrame:
    """Adds array<int> of boundaries by an Arrow UDF, linear in the text."""

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: boundaries(t or "", unit))

    return df.withColumn(out, ends(text))


def _below(rising: Column, limit: Column) -> Column:
    """How many elements of a rising array are below a limit, by halving: as many looks as its size has bits."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    bits = F.length(F.bin(F.size(rising)))
    steps = F.when(F.size(rising) > 0, F.slice(powers, 32 - bits, bits))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(rising, at + step - 1) < limit, at + step).otherwise(at))
    return F.when(F.size(rising) == 0, 0).otherwise(found)


def split_points_from(bounds: Column | str, token_ends: Column | str, length: Column | str, ratios: list[float]) -> Column:
    """The same from boundaries and token ends that are columns already, both rising, built-ins only.

    Give arrays that take work to make as columns of a projection below: each ratio names them several times."""
    b, e, n = (F.col(c) if isinstance(c, str) else c for c in (bounds, token_ends, length))

    def one(r: float) -> Column:
        if r == 0:
            return F.lit(0)
        cut = F.coalesce(F.get(b, _below(b, r * n)), F.try_element_at(b, F.lit(-1)), F.lit(0))
        return F.when(cut >= n, F.size(e)).otherwise(_below(e, cut))

    return F.array(*map(one, ratios))


@F.pandas_udf(ArrayType(IntegerType()))
def paragraph_ends(texts: pd.Series) -> pd.Series:
    """Paragraph boundaries as a column, linear in the text."""
    return texts.map(lambda t: paragraph_boundaries(t or ""))


def truncate_answer(think: str, full: str) -> str:
    """Cuts the thinking before the line or sentence that first boxes the final answer (the last box of the full text).

    A cut that leaves nothing keeps the thinking as it is.
    """
    boxes = boxed_spans(full)
    if not boxes:
        return think
    answer = boxes[-1][2].strip()
    at = next((start for start, _, content in boxed_spans(think) if content.strip() == answer), None)
    if at is None:
        return think
    head = think[:at]
    cut = max(head.rfind("\n"), *(head.rfind(p) + len(p) - (p[-1] == "\n") if head.rfind(p) >= 0 else -1 for p in (". ", ".\n")))
    kept = think[: max(cut, 0)].rstrip()
    return kept or think


def final_answers(full: str) -> list[str]:
    """Boxed contents after the last closing think tag, else the last box of all."""
    after = full.rsplit("</think>", 1)[-1] if "</think>" in full else ""
    found = [c.strip() for _, _, c in boxed_spans(after)]
    if found:
        return found
    return [c.strip() for _, _, c in boxed_spans(full)][-1:]


def leaks(prefix: str, answers: list[str]) -> bool:
    return any(c.strip() in answers for _, _, c in boxed_spans(prefix)) or any(f"\\boxed{{{a}}}" in prefix for a in answers)


def leak_audit(df: DataFrame, think: str = "think", full: str = "full") -> DataFrame:
    """Adds has_answer and leaked (of the truncated thinking)."""

    @F.pandas_udf("has_answer boolean, leaked boolean")
    def audit(thinks: pd.Series, fulls: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(thinks.fillna(""), fulls.fillna(""), strict=True):
            a = final_answers(f)
            rows.append((bool(a), leaks(truncate_answer(t, f), a)))
        return pd.DataFrame(rows, columns=["has_answer", "leaked"])

    return df.withColumn("_a", audit(think, full)).select("*", "_a.has_answer", "_a.leaked").drop("_a")


def leaks_before_split(df: DataFrame, think: str = "think", full: str = "full", points: str = "token_split_points", out: str = "leaked", token_ends: Offsets = regex_token_ends) -> DataFrame:
    """Whether the thinking up to the last split point (a number of tokens) holds one of the final answers in a box."""

    @F.pandas_udf(BooleanType())
    def check(thinks: pd.Series, fulls: pd.Series, cuts: pd.Series) -> pd.Series:
        rows = []
        for t, f, c in zip(thinks.fillna(""), fulls.fillna(""), cuts, strict=True):
            n = int(c[-1]) if c is not None and len(c) else 0
            ends = token_ends(t)
            rows.append(leaks(t if n >= len(ends) else t[: ends[n - 1]] if n else "", final_answers(f)))
        return pd.Series(rows, dtype=object)

    return df.withColumn(out, check(think, full, points))


def audit_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if("has_answer").alias("n_answers"), F.count_if("leaked").alias("n_leaked"))
