"""Column builders for reasoning texts: white space, think tags, templates, target rewrites."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "<think>", "</think>"
#: Unicode white space as a general-purpose strip sees it, the four ASCII separators included.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Removes white space (any Unicode kind) at both ends; ``trim`` alone removes spaces only."""
    return F.regexp_replace(_col(c), _EDGE, "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+$", "")


def has_think(c: Column) -> tuple[Column, Column]:
    return F.rlike(c, F.lit(r"(?i)<think\b[^>]*>")), F.rlike(c, F.lit(r"(?i)</think\s*>"))


def normalize_think(c: Column | str) -> Column:
    """Both tags: as is; a closing tag only: an opening one is put before; else the whole text is wrapped.  Null is empty."""
    text = strip(F.coalesce(_col(c), F.lit("")))
    opened, closed = has_think(text)
    return F.when(opened & closed, text).when(closed, F.concat(F.lit("<think>\n"), text)).otherwise(F.concat(F.lit("<think>\n"), text, F.lit("\n</think>\n\n")))


def split_target(c: Column | str) -> tuple[Column, Column]:
    """(thinking, solution), cut at the first closing tag; without one all is thinking.  Opening tags go."""
    text = F.coalesce(_col(c), F.lit(""))
    at = F.instr(text, CLOSE)
    think = F.when(at > 0, F.left(text, at - 1)).otherwise(text)
    solution = F.when(at > 0, F.substring(text, at + len(CLOSE), F.length(text))).otherwise(F.lit(""))
    return strip(F.replace(think, F.lit(OPEN), F.lit(""))), strip(F.replace(solution, F.lit(OPEN), F.lit("")))


def between_closings(c: Column | str) -> tuple[Column, Column]:
    """(thinking, answer) where the answer ends at a second closing tag; nulls if there is no closing tag."""
    parts = F.split(_col(c), re.escape(CLOSE))
    return strip(F.replace(F.get(parts, F.lit(0)), F.lit(OPEN), F.lit(""))), strip(F.get(parts, F.lit(1)))


def rewrite_messages(target: Column | str, mode: str) -> Column:
    """Rewrites the first message of an array<struct<role, content>>: full, think_only or solution_only."""
    if mode not in ("full", "think_only", "solution_only"):
        raise ValueError(f"unknown target mode {mode!r}")
    if mode == "full":
        return _col(target)
    pick = 0 if mode == "think_only" else 1

    def one(message: Column, i: Column) -> Column:
        return F.when(i == 0, message.withField("content", split_target(message["content"])[pick])).otherwise(message)

    return F.transform(_col(target), one)


def template(pattern: str, **fields: Column | str) -> Column:
    """A ``str.format``-like template compiled to one concat: ``{name}`` is a column, ``{{`` and ``}}`` are braces.

    Values are never scanned again, so braces or percent signs in them are safe.
    """
    parts: list[Column] = []
    literal = ""
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", pattern):
        if piece in ("{{", "}}"):
            literal += piece[0]
        elif re.fullmatch(r"\{\w+\}", piece):
            if piece[1:-1] not in fields:
                raise KeyError(piece[1:-1])
            parts += [F.lit(literal), F.coalesce(_col(fields[piece[1:-1]]).cast("string"), F.lit(""))]
            literal = ""
        else:
            literal += piece
    return F.concat(*parts, F.lit(literal))


def problem_of(prompt: Column | str) -> Column:
    """Content of the second message; null when there are fewer than two."""
    return F.get(_col(prompt), F.lit(1))["content"]


def capitalize(c: Column | str) -> Column:
    """First character upper case, the rest lower case (not every word)."""
    return F.concat(F.upper(F.left(_col(c), F.lit(1))), F.lower(F.substring(_col(c), 2, 1 << 30)))


def strip_shared_opening(prompt: Column | str, target: Column | str, opening: str = "<think>\n") -> Column:
    """Drops the opening from the target when the prompt ends with it already."""
    p, t = _col(prompt), _col(target)
    return F.when(F.endswith(p, F.lit(opening)) & F.startswith(t, F.lit(opening)), F.substring(t, len(opening) + 1, 1 << 30)).otherwise(t)


def chat_template(messages: Column | str, generation_prompt: bool = False) -> Column:
    """Renders array<struct<role, content>> with the im_start / im_end markup."""
    body = F.array_join(F.transform(_col(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generation_prompt else body


def passages_text(docs: Column | str) -> Column:
    """``Doc i (Title: ...) text`` lines from an array of contents whose first line is the title."""

    def one(content: Column, i: Column) -> Column:
        lines = F.split(content, "\n")
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.get(lines, F.lit(0)), F.lit(")\n"), F.array_join(F.slice(lines, 2, F.size(lines)), "\n"))

    return F.array_join(F.transform(_col(docs), one), "\n\n")


def media_segments(c: Column | str) -> Column:
    """array<struct<type, text>>: a text cut at its image and video markers, in order, without empty pieces."""
    pieces = F.split(_col(c), r"(?=<image>)|(?<=<image>)|(?=<video>)|(?<=<video>)")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.filter(F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text"))), lambda s: (s["type"] != "text") | (s["text"] != ""))


def hashed_unit(key: Column | str, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), _col(key).cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
