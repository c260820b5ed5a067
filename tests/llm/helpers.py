"""Tables for the llm tests: awkward rows of every kind, and plain word splitting."""

from __future__ import annotations

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(spark, texts, sources=None, extra=False):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    return df.selectExpr("*", "1 as `length`", "2 as `piece`", "'x' as `_text`") if extra else df


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward() -> list:
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 30_000)
    return [None, "", " ", "\n\n", "one", "Ärger größe x", "a b c d", base, base, base.upper(), base + " tail", long, "#" * 50, "x" * 20_000, "tab\tsep\x0bvt\x0cff\rcr", "emoji 😀 ok " * 30, "\x1c\x1d sep"]
