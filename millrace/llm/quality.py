"""Operator 10, quality rules: cross-document line frequency on top of per-document base rules.

Lines are normalised and hashed; for every line of a host (here the document's ``source``) distinct documents
are counted; lines above the limit are removed, and a document that has lost most of its words is rejected.

Copies must not make a text's own lines look like boilerplate (near-duplicate removal is another stage's
work), so documents of one host whose normalised lines are all the same count as one.  So do near copies where it
matters: all documents that hold one of the lines by which the first count depletes some document are joined
among themselves by :mod:`jaccard` (five-word shingles, similarity 0.8 or more), the lines that it found are
counted again with one document for each of these classes, and the verdicts are made from that count.  A notice that stands in different texts has as many
documents as before; a text that many edited copies share has one, and its copies are left to the join.  A line
that repeats within a document counts once, whatever stands around it.

Lines are split and hashed once and staged.  Hot hosts and hot lines are counted by two partial aggregations, so
a line costs a row per task and document; the removed lines are broadcast only within the size bound.

Defined cases: null and empty texts have no words and fail the base rules; null is a host of its own; repeated
rows are judged each; an empty table gives no rows; other columns are ignored by :func:`verdicts`, kept by
:func:`keep_clean`.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import near_duplicates
from .runtime import WORD, fresh, map_batches, sized, staged

#: Distinct documents of one host with a line above which it is removed.
LINE_LIMIT = 20
#: A document is depleted when less than this share of its words is left.
LEFT_SHARE = 0.3
#: Words of a shingle and similarity in percent from which documents are near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
    return len(words), len(joined.translate(None, _CONTINUATION)), len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, a 64-bit key of the text, the base counts and base_failed, a row per document."""
    slim = docs.select("doc_id", F.xxhash64("source", "text").alias("_text"), "text")

    def make():
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

        def run(cols):
            stats = [base_stats(t) for t in cols["text"]]
            out = {n: [s[k] for s in stats] for k, n in enumerate(names)}
            return {"doc_id": cols["doc_id"], "_text": cols["_text"], **out, "base_failed": [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]}

        return run

    return map_batches(slim, make, f"doc_id {dict(docs.dtypes)['doc_id']}, _text long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def document_lines(docs: DataFrame) -> DataFrame:
    """A row per line with a word: host hash, text key, hash of all the document's lines, line hash, words in the
    line, and whether it is the document's first."""
    normal = lambda line: F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normal), lambda x: x != "")
    base = docs.select(F.xxhash64("source").alias("host"), F.xxhash64("source", "text").alias("_text"), lines.alias("_lines"))
    hashed = base.select("host", "_text", "_lines", F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h"))
    rows = F.transform("_lines", lambda x, i: F.struct(F.get("_h", i).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), (i == 0).alias("first")))
    return hashed.select("host", "_text", F.xxhash64("_h").alias("document"), F.inline(rows))


def common_lines(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line, n_documents) of the lines above the limit."""
    seen = lines.select("host", "line", "document").distinct()
    return seen.groupBy("host", "line").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") > limit)


def verdicts(docs: DataFrame, limit: int = LINE_LIMIT, left_share: float = LEFT_SHARE) -> DataFrame:
    """doc_id, the base columns, removed_words (in lines above the limit) and kept, a row per document."""
    return _judged(docs.select("doc_id", "source", "text"), limit, left_share).drop("_text")


def _removed(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(_text, removed_words) of the texts with words in common lines.

    Per text, not per row: copies of a text share one sum, so it is divided by their number."""
    marked = lines.join(sized(common.select("host", "line", F.lit(True).alias("_common"))), ["host", "line"], "left")
    sums = marked.groupBy("_text").agg(F.sum(F.when(F.col("_common"), F.col("words")).otherwise(0)).alias("_sum"), F.count_if("first").alias("_copies"))
    return sums.filter("_sum > 0").select("_text", F.floor(F.col("_sum") / F.col("_copies")).alias("removed_words"))


def _depleted(left_share: float):
    return F.col("n_words") - F.col("removed_words") < F.lit(left_share) * F.col("n_words")


def _judged(docs: DataFrame, limit: int, left_share: float) -> DataFrame:
    lines = staged(document_lines(docs), "lines")  # split and hashed once, a few fixed-width columns a line
    base = staged(base_rules(docs), "base")
    common = staged(common_lines(lines, limit), "common-lines")
    removed = staged(_removed(lines, common), "removed")
    depleted = staged(base.filter("not base_failed").join(removed, "_text").filter(_depleted(left_share)).select("_text").distinct(), "depleted")
    if not depleted.isEmpty():
        common = staged(_common_by_classes(docs, lines, common, depleted, limit), "common-lines")
        removed = _removed(lines, common)
    out = base.join(removed, "_text", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & ~_depleted(left_share))


def _common_by_classes(docs: DataFrame, lines: DataFrame, common: DataFrame, depleted: DataFrame, limit: int) -> DataFrame:
    """The common lines that stay so if documents with lines that deplete one count one for each class of near copies."""
    held = lines.join(sized(common.select("host", "line")), ["host", "line"], "left_semi")
    doubtful = staged(held.join(sized(depleted), "_text", "left_semi").select("host", "line").distinct(), "doubtful-lines")
    holders = staged(held.join(sized(doubtful), ["host", "line"], "left_semi").select("_text").distinct(), "holders")
    keyed = docs.select(F.xxhash64("source", "text").alias("_text"), "text")
    texts = keyed.join(sized(holders), "_text", "left_semi").dropDuplicates(["_text"]).select(F.col("_text").alias("doc_id"), "text")
    near = near_duplicates(staged(texts, "holders-texts"), NEAR_WORDS, NEAR_PERCENT)
    classes = staged(near.select(F.col("doc_id").alias("_text"), F.col("component_id").alias("_class")), "holders-classes")
    known = held.join(sized(classes), "_text", "left")
    return common_lines(known.withColumn("document", F.coalesce("_class", "document")), limit)


def keep_clean(docs: DataFrame, limit: int = LINE_LIMIT, left_share: float = LEFT_SHARE) -> DataFrame:
    """The documents that pass, columns unchanged.  The verdict depends on source and text alone."""
    judged = _judged(docs.select("doc_id", "source", "text"), limit, left_share)
    (key,) = fresh(docs, "_text")
    rejected = staged(judged.filter(~F.col("kept")).select(F.col("_text").alias(key)).distinct(), "rejected")
    return docs.withColumn(key, F.xxhash64("source", "text")).join(sized(rejected), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir):
    from .runtime import table

    return verdicts(table(spark, sf_dir, "documents"))
