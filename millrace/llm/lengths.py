"""Operator 3, token counts as an exact length histogram.

Documents are aggregated by their encoded length; sums over the histogram then answer totals, quantiles and
truncated totals for every context limit.  The histogram has a row per distinct length, and its running sums
are made in two levels (within blocks of lengths, and over the blocks), so no task sorts the whole histogram.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives no rows; doc_id
is read as a long (null for ids that are no numbers) and plays no part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import map_batches, staged

#: Lengths in a block of the two-level running sums.
BLOCK = 64


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the number of ids of the whole text."""

    def make():
        enc = encoder(path)
        return lambda cols: {"doc_id": cols["doc_id"], "length": enc.lengths(cols["text"])}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs, n_tokens; docs_upto / tokens_upto (this length and shorter), docs_from / tokens_from
    (suffix sums: this length and longer), docs_over (longer than it), share_upto (the quantile of the length: the
    share of documents that it is not below), and truncated_tokens: the total when every document is cut to this
    length.  For a limit c between two lengths the total is tokens_upto of the lower one plus c times docs_from of
    the higher one."""
    counted = staged(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")  # texts are read once
    hist = counted.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t")).select(
        "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_d", "_t")), *(F.sum(c).over(every).alias(f"{c}_all") for c in ("_d", "_t"))
    )
    within = Window.partitionBy("_block").orderBy("length")
    out = hist.withColumns({"_dw": F.sum("n_docs").over(within), "_tw": F.sum("n_tokens").over(within)}).join(blocks, "_block")
    out = out.withColumns({"docs_upto": F.col("_d_before") + F.col("_dw"), "tokens_upto": F.col("_t_before") + F.col("_tw")})
    out = out.withColumns({"docs_from": F.col("_d_all") - F.col("docs_upto") + F.col("n_docs"), "tokens_from": F.col("_t_all") - F.col("tokens_upto") + F.col("n_tokens")})
    truncated = F.col("tokens_upto") + F.col("length") * (F.col("_d_all") - F.col("docs_upto"))
    over = (F.col("docs_from") - F.col("n_docs")).alias("docs_over")
    return out.select("length", "n_docs", "n_tokens", "docs_upto", "tokens_upto", "docs_from", "tokens_from", over, (F.col("docs_upto") / F.col("_d_all")).alias("share_upto"), truncated.alias("truncated_tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over (longer ones) and truncated_tokens for the given limits, from a histogram."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    fits = F.col("length") <= F.col("context_limit")
    return hist.join(F.broadcast(asked)).groupBy("context_limit").agg(
        F.sum(F.when(~fits, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_tokens")
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share and the smallest length that at least that share of the documents does not exceed."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    enough = F.col("docs_upto") >= F.col("share") * (F.col("docs_upto") + F.col("docs_from") - F.col("n_docs"))
    return hist.join(F.broadcast(asked)).groupBy("share").agg(F.min(F.when(enough, F.col("length"))).alias("length"))


def op3(spark, sf_dir):
    from .runtime import table

    return histogram(encoded_lengths(table(spark, sf_dir, "documents")))
