"""Filters and counters over prompt groups (rows with ``uid``, ``k``, ``score``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _w():
    return Window.partitionBy("uid")


def dynamic_sampling(df: DataFrame, score: str = "score") -> DataFrame:
    """Groups whose scores vary (population deviation above 0) and groups of one."""
    kept = (F.stddev_pop(score).over(_w()) > 0) | (F.count("*").over(_w()) == 1)
    return df.withColumn("_keep", kept).filter("_keep").drop("_keep")


def take_groups(df: DataFrame, n: int) -> DataFrame:
    """The first n groups by uid.  The cut is a top-n over distinct ids, then a semi-join."""
    first = df.select("uid").distinct().orderBy("uid").limit(n)
    return df.join(first, "uid", "left_semi")


def accuracy_band(df: DataFrame, lo: float, hi: float, score: str = "score") -> DataFrame:
    """Groups whose mean score lies in [lo, hi]."""
    return df.withColumn("_acc", F.avg(score).over(_w())).filter(F.col("_acc").between(lo, hi)).drop("_acc")


def accuracy_histogram(df: DataFrame, score: str = "score") -> DataFrame:
    return df.groupBy("uid").agg(F.avg(score).alias("accuracy")).groupBy("accuracy").agg(F.count("*").alias("n_groups"))


def filter_and_downsample(df: DataFrame, lo: float, hi: float, max_len: int, keep_groups: int, score: str = "score", length: str = "length") -> DataFrame:
    """Groups in the band and with no response of max_len - 1 tokens or more come first (then by uid); the first groups stay."""
    stats = df.groupBy("uid").agg(F.avg(score).alias("_acc"), F.max(length).alias("_len"))
    passes = F.col("_acc").between(lo, hi) & (F.col("_len") < max_len - 1)
    first = stats.orderBy(F.desc(passes), "uid").limit(keep_groups).select("uid")
    return df.join(first, "uid", "left_semi")


def failed_groups(df: DataFrame, fail: float = 0.0, score: str = "score") -> DataFrame:
    """A row per group: all_failed and its accuracy (the open band 0 < accuracy < 1 is the caller's filter)."""
    return df.groupBy("uid").agg(F.bool_and(F.col(score) == fail).alias("all_failed"), F.avg(score).alias("accuracy"))


def valid_groups(df: DataFrame, success: float = 1.0, fail: float = 0.0, format_error: float = -1.0, score: str = "score") -> DataFrame:
    """Without groups that all fail, all succeed or all break the format."""
    s = F.col(score)
    bad = F.bool_and(s == fail).over(_w()) | F.bool_and(s == success).over(_w()) | F.bool_and(s == format_error).over(_w())
    return df.withColumn("_bad", bad).filter(~F.col("_bad")).drop("_bad")


def solve_counters(df: DataFrame, success: float = 1.0, fail: float = 0.0, format_error: float = -1.0, score: str = "score") -> DataFrame:
    """One row: groups solved by none, by all, by at least one, and with format errors only."""
    s = F.col(score)
    per = df.groupBy("uid").agg(F.bool_and(s == fail).alias("none"), F.bool_and(s == success).alias("all"), F.bool_and(s == format_error).alias("fmt"), F.bool_or(s == success).alias("one"))
    return per.agg(*(F.count_if(c).alias(f"solve_{c}") for c in ("none", "all", "one")), F.count_if("fmt").alias("solve_none_format"), F.count("*").alias("n_groups"))


def replace_failed(on: DataFrame, off: DataFrame, threshold: float = 0.0, score: str = "score") -> DataFrame:
    """In groups whose accuracy is at most the threshold the last wrong response gives way to the group's first off-policy row.

    Both tables have uid, k, score and response; the result adds replaced.
    """
    wrong = F.when(F.col(score) <= 0, F.col("k"))
    marked = on.withColumns({"_acc": F.avg(F.when(F.col(score) > 0, 1.0).otherwise(0.0)).over(_w()), "_last": F.max(wrong).over(_w())})
    first = off.withColumn("_n", F.row_number().over(_w().orderBy("k"))).filter("_n = 1").select("uid", F.col("response").alias("_response"), F.col(score).alias("_score"))
    both = marked.join(first, "uid", "left")
    swap = (F.col("_acc") <= threshold) & (F.col("k") == F.col("_last")) & F.col("_response").isNotNull()
    out = both.withColumns({"response": F.when(swap, F.col("_response")).otherwise(F.col("response")), score: F.when(swap, F.col("_score")).otherwise(F.col(score)), "replaced": F.coalesce(swap, F.lit(False))})
    return out.drop("_acc", "_last", "_response", "_score")


def merge_on_off(on: DataFrame, off: DataFrame) -> DataFrame:
    """Per prompt the on-policy rows, then the off-policy ones: common columns with a dense position in ``slot``."""
    common = [c for c in on.columns if c in off.columns]
    both = on.select(*common, F.lit(0).alias("_src")).unionByName(off.select(*common, F.lit(1).alias("_src")))
    return both.withColumn("slot", F.row_number().over(_w().orderBy("_src", "k")) - 1).withColumn("off_policy", F.col("_src") == 1).drop("_src")


def pairwise_accuracy(df: DataFrame, label: str, guess: str) -> DataFrame:
    """Per group the share of pairs (earlier, later) on whose order label and guess agree, weighted by the labels' distance.

    A guess that does not rise counts as falling; a group whose labels are all equal has 0.5.  Groups are the
    samples of one prompt, so pairs stay few.
    """
    a, b = df.select("uid", F.col("k").alias("ka"), F.col(label).alias("la"), F.col(guess).alias("ga")), df.select("uid", F.col("k").alias("kb"), F.col(label).alias("lb"), F.col(guess).alias("gb"))
    pairs = a.join(b, "uid").filter("ka < kb")
    weight = F.abs(F.col("la") - F.col("lb"))
    alike = ((F.col("ga") > F.col("gb")) == (F.col("la") > F.col("lb"))).cast("double")
    return pairs.groupBy("uid").agg(F.count("*").alias("n_pairs"), F.coalesce(F.try_divide(F.sum(alike * weight), F.sum(weight)), F.lit(0.5)).alias("accuracy"))


def replace_weak_off_policy(df: DataFrame, standard: DataFrame, fail: float = 0.0, shortest: int = 1000, score: str = "score", length: str = "length") -> DataFrame:
    """Off-policy rows that failed or are shorter than ``shortest`` take the group's standard response (uid, response).

    Adds replaced, and clears ``se`` where it is there; groups without a standard response stay.
    """
    other = standard.select("uid", F.col("response").alias("_standard"))
    both = df.join(other, "uid", "left")
    swap = ~F.col("on_policy") & ((F.col(score) == fail) | (F.col(length) < shortest)) & F.col("_standard").isNotNull()
    out = both.withColumns({"replaced": F.coalesce(swap, F.lit(False)), "response": F.when(swap, F.col("_standard")).otherwise(F.col("response"))})
    if "se" in df.columns:
        out = out.withColumn("se", F.col("se") & ~F.col("replaced"))
    return out.drop("_standard")


def overflow(df: DataFrame, batch_size: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """(the first batch_size prompts' rows, one row per remaining prompt) of a batch with dense positions ``pos``."""
    cut = batch_size * samples
    return df.filter(F.col("pos") < cut), df.filter((F.col("pos") >= cut) & (F.pmod("pos", F.lit(samples)) == 0))
