"""The k-th largest row of a table without a total order.

Histogram passes count the rows of ``BUCKETS`` value ranges and go on inside the one that holds the cut, so each pass
is one partial aggregation whose result has a bounded number of rows.  Only the last range, a few thousand rows or one
value that many rows share, is sorted.  The result is one row; whether any other row lies at or above it is an
expression of that row alone, so marking the k largest moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .layout import with_positions

#: Value ranges of a pass, and rows of a range from which the range is sorted by one top-n.
BUCKETS, FEW = 4096, 10_000


def _bucket(value: str, low: float, high: float) -> Column:
    """A number that does not fall as the value rises: -1 below all finite values, above them BUCKETS, NaN last."""
    v = F.col(value)
    # Halved first, as the width of the range of doubles is no double.
    share = (v / 2 - F.lit(low / 2)) / F.lit(max(high / 2 - low / 2, 5e-324))
    inner = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))).cast("int")
    inf = F.lit(float("inf"))
    return F.when(F.isnan(v), BUCKETS + 1).when(v == inf, BUCKETS).when(v == -inf, -1).otherwise(inner)


def _finite(value: str) -> Column:
    v = F.col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def kth_largest(df: DataFrame, k: int, value: str, *keys: str) -> Row | None:
    """The row (value and keys) at place k, from 1, in descending order of ``value`` (a double; NaN is the largest),
    then ascending order of ``keys``, which tell rows apart.  Null values take no part; with fewer than k rows the
    result is None, and for k below 1 too."""
    rows = df.select(value, *keys).filter(F.col(value).isNotNull())
    if k < 1:
        return None
    left, narrow = k, rows
    while True:
        span = narrow.agg(F.min(_finite(value)).alias("low"), F.max(_finite(value)).alias("high"), F.count("*").alias("n")).first()
        if span["n"] < left:
            return None
        if span["n"] <= FEW:
            order = [F.col(value).desc(), *(F.col(c).asc() for c in keys)]
            return narrow.orderBy(*order).limit(left).collect()[-1]  # at most FEW rows
        low, high = (0.0, 0.0) if span["low"] is None else (float(span["low"]), float(span["high"]))
        held = narrow.withColumn("_b", _bucket(value, low, high))
        counts = held.groupBy("_b").count().collect()  # at most BUCKETS + 3 rows
        for b, n in sorted(((r["_b"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                break
            left -= n
        if len(counts) == 1:  # one value, finite or not, that more rows share: their keys decide
            return with_positions(narrow, f"-{value}", *keys, out="_place").filter(F.col("_place") == left - 1).drop("_place").first()
        narrow = held.filter(F.col("_b") == b).drop("_b")


def at_or_above(row: Row | None, value: str, *keys: str) -> Column:
    """Whether a row is the given one or comes before it; without one (fewer rows than asked for) every value that is there is."""
    if row is None:
        return F.col(value).isNotNull()
    cut = F.lit(row[value])
    before = F.lit(True)
    for c in reversed(keys):
        before = (F.col(c) < F.lit(row[c])) | ((F.col(c) == F.lit(row[c])) & before)
    return F.coalesce((F.col(value) > cut) | ((F.col(value) == cut) & before), F.lit(False))
