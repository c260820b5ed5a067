"""Operator 7, mixing sources to target weights.

Words are aggregated per source, targets are water-filled under a cap, and every document is emitted
``floor(rate)`` times plus one hash-seeded Bernoulli copy with probability ``frac(rate)``.  DataFrame
functions only: one pass over the text stages each document's key and size, from which sources are aggregated and
repeated rows found; rates, a row per source, are joined back, by :func:`mix` in one more pass that does not move the
text.

The draw's seed is the document: its id, source and text, and for rows that are equal in all three their
number among each other, so rows that share an id (or lack one) are drawn each.  Only such rows move to be
numbered, and a salt splits a row that is repeated any number of times.

Defined cases: null text has size 0; null is a source of its own, ordered last; repeated rows are
documents of their own; an empty table gives no rows; other columns, whatever their names, are ignored by
:func:`mix_plan` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layout import with_positions, with_running
from .runtime import WORD, fresh, sized, staged

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Total of the mix as a share of all words, and the most a source (and so a document) is repeated.
SHARE, MOST = 1.5, 2
SEED = "mix-2"
#: Tasks that number one row's repetitions.
SALTS = 64


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with target and rate.

    Caps are met by water-filling: with sources ordered by cap / weight, the level of the first source
    whose cap is not below the level that remains for it and all later ones is final.  Places and running sums
    are made by ranges of the order, and the level is one row, so any number of sources may be there.
    """
    placed = with_positions(staged(sizes.withColumn("_none", F.col("source").isNull()), "sizes"), "_none", "source", out="_place")
    ranked = placed.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_fill", F.col("_cap") / F.col("_w"))
    ranked = staged(with_running(ranked, {"_cap": "_caps", "_w": "_ws"}, "_fill", "_none", "source"), "filled")
    whole = ranked.agg((F.lit(share) * F.sum("source_size")).alias("_goal"), F.sum("_w").alias("_all"))
    rows = ranked.join(F.broadcast(whole)).withColumns({"_rest": F.col("_goal") - (F.col("_caps") - F.col("_cap")), "_left": F.col("_all") - F.col("_ws") + F.col("_w")})  # one row
    final = F.col("_cap") * F.col("_left") >= F.col("_rest") * F.col("_w")
    level = rows.filter(final).agg(F.min_by(F.col("_rest") / F.col("_left"), F.struct(F.col("_caps") - F.col("_cap"), "_fill")).alias("_level"))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")))
    out = ranked.join(F.broadcast(level)).withColumn("target", target)  # one row
    return out.select("source", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same in every run and engine."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _document_key(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    known = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (doc_id, source)]
    return F.md5(F.concat(*(x for k in known for x in (F.md5(k), F.lit(":"))), F.md5(F.coalesce(F.col(text), F.lit("")))))


def _numbered(docs: DataFrame, slim: DataFrame, key: str, number: str) -> DataFrame:
    """Adds the number (from 1) of each row among those that share its key; rows whose key is their own stay where they
    are.  ``slim`` has the same rows' keys."""
    again, salt, other, rank, before, n = fresh(docs, "_again", "_salt", "_other", "_rank", "_before", "_n")
    repeated = staged(slim.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(F.col(key).alias(again)), "repeated")
    n_keys = repeated.count()
    if not n_keys:
        return docs.withColumn(number, F.lit(1).cast("long"))
    hint, same = sized(repeated, n_keys), F.col(key) == F.col(again)
    once = docs.join(hint, same, "left_anti").withColumn(number, F.lit(1).cast("long"))
    # Rows of a key may differ in other columns: those come in the order of their hash, equal ones in any order.
    rest = docs.join(hint, same, "left_semi").withColumns({other: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), salt: F.monotonically_increasing_id() % SALTS})
    rest = staged(rest, "repeated-rows")
    group = [key, other, salt]
    counts = rest.groupBy(*group).agg(F.count("*").alias(n))
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(other, salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    ranked = rest.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(0)))).join(counts, group)
    return once.unionByName(ranked.select(*[f"`{c}`" for c in docs.columns], (F.col(before) + F.col(rank)).cast("long").alias(number)))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with two more columns, the key that seeds their draw and their number of words, and those columns' names."""
    key, size = fresh(docs, "_key", "_size")
    return docs.withColumn(key, _document_key()).withColumn(size, word_count()), key, size


def _with_copies(rows: DataFrame, slim: DataFrame, key: str, size: str, seed: str, **rule) -> tuple[DataFrame, list[str]]:
    """The rows (with key and size) and four more columns with their names: source's size, target, copies, then others.
    ``slim`` holds source, key and size of the same rows."""
    source_size, target, copies, rate, source, number = names = fresh(rows, "_source_size", "_target", "_copies", "_rate", "_source", "_number")
    totals = slim.groupBy("source").agg(F.sum(size).alias("source_size"))
    rates = staged(source_targets(totals, **rule), "rates").withColumnsRenamed({"source": source, "source_size": source_size, "target": target, "rate": rate})
    seeded = _numbered(rows, slim, key, number)
    # One row a source: within the size bound they are broadcast and no text moves; beyond, hot sources are split by Spark.
    joined = seeded.join(sized(rates), F.col("source").eqNullSafe(F.col(source)), "left")
    extra = uniform(F.concat(F.lit(seed + ":"), key, F.lit(":"), F.col(number).cast("string"))) < F.col(rate) - F.floor(rate)
    return joined.withColumn(copies, F.floor(rate) + F.when(extra, 1).otherwise(0)), names


def mix_plan(docs: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    keyed, key, size = _keyed(docs.select("doc_id", "source", "text"))
    slim = staged(keyed.drop("text"), "keys")
    planned, (source_size, target, copies, *_) = _with_copies(slim, slim, key, size, seed, **rule)
    return planned.select("doc_id", F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col(size) * F.col(copies)).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """The mixed documents themselves: each row repeated as often as the plan says, columns unchanged."""
    keyed, key, size = _keyed(docs)
    planned, (_, _, copies, *_) = _with_copies(keyed, staged(keyed.select("source", key, size), "keys"), key, size, seed, **rule)
    (copy,) = fresh(planned, "_copy")
    return planned.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir):
    from .runtime import table

    return mix_plan(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(md5(coalesce(doc_id::VARCHAR, 'null')) || ':' || md5(coalesce(source, 'null')) || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
             [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM s WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
l AS (SELECT (goal - before) / rest AS level FROM f WHERE cap * rest >= (goal - before) * w ORDER BY before, cap / w LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, level * w) END::DOUBLE AS target FROM f, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
             (('0x' || substr(md5('mix-2:' || key || ':' || row_number() OVER (PARTITION BY key)), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
