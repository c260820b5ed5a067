"""Operator 5, chat formatting by multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all
others as named users; the loss mask covers what the assistant says.  ``system`` is no participant: its turns
are rendered as such in every perspective.  Speech and names cannot open or close a turn, as the markup in
them is broken up.

A rendering is stored in rows of at most ``SLICE`` turns by their place in the dialogue: a dialogue of up to so
many turns is one row a perspective, and the rows of a longer one, read by ``segment``, are its rendering and
its mask without a gap.  So no row and no task holds an unbounded dialogue and nothing is dropped.  Dialogues
of one slice are gathered by one shuffle of the turns; perspectives are made from the gathered turns.  Only the
turns of longer ones are sorted by range first, which splits a dialogue of any length over many tasks, and get
their places from counts per range.

Defined cases: null role is the speaker ``unknown``; null text is empty; null conversation ids form one
dialogue; null turns come first; turns of one number are ordered by speaker and MD5 of the text; turns that
repeat are rendered each; a dialogue of ``system`` alone has no participant and gives no row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import sized, staged

#: Turns in a row of a rendering.
SLICE = 1024
#: Fixed markup of the template, and what a marker in speech or a name becomes.
START, END = "<|im_start|>", "<|im_end|>\n"
MARK, BROKEN = "<|im_", "< |im_"
SYSTEM = "system"

_ORDER = ("turn", "speaker", "_md5")


def spoken(turns: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, _md5 of the text, said."""
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(BROKEN))
    speaker = F.translate(plain(F.coalesce("role", F.lit("unknown"))), "\r\n", "  ")
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), plain(F.coalesce("text", F.lit(""))).alias("said"))
    return said.select("conv_id", "turn", "speaker", F.md5("said").alias("_md5"), "said")


def _render(t: Column, perspective: str) -> tuple[Column, Column, Column]:
    """Text, mask runs and number of masked characters of an array of turns."""
    own = lambda x: x["speaker"] == F.col(perspective)
    head = lambda x: F.when(own(x), F.lit(START + "assistant\n")).when(x["speaker"] == SYSTEM, F.lit(START + SYSTEM + "\n")).otherwise(F.concat(F.lit(START + "user name="), x["speaker"], F.lit("\n")))
    size = lambda x: F.length(x["said"]) + len(END)
    text = F.array_join(F.transform(t, lambda x: F.concat(head(x), x["said"], F.lit(END))), "")
    runs = F.array_join(F.transform(t, lambda x: F.concat(F.lit("0:"), F.length(head(x)).cast("string"), F.lit(","), own(x).cast("int").cast("string"), F.lit(":"), size(x).cast("string"))), ",")
    return text, runs, F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + F.when(own(x), size(x)).otherwise(0))


def _long_dialogues(said: DataFrame, slice_turns: int) -> DataFrame:
    """conv_id, segment, _t (its turns in order), perspective of dialogues of any length."""
    # Rows that are equal in everything may be in any order, so a salt may split them.
    keys = ["conv_id", *_ORDER, "_salt"]
    ordered = said.withColumn("_salt", F.monotonically_increasing_id() % 64).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    ordered = staged(ordered.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "dialogues")
    counts = ordered.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), (before - F.col("_first")).alias("_shift"))
    placed = ordered.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    placed = placed.withColumn("_place", F.col("_at") + F.col("_shift")).withColumn("segment", F.floor(F.col("_place") / slice_turns).cast("long"))
    slices = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("_place", "speaker", "said"))).alias("_t"))
    speakers = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    return slices.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "segment", "perspective", F.transform("_t", lambda x: F.struct(x["speaker"], x["said"])).alias("_t"))


def rotate(turns: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """conv_id, perspective, segment, n_turns, text, mask_runs (``flag:characters`` joined by commas, covering
    the text from its start) and n_masked (characters with loss)."""
    said = spoken(turns)
    long = staged(said.groupBy("conv_id").count().filter(F.col("count") > slice_turns).select(F.col("conv_id").alias("_long")), "long-dialogues")
    n_long = long.count()
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    gathered = (said.join(sized(long, n_long), is_long, "left_anti") if n_long else said).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_ORDER, "said"))).alias("_t"))
    gathered = gathered.withColumn("perspective", F.explode(F.array_distinct(F.filter(F.transform("_t", lambda x: x["speaker"]), lambda s: s != SYSTEM))))
    slices = gathered.select("conv_id", F.lit(0).cast("long").alias("segment"), "perspective", F.transform("_t", lambda x: F.struct(x["speaker"], x["said"])).alias("_t"))
    if n_long:
        slices = slices.unionByName(_long_dialogues(said.join(sized(long, n_long), is_long, "left_semi"), slice_turns))
    text, runs, masked = _render(F.col("_t"), "perspective")
    return slices.select("conv_id", "perspective", "segment", F.size("_t").cast("long").alias("n_turns"), text.alias("text"), runs.alias("mask_runs"), masked.alias("n_masked"))


def op5(spark, sf_dir):
    from .runtime import table

    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH s AS (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(13) || chr(10), '  ') AS speaker,
                  replace(coalesce(text, ''), '<|im_', '< |im_') AS said FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(said)) - 1 AS place FROM s),
p AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM s WHERE speaker <> 'system'),
j AS (SELECT conv_id, perspective, (place // 1024)::BIGINT AS segment, place, speaker, said, (speaker = perspective)::INT AS own,
             CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
                  ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head,
             said || '<|im_end|>' || chr(10) AS body
      FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv)
SELECT conv_id, perspective, segment, count(*)::BIGINT AS n_turns,
       string_agg(head || body, '' ORDER BY place) AS text,
       string_agg('0:' || length(head) || ',' || own || ':' || length(body), ',' ORDER BY place) AS mask_runs,
       sum(own * length(body))::BIGINT AS n_masked
FROM j GROUP BY conv_id, perspective, segment
"""
