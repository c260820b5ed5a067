"""Queries over batch layout: positions, repeats, chunks, padding, unions, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..operators import balancing as B
from ..operators import layout as L
from ..operators import stats as S
from .base import TOKENS, query, r6, table, tokens

CUST = "c AS (SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS pos, count(*) OVER () AS n FROM customer)"


def _cust(spark, d):
    return L.with_positions(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


@query("row_index", f"WITH {CUST} SELECT c_custkey, pos FROM c")
def row_index(spark, d):
    return _cust(spark, d).select("c_custkey", "pos")


@query("repeat_interleave", f"WITH {CUST} SELECT c_custkey, pos * 3 + k AS pos FROM c, (SELECT unnest(range(3)) AS k)")
def repeat_interleave(spark, d):
    return L.repeat(_cust(spark, d), 3).select("c_custkey", "pos")


@query("repeat_tile", f"WITH {CUST} SELECT c_custkey, k * n + pos AS pos FROM c, (SELECT unnest(range(3)) AS k)")
def repeat_tile(spark, d):
    return L.repeat(_cust(spark, d), 3, interleave=False).select("c_custkey", "pos")


@query("repeat_each", "SELECT c_custkey, k::INT AS copy FROM customer, LATERAL (SELECT unnest(range((c_nationkey % 4)::BIGINT)) AS k)")
def repeat_each(spark, d):
    return L.repeat_each(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") % 4).select("c_custkey", "copy")


@query("chunk_label", f"WITH {CUST} SELECT c_custkey, floor(pos / ceil(n / 7.0))::INT AS chunk FROM c")
def chunk_label(spark, d):
    c = _cust(spark, d)
    return L.chunk(c, 7, c.count(), strict=False).select("c_custkey", "chunk")


@query("batches_drop_last", f"WITH {CUST} SELECT c_custkey, (pos // 64)::BIGINT AS batch FROM c WHERE pos // 64 < n // 64")
def batches_drop_last(spark, d):
    c = _cust(spark, d)
    return L.batches(c, 64, c.count(), drop_last=True).select("c_custkey", "batch")


@query("pad_to_divisor", f"WITH {CUST}, m AS (SELECT *, (64 - n % 64) % 64 AS missing FROM c) SELECT c_custkey, pos, false AS is_pad FROM m UNION ALL SELECT c_custkey, pos + n, true FROM m WHERE pos < missing")
def pad_to_divisor(spark, d):
    c = _cust(spark, d)
    return L.pad_to_divisor(c, 64, c.count()).select("c_custkey", "pos", "is_pad")


@query("unpad", f"WITH {CUST} SELECT c_custkey, (n + 63) // 64 * 64 - 1 - pos AS pos FROM c")
def unpad(spark, d):
    c = _cust(spark, d)
    n = c.count()
    # Rows are turned round before the padding goes, so it stands at the head then.
    return L.unpad(L.pad_to_divisor(c, 64, n).withColumn("pos", -(-n // 64) * 64 - 1 - F.col("pos"))).select("c_custkey", "pos")


@query("reorder", f"WITH {CUST} SELECT c_custkey, n - 1 - pos AS pos FROM c")
def reorder(spark, d):
    c = _cust(spark, d)
    n = c.count()
    index = c.select("pos", (F.lit(n - 1) - F.col("pos")).alias("new_pos"))
    return L.take_positions(c, index).select("c_custkey", "pos")


@query("inverse_permutation", f"WITH {CUST} SELECT pos, n - 1 - pos AS new_pos FROM c")
def inverse_permutation(spark, d):
    c = _cust(spark, d)
    n = c.count()
    return L.inverse_permutation(c.select("pos", (F.lit(n - 1) - F.col("pos")).alias("new_pos"))).select("pos", "new_pos")


@query("slice_step", f"WITH {CUST} SELECT c_custkey FROM c WHERE pos >= 5 AND pos < 500 AND (pos - 5) % 3 = 0")
def slice_step(spark, d):
    return L.take_slice(_cust(spark, d), 5, 500, 3).select("c_custkey")


@query("index_select", f"WITH {CUST}, i AS (SELECT pos AS new_pos, (pos * 7) % n AS pos FROM c) SELECT c.c_custkey, i.new_pos AS pos FROM i JOIN c USING (pos)")
def index_select(spark, d):
    c = _cust(spark, d)
    n = c.count()
    return L.take_positions(c, c.select(F.col("pos").alias("new_pos"), (F.col("pos") * 7 % n).alias("pos"))).select("c_custkey", "pos")


@query("fold_rows", f"WITH {CUST} SELECT pos // 4 AS pos, string_agg(c_custkey::VARCHAR, ',' ORDER BY pos) AS keys FROM c GROUP BY pos // 4")
def fold_rows(spark, d):
    return L.fold(_cust(spark, d), 4, "c_custkey").select("pos", F.array_join("c_custkey", ",").alias("keys"))


@query("unfold_rows", f"WITH {CUST} SELECT c_custkey, pos // 4 * 4 + least(3, n - 1 - pos // 4 * 4) - pos % 4 AS pos FROM c")
def unfold_rows(spark, d):
    # Each folded row's array is turned round before it is unfolded.
    return L.unfold(L.fold(_cust(spark, d), 4, "c_custkey").withColumn("c_custkey", F.reverse("c_custkey")), 4, "c_custkey").select("c_custkey", "pos")


@query("unfold_column_chunks", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, (i // 16)::INT AS piece, round(sum(x), 5) AS total FROM e GROUP BY vec_id, i // 16")
def unfold_column_chunks(spark, d):
    out = L.unfold_columns(table(spark, d, "embeddings").select("vec_id", "embedding"), 16, "embedding")
    return out.select("vec_id", "piece", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("transpose_samples", "SELECT user_id AS uid, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def transpose_samples(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("uid"), F.struct("ts", "event_id").alias("k"), F.col("event_id").alias("response"))
    return L.transpose(rows).select("uid", F.array_join("responses", ",").alias("ids"))


@query("column_union", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def column_union(spark, d):
    c = table(spark, d, "customer")
    return L.column_union(c.select("c_custkey", "c_nationkey", "c_acctbal"), c.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("concat_batches", "SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_batches(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return L.concat(a, table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id")))


@query("distinct_uids", "SELECT DISTINCT user_id AS uid FROM events")
def distinct_uids(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("uid")).distinct()


@query("pop_rename", "SELECT c_custkey AS id, c_name AS label FROM customer")
def pop_rename(spark, d):
    taken, _ = L.pop(table(spark, d, "customer"), "c_custkey", "c_name")
    return L.rename(taken, ["c_custkey", "c_name"], ["id", "label"])


@query("semi_join_uids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_uids(spark, d):
    kept = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(kept, "o_custkey", "left_semi").select("o_orderkey")


@query("anti_join_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_resume(spark, d):
    from ..sources.io import without_done

    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return without_done(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("tool_run_merge", "WITH g AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*)::BIGINT AS n FROM r GROUP BY user_id, run")
def tool_run_merge(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return L.run_merge(e, "user_id", "at", "event_type").groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


def _ids(spark, d):
    t = tokens(spark, d).select("uid", "pos", F.col("se").cast("int").alias("x"))
    return S.to_arrays(t, ["uid"], ["x"])


_SEQ = f"WITH {TOKENS}, n AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM t)"


@query("pad_left", f"{_SEQ} SELECT uid, repeat('9', greatest(0, 10 - any_value(n))::INT) || string_agg(se::INT::VARCHAR, '' ORDER BY pos) AS ids FROM n GROUP BY uid")
def pad_left(spark, d):
    return _ids(spark, d).select("uid", F.array_join(R.pad("x", 10, 9, left=True).cast("array<string>"), "").alias("ids"))


@query("pad_right", f"{_SEQ} SELECT uid, string_agg(se::INT::VARCHAR, '' ORDER BY pos) || repeat('9', greatest(0, 10 - any_value(n))::INT) AS ids FROM n GROUP BY uid")
def pad_right(spark, d):
    return _ids(spark, d).select("uid", F.array_join(R.pad("x", 10, 9).cast("array<string>"), "").alias("ids"))


@query("truncate_sides", f"{_SEQ} SELECT uid, coalesce(string_agg(se::INT::VARCHAR, '' ORDER BY pos) FILTER (pos < 4), '') AS keep_left, coalesce(string_agg(se::INT::VARCHAR, '' ORDER BY pos) FILTER (pos >= n - 4), '') AS keep_right, coalesce(string_agg(se::INT::VARCHAR, '' ORDER BY pos) FILTER (n <= 4 OR pos < 2 OR pos >= n - 2), '') AS keep_both FROM n GROUP BY uid")
def truncate_sides(spark, d):
    cut = lambda how: F.array_join(R.truncate("x", 4, how).cast("array<string>"), "")
    return _ids(spark, d).select("uid", cut("right").alias("keep_left"), cut("left").alias("keep_right"), cut("middle").alias("keep_both"))


@query("remove_padding", f"WITH {TOKENS} SELECT uid, string_agg(se::INT::VARCHAR, '' ORDER BY pos) AS ids FROM t GROUP BY uid")
def remove_padding(spark, d):
    both = R.pad(R.pad("x", 12, 9), 15, 9, left=True)
    return _ids(spark, d).select("uid", F.array_join(R.remove_right_padding(R.remove_left_padding(both, 9), 9).cast("array<string>"), "").alias("ids"))


@query("sft_loss_mask", f"{_SEQ} SELECT uid, (any_value(n) + 3)::INT AS width, any_value(n)::INT AS n_loss FROM n GROUP BY uid")
def sft_loss_mask(spark, d):
    m = R.sft_loss_mask(F.lit(3), F.size("x"))
    return _ids(spark, d).select("uid", F.size(m).alias("width"), F.aggregate(m, F.lit(0), lambda a, v: a + v).alias("n_loss"))


@query("last_token_reward", f"{_SEQ} SELECT uid, pos, CASE WHEN pos = n - 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM n")
def last_token_reward(spark, d):
    return _ids(spark, d).select("uid", F.posexplode(R.last_token_reward(F.size("x"), F.lit(0.5))).alias("pos", "reward"))


@query("hybrid_prefix", f"{_SEQ} SELECT uid, CASE WHEN any_value(n) <= 2 THEN any_value(n) ELSE 2 + any_value(n) END::INT AS width, least(2, any_value(n))::INT AS n_prefix FROM n GROUP BY uid")
def hybrid_prefix(spark, d):
    tokens_, mask = R.hybrid_response("x", "x", F.lit(2))
    return _ids(spark, d).select("uid", F.size(tokens_).alias("width"), F.size(F.filter(mask, lambda v: v)).alias("n_prefix"))


@query("array_masks", f"WITH {TOKENS} SELECT uid, pos, greatest(sum(se) OVER (PARTITION BY uid ORDER BY pos) - 1, 0)::INT AS position_id, (coalesce(sum(se) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS response_mask FROM t")
def array_masks(spark, d):
    both = F.arrays_zip(R.position_ids("x").alias("p"), R.response_mask("x", 1).alias("m"))
    return _ids(spark, d).select("uid", F.posexplode(both).alias("pos", "z")).select("uid", "pos", F.col("z.p").alias("position_id"), F.col("z.m").alias("response_mask"))


@query("microbatch_count", "SELECT source, least(count(*), ceil(sum(n_chars) / 20000.0))::BIGINT AS k FROM documents GROUP BY source")
def microbatch_count(spark, d):
    k = F.least(F.count("*"), F.ceil(F.sum("n_chars") / 20000))
    return table(spark, d, "documents").groupBy("source").agg(k.alias("k"))


@query("snake_partition", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) SELECT source, doc_id, (CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END)::INT AS part FROM r")
def snake_partition(spark, d):
    return B.snake(table(spark, d, "documents"), 8, "source", "doc_id", "n_chars").select("source", "doc_id", "part")


@query("seqlen_imbalance", "WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), p AS (SELECT CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS part, n_chars FROM r), s AS (SELECT sum(n_chars) AS s FROM p GROUP BY part) SELECT min(s)::BIGINT AS smallest, max(s)::BIGINT AS largest, (max(s) - min(s))::BIGINT AS difference, round(avg(s), 6) AS mean FROM s")
def seqlen_imbalance(spark, d):
    return B.imbalance(B.snake(table(spark, d, "documents"), 8, "source", "doc_id", "n_chars"), length="n_chars").withColumn("mean", r6("mean"))


@query("karmarkar_karp")
def karmarkar_karp(spark, d):
    docs = table(spark, d, "documents").withColumn("batch", F.floor(F.col("doc_id") / 256))
    return B.balance_batches(docs, 8, "batch", "doc_id", "n_chars")


@query("overflow_split", f"WITH {CUST} SELECT c_custkey, 'batch' AS part FROM c WHERE pos < 400 UNION ALL SELECT c_custkey, 'buffer' FROM c WHERE pos >= 400 AND pos % 4 = 0")
def overflow_split(spark, d):
    from ..operators.groups import overflow

    batch, rest = overflow(_cust(spark, d), 100, 4)
    return batch.select("c_custkey", F.lit("batch").alias("part")).unionByName(rest.select("c_custkey", F.lit("buffer").alias("part")))


@query("tool_mask", f"""WITH {TOKENS}, e AS (SELECT uid, pos, coalesce(sum(se) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS turn FROM t)
SELECT uid, pos, CASE WHEN turn = 1 THEN 0 ELSE 1 END AS loss_mask FROM e""")
def tool_mask(spark, d):
    t = tokens(spark, d).select("uid", "pos", F.col("se").alias("is_end"))
    # Each response: assistant, two adjacent tool turns (merged into one), assistant.
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("assistant", "tool", "tool", "assistant"))])
    roles = t.select("uid").distinct().select("uid", F.inline(turns))
    return L.tool_mask(t, roles).select("uid", "pos", "loss_mask")


@query("off_policy_prompt", f"{_SEQ} SELECT uid, repeat('7', (20 - 2 - least(any_value(n), 3) - CASE WHEN any_value(n) <= 3 THEN 1 ELSE 0 END)::INT) || '88' || string_agg(se::INT::VARCHAR, '' ORDER BY pos) FILTER (pos < 3) || CASE WHEN any_value(n) <= 3 THEN '9' ELSE '' END AS ids FROM n GROUP BY uid")
def off_policy_prompt(spark, d):
    ids = R.off_policy_prompt(F.array(F.lit(8), F.lit(8)), "x", F.lit(3), 20, 7, end=9)
    return _ids(spark, d).select("uid", F.array_join(ids.cast("array<string>"), "").alias("ids"))


@query("token_split_prefixes", f"{_SEQ} SELECT uid, i::INT AS i, CASE WHEN any_value(n) = 1 THEN max(CASE WHEN pos = 0 THEN se END) ELSE max(CASE WHEN pos = i THEN se END) END::INT AS keep FROM n, (SELECT unnest(range(4)) AS i) GROUP BY uid, i")
def token_split_prefixes(spark, d):
    return _ids(spark, d).select("uid", F.posexplode(R.token_split_prefixes("x", 4)).alias("i", "keep"))
