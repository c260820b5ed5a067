"""Queries over requests, retrieval results, samplers, collation and slices of mixed batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..operators import adapters as D
from ..operators import advantages as V
from ..operators import balancing as B
from ..operators import curation as C
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import requests as Q
from ..operators import retrieval as I
from ..operators import scoring as S
from ..operators import segmentation as Z
from ..operators import stats as M
from .base import EXCHANGES, ROLLOUTS, TOKENS, UNIT, exchanges, query, r6, rollouts, spread, table, tokens

_CUST = "c AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS pos, count(*) OVER () AS n FROM customer)"
_EPS = "1e-8::DOUBLE"


def _cust(spark, d):
    return L.with_positions(table(spark, d, "customer").select("c_custkey"), "c_custkey")


# -- filters, joins, rows ---------------------------------------------------------------------------------


@query("target_length_filter", f"WITH {EXCHANGES} SELECT conv_id, turn FROM x WHERE conv_id % 3 = 0 OR len(regexp_extract_all(response, '[^ ]+')) <= 20")
def target_length_filter(spark, d):
    target = F.when(F.col("conv_id") % 3 > 0, C.messages(("assistant", "response")))
    rows = exchanges(spark, d).withColumn("target", target)
    words = F.regexp_extract_all(F.get("target", F.lit(0))["content"], F.lit("([^ ]+)"), F.lit(1))
    return C.target_length_filter(rows, words, 20).select("conv_id", "turn")


@query("failed_source_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events GROUP BY user_id HAVING max((event_type = 'purchase')::INT) = 0)")
def failed_source_rows(spark, d):
    failed = rollouts(spark, d).groupBy(F.col("uid").alias("c_custkey")).agg(F.max("score").alias("best")).where("best = 0")
    return C.source_rows(table(spark, d, "customer"), failed, "c_custkey").select("c_custkey", "c_name")


@query("drop_obsolete", "SELECT p_partkey, p_size FROM part")
def drop_obsolete(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_name").alias("responses"), F.lit(1).alias("test_score"), F.lit("x").alias("gemini_grade"))
    return rows.drop(*C.OBSOLETE)


@query("think_from_target", f"WITH {EXCHANGES} SELECT conv_id, turn, 'r: ' || response AS a, 'r: ' || response AS b FROM x")
def think_from_target(spark, d):
    """The same message list from a text and from a single message, decided by the schema."""
    rows = exchanges(spark, d).withColumns({"target": F.concat(F.lit("r: "), "response")})
    one = rows.withColumn("target", F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content")))
    a = rows.select("conv_id", "turn", C.coerce_target(rows)[0]["content"].alias("a"))
    return a.join(one.select("conv_id", "turn", C.coerce_target(one)[0]["content"].alias("b")), ["conv_id", "turn"])


@query("nested_path", "SELECT p_partkey, p_name AS question, p_brand AS content FROM part")
def nested_path(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_name").alias("question")).alias("extra_info"), C.messages(("user", "p_brand")).alias("prompt"))
    return rows.select("p_partkey", F.col("extra_info.question").alias("question"), F.col("prompt")[0]["content"].alias("content"))


@query("hoisted_fields", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS \"index\" FROM part")
def hoisted_fields(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("index")).alias("extra_info"))
    return D.hoisted(rows).select("p_partkey", "index")


@query("search_rows", "SELECT p_partkey, 'Find: ' || p_name AS content, 'search_' || p_brand AS data_source, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS truth FROM part")
def search_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("ground_truth"), F.col("p_name").alias("golden_answers"), F.col("p_brand").alias("data_source"))
    out = D.search_questions(rows, "Find: ", "train")
    return out.select(F.col("extra_info.index").alias("p_partkey"), F.col("prompt")[0]["content"].alias("content"), "data_source", F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("truth"))


@query("tool_kwargs", "SELECT p_partkey, p_name AS truth, p_size AS \"index\" FROM part")
def tool_kwargs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.struct(F.col("p_size").alias("index")).alias("extra_info"))
    return D.add_tool_arguments(rows, "calc", "p_name").select("p_partkey", F.col("extra_info.tools_kwargs.calc.create_kwargs.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"))


@query("task_dispatch", f"WITH {EXCHANGES} SELECT 'gsm8k' AS data_source, count(*)::BIGINT AS n, sum(length(response))::BIGINT AS truth FROM x UNION ALL SELECT 'math', count(*)::BIGINT, sum(length(response) + 1)::BIGINT FROM x")
def task_dispatch(spark, d):
    """Rows of two tasks through their adapters, in one table."""
    rows = exchanges(spark, d).withColumnsRenamed({"problem": "question"}).withColumns({"index": F.col("conv_id"), "answer": F.concat(F.lit("so #### "), F.length("response").cast("string"))})
    boxed = rows.select("index", F.col("question").alias("problem"), F.concat(F.lit("\\boxed{"), (F.length("response") + 1).cast("string"), F.lit("}")).alias("solution"))
    slim = [df.select("data_source", F.col("reward_model.ground_truth").cast("long").alias("t")) for df in (D.word_problems(rows, "x", "train"), D.boxed_problems(boxed, "x", "train"))]
    return C.union_all(slim).groupBy("data_source").agg(F.count("*").alias("n"), F.sum("t").alias("truth"))


@query("test_cases_merge", """SELECT p_partkey, '{"inputs":["' || p_size || '","b"],"outputs":["o","' || p_brand || '"]}' AS cases FROM part""")
def test_cases_merge(spark, d):
    case = lambda i, o: F.to_json(F.array(F.struct(i.alias("input"), o.alias("output"))))
    return table(spark, d, "part").select("p_partkey", D.merge_test_cases(case(F.col("p_size").cast("string"), F.lit("o")), case(F.lit("b"), F.col("p_brand"))).alias("cases"))


@query("compressed_cases", """SELECT p_partkey, '{"inputs":["' || p_size || '"' || CASE WHEN p_partkey % 5 > 0 THEN ',"b"' ELSE '' END || '],"outputs":["o"' || CASE WHEN p_partkey % 5 > 0 THEN ',"' || p_brand || '"' ELSE '' END || '],"fn_name":"f' || p_size || '"}' AS cases FROM part""")
def compressed_cases(spark, d):
    """Private cases come packed; every fifth blob is cut short, and its cases are missing."""
    case = lambda i, o: F.to_json(F.array(F.struct(i.alias("input"), o.alias("output"))))
    size = F.col("p_size").cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), size).alias("name"), case(size, F.lit("o")).alias("public"), D.packed_cases(case(F.lit("b"), F.col("p_brand"))).alias("blob"))
    blob = F.when(F.col("p_partkey") % 5 > 0, F.col("blob")).otherwise(F.left("blob", F.lit(40)))
    return rows.select("p_partkey", D.merge_test_cases("public", D.unpacked_cases(blob), "name").alias("cases"))


# -- layout -------------------------------------------------------------------------------------------------


@query("mini_batches", f"WITH {_CUST} SELECT c_custkey, e::INT AS epoch, (e * (n // 10) + pos // 10)::BIGINT AS step FROM c, (SELECT unnest(range(3)) AS e) WHERE pos < n // 10 * 10")
def mini_batches(spark, d):
    c = _cust(spark, d)
    n = c.count() // 10 * 10
    return L.mini_batches(c.where(F.col("pos") < n), 10, n, 3).select("c_custkey", "epoch", "step")


@query("mini_batches_seeded", f"""WITH {_CUST}, r AS (SELECT c_custkey, pos, n // 10 * 10 AS n, e FROM c, (SELECT unnest(range(2)) AS e) WHERE pos < n // 10 * 10),
o AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY md5(c_custkey || ':7:' || e), c_custkey) - 1 AS place FROM r) SELECT c_custkey, e::INT AS epoch, (e * (n // 10) + place // 10)::BIGINT AS step FROM o""")
def mini_batches_seeded(spark, d):
    c = _cust(spark, d)
    n = c.count() // 10 * 10
    return L.mini_batches(c.where(F.col("pos") < n), 10, n, 2, key="c_custkey", seed=7).select("c_custkey", "epoch", "step")


@query("sampler_shard", f"WITH {_CUST} SELECT c_custkey, pos FROM c WHERE pos % 7 = 5 UNION ALL SELECT a.c_custkey, b.last AS pos FROM (SELECT max(n) AS n, (max(n) + 6) // 7 * 7 - 7 + 5 AS last FROM c) b JOIN c a ON b.last >= b.n AND a.pos = (b.last - b.n) % b.n")
def sampler_shard(spark, d):
    c = _cust(spark, d)
    return L.shard(c, 5, 7, c.count(), drop_last=False).select("c_custkey", "pos")


@query("sampler_shard_drop_last", f"WITH {_CUST} SELECT c_custkey, pos FROM c WHERE pos % 7 = 5 AND pos < n // 7 * 7")
def sampler_shard_drop_last(spark, d):
    c = _cust(spark, d)
    return L.shard(c, 5, 7, c.count()).select("c_custkey", "pos")


@query("collate_rows", f"WITH {_CUST} SELECT pos // 8 AS batch, string_agg(c_custkey::VARCHAR, ',' ORDER BY pos) AS keys FROM c GROUP BY pos // 8")
def collate_rows(spark, d):
    rows = L.collated(L.batches(_cust(spark, d), 8), "batch", "c_custkey")
    return rows.select("batch", F.array_join(F.col("c_custkey").cast("array<string>"), ",").alias("keys"))


@query("accumulate_metrics", "SELECT user_id AS name, string_agg(event_type || '=' || event_id, ',' ORDER BY event_id) AS \"values\" FROM events GROUP BY user_id")
def accumulate_metrics(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("step"), F.concat_ws("=", "event_type", F.col("event_id").cast("string")).alias("value"))
    return L.accumulated(rows).select("name", F.array_join("values", ",").alias("values"))


@query("prompt_uid", "WITH h AS (SELECT c_custkey, md5('uid:' || c_custkey) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uid FROM h")
def prompt_uid(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.prompt_uid("c_custkey").alias("uid"))


@query("random_mask", """WITH h AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey || ':3:left'), 1, 8))::BIGINT % 6 AS z, 2 + ('0x' || substr(md5(c_custkey || ':3:valid'), 1, 8))::BIGINT % 11 AS o FROM customer)
SELECT c_custkey, repeat('0', z::INT) || repeat('1', o::INT) || repeat('0', (20 - z - o)::INT) AS mask FROM h""")
def random_mask(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(L.random_mask("c_custkey", 20, 0.6, 0.25, 0.1, seed=3).cast("array<string>"), "").alias("mask"))


@query("pair_stack", """WITH r AS (SELECT c_custkey, c_nationkey % 5 AS p, c_nationkey % 7 AS a, c_nationkey % 3 AS b FROM customer),
s AS (SELECT c_custkey, repeat('1', p::INT) || repeat('2', a::INT) || '9' AS a, repeat('1', p::INT) || repeat('3', b::INT) || '9' AS b FROM r)
SELECT c_custkey, rpad(left(a, 8), 8, '0') || '|' || rpad(left(b, 8), 8, '0') AS ids, rpad(repeat('1', least(8, length(a))::INT), 8, '0') || '|' || rpad(repeat('1', least(8, length(b))::INT), 8, '0') AS mask FROM s""")
def pair_stack(spark, d):
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select("c_custkey", *(F.array_repeat(F.lit(x), n % m).alias(c) for c, x, m in (("prompt_ids", 1, 5), ("chosen_ids", 2, 7), ("rejected_ids", 3, 3))))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r.cast("array<string>"), "")), "|")
    return Q.pair_stack(rows, 8, end=9).select("c_custkey", text("input_ids").alias("ids"), text("attention_mask").alias("mask"))


@query("finalised_request", """WITH r AS (SELECT c_custkey, repeat('1', 3) || repeat('2', (c_nationkey % 9)::INT) || CASE WHEN c_custkey % 2 = 0 THEN '78' ELSE '' END AS t FROM customer),
k AS (SELECT c_custkey, left(CASE WHEN c_custkey % 2 = 0 THEN left(t, length(t) - 2) ELSE t END, 10) AS t FROM r) SELECT c_custkey, t AS ids, left(substr(t, 4), 5) AS response_ids, length(t)::INT AS n_mask, length(left(substr(t, 4), 5))::INT AS n_response_mask FROM k""")
def finalised_request(spark, d):
    ids = F.concat(F.array_repeat(F.lit(1), 3), F.array_repeat(F.lit(2), F.col("c_nationkey") % 9), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(7), F.lit(8))).otherwise(F.array().cast("array<int>")))
    rows = table(spark, d, "customer").select("c_custkey", F.array(F.lit(1), F.lit(1), F.lit(1)).alias("prompt_ids"), ids.alias("input_ids")).withColumns({c: F.transform("input_ids", lambda _: F.lit(1)) for c in ("attention_mask", "position_ids", "loss_mask")})
    out = Q.finalised(rows, 10, 5, [7, 8])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    return out.select("c_custkey", text("input_ids").alias("ids"), text("response_ids").alias("response_ids"), F.size("loss_mask").alias("n_mask"), F.size("response_loss_mask").alias("n_response_mask"))


@query("turn_score", "SELECT p_partkey AS id, (p_partkey % 4 < 2)::INT::DOUBLE AS reward, p_partkey % 4 < 2 AS terminate FROM part")
def turn_score(spark, d):
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("it is "), n), F.concat(F.lit("#### "), n), F.concat(n, F.lit(" or 1000")), F.lit("no"))
    s = Q.turn_score(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")), n)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s")).select("id", "s.reward", "s.terminate")


@query("array_lengths_split", f"WITH {_CUST} SELECT c_custkey, pos // 5 AS batch FROM c WHERE pos < n // 5 * 5")
def array_lengths_split(spark, d):
    c = _cust(spark, d)
    n = c.count() // 5 * 5
    return L.batches(c, 5, n, drop_last=True).where(F.col("pos") < n).select("c_custkey", "batch")


@query("planned_size", "SELECT true AS positive, true AS grows")
def planned_size(spark, d):
    small, large = L.planned_bytes(table(spark, d, "nation")), L.planned_bytes(table(spark, d, "lineitem"))
    return spark.createDataFrame([(small > 0, large > small)], "positive boolean, grows boolean")


# -- balancing ------------------------------------------------------------------------------------------------


@query("greedy_partition", """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_nationkey AS x, c_custkey FROM customer), s(i, sums, part, key) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0], -1, NULL::BIGINT UNION ALL
  SELECT r.i, list_transform(range(1, 5), lambda j: s.sums[j] + CASE WHEN j = list_position(s.sums, list_min(s.sums)) THEN r.x ELSE 0 END), list_position(s.sums, list_min(s.sums)) - 1, r.c_custkey FROM s JOIN r ON r.i = s.i + 1)
SELECT key AS c_custkey, part::INT AS part FROM s WHERE i > 0""")
def greedy_partition(spark, d):
    return B.greedy_sequence(table(spark, d, "customer"), 4, "c_custkey", "c_nationkey").select("c_custkey", "part")


@query("checked_partitions", "WITH b AS (SELECT c_custkey // 64 AS batch, count(*) AS n FROM customer GROUP BY 1) SELECT batch, n::BIGINT AS n, n::BIGINT AS n_distinct, least(n, 5)::BIGINT AS n_parts, true AS close FROM b")
def checked_partitions(spark, d):
    """Per batch: every item once, no part empty, and no two parts farther apart than the largest item."""
    rows = table(spark, d, "customer").withColumn("batch", F.floor(F.col("c_custkey") / 64))
    parts = B.micro_batches(rows, 1 << 40, at_least=5, batch="batch", item="c_custkey", length="c_nationkey")
    sums = parts.groupBy("batch", "part").agg(F.sum("c_nationkey").alias("s"), F.max("c_nationkey").alias("most")).groupBy("batch").agg((F.max("s") - F.min("s") <= F.max("most")).alias("close"))
    return parts.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_distinct"), F.count_distinct("part").alias("n_parts")).join(sums, "batch")


# -- statistics -------------------------------------------------------------------------------------------------


@query("sequence_means", f"WITH {TOKENS} SELECT uid, round(sum(reward * m) / nullif(sum(m), 0), 6) AS mean_reward, round(sum(exp(logp) * m) / nullif(sum(m), 0), 6) AS mean_prob FROM t GROUP BY uid")
def sequence_means(spark, d):
    out = M.sequence_means(tokens(spark, d), ["reward", F.exp("logp")])
    return out.select("uid", r6("mean_reward").alias("mean_reward"), r6("mean_1").alias("mean_prob"))


def _slice_sql() -> str:
    parts = {"on": "NOT off", "off_standard": "off AND NOT sx", "off_se": "sx"}
    cols = []
    for name, v in (("prob", "exp(logp)"), ("ratio", "greatest(1e-3::DOUBLE, least(10.0::DOUBLE, exp(logp - old)))")):
        for part, cond in parts.items():
            w = f"(CASE WHEN {cond} THEN m ELSE 0 END)"
            mean = f"(sum({v} * {w}) / (sum({w}) + {_EPS}))"
            cols += [f"round({mean}, 6) AS {name}_{part}_mean", f"round((sum({v} * {v} * {w}) - 2 * {mean} * sum({v} * {w}) + {mean} * {mean} * sum({w})) / (sum({w}) + {_EPS}), 6) AS {name}_{part}_var"]
    return f"WITH {TOKENS}, f AS (SELECT *, max(p) OVER (PARTITION BY uid) = 1 AS off, max(se) OVER (PARTITION BY uid) = 1 AS sx FROM t) SELECT {', '.join(cols)} FROM f"


@query("slice_moments", _slice_sql())
def slice_moments(spark, d):
    out = M.slice_moments(tokens(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("weighted_resample", f"""WITH {ROLLOUTS}, w AS (SELECT uid, k, value * value + 1e-8::DOUBLE AS weight, (row_number() OVER (ORDER BY uid, k) - 1) AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, sum(weight) OVER (ORDER BY pos) / sum(weight) OVER () AS hi, coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER () AS lo FROM w),
u AS (SELECT pos AS draw, {UNIT.format(seed='resample', key='pos')} AS u FROM w) SELECT u.draw::BIGINT AS draw, s.uid, s.k FROM u JOIN s ON u.u >= s.lo AND u.u < s.hi""")
def weighted_resample(spark, d):
    rows = V.weights_pf_ppo(rollouts(spark, d).select("uid", "k", "value"), "pow", 2.0, "value")
    return V.resample(rows, ["uid", "k"]).select("draw", "uid", "k")


@query("sampled_prefix_ratio", f"""WITH k AS (SELECT c_custkey, i FROM customer, (SELECT unnest(range(4)) AS i)) SELECT c_custkey, i::INT AS i, round(CASE WHEN i < 2 THEN 0.4 * {UNIT.format(seed=5, key="c_custkey || ':' || i")} ELSE 0 END, 9) AS own,
  round(CASE WHEN i < 2 THEN 0.48 * {UNIT.format(seed=5, key="c_custkey")} ELSE 0 END, 9) AS shared, round(0.2 + i * 0.2, 9) AS fixed FROM k""")
def sampled_prefix_ratio(spark, d):
    """Two of four samples with a prefix, at step 151 of 300 with 0.8 as the largest ratio; fixed steps from 0.2 to 0.8."""
    most, back = R.ratio_window(151, 300, 0.8, "linear_max"), R.ratio_window(151, 300, 0.8, "reverse_linear")
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    fixed = F.get(F.array(*map(F.lit, R.fixed_ratios(4, 0.2, 0.8))), F.col("i"))
    return rows.select("c_custkey", "i", r6(R.prefix_ratio("c_custkey", "i", 2, *most, seed=5), 9).alias("own"), r6(R.prefix_ratio("c_custkey", "i", 2, *back, seed=5, shared=True), 9).alias("shared"), r6(fixed, 9).alias("fixed"))


@query("validation_metrics")
def validation_metrics(spark, d):
    """mean, std, best, worst and majority at every rung, by resampling; numpy's stream, so no SQL: tests hold it."""
    rows = rollouts(spark, d).withColumn("data_source", F.when(F.col("uid") % 2 == 0, "even").otherwise("odd"))
    return E.full_validation_metrics(rows, ["value", "score"], pred="event_type").withColumn("value", r6("value"))


# -- retrieval ----------------------------------------------------------------------------------------------------


@query("encoder_input", "SELECT item_id, 'query: ' || text AS e5_query, 'passage: ' || text AS e5_passage, 'Represent this sentence for searching relevant passages: ' || text AS bge_query, text AS bge_passage, text AS other FROM benchmark")
def encoder_input(spark, d):
    return table(spark, d, "benchmark").select("item_id", I.encoder_input("text", "E5-base").alias("e5_query"), I.encoder_input("text", "e5", False).alias("e5_passage"), I.encoder_input("text", "bge-m3").alias("bge_query"), I.encoder_input("text", "bge", False).alias("bge_passage"), I.encoder_input("text", "dpr").alias("other"))


@query("document_lookup", "WITH h AS (SELECT b.item_id, d.doc_id, d.text, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id DESC) AS rank FROM benchmark b JOIN documents d ON d.doc_id % 50 = b.item_id % 50) SELECT item_id, string_agg(rank || '=' || text, '|' ORDER BY rank) AS results FROM h WHERE rank <= 3 GROUP BY item_id")
def document_lookup(spark, d):
    """The three best hits of each item, scored by the document's number among those of its remainder, with their texts."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 50).alias("r"))
    best = Window.partitionBy("r").orderBy(F.desc("doc_id"))
    hits = docs.select("doc_id", (F.col("doc_id") % 50).alias("r")).withColumn("rank", F.row_number().over(best)).where("rank <= 3")  # the same for all items of a remainder
    out = I.with_documents(hits.join(items, "r").select("item_id", "doc_id", F.col("doc_id").cast("double").alias("score"), "rank"), docs, "item_id")
    return out.select("item_id", F.array_join(F.transform("results", lambda x: F.concat(x["rank"].cast("string"), F.lit("="), x["document"])), "|").alias("results"))


@query("search_status", """WITH q AS (SELECT c_custkey % 40 AS batch, c_custkey, CASE c_custkey % 40 % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE c_custkey % 3 END AS n FROM customer),
b AS (SELECT batch, count(*)::BIGINT AS query_count, CASE batch % 4 WHEN 3 THEN 'api_error' WHEN 1 THEN 'unknown_api_state' ELSE CASE WHEN sum(greatest(n, 0)) = 0 THEN 'no_results' ELSE 'success' END END AS status, sum(greatest(n, 0))::BIGINT AS total,
  string_agg(CASE WHEN n > 0 THEN array_to_string(list_transform(range(1, n + 1), lambda i: 'Doc ' || i || ' (Title: t' || i || ')' || chr(10) || 'body'), chr(10) || chr(10)) END, chr(10) || '---' || chr(10) ORDER BY c_custkey) AS t FROM q GROUP BY batch)
SELECT batch, query_count, status, CASE WHEN status = 'success' THEN total ELSE 0 END AS total_results, '{"result":"' || CASE status WHEN 'api_error' THEN 'Search error: down' WHEN 'unknown_api_state' THEN 'Unknown API state (no response and no error message).' WHEN 'no_results' THEN 'No search results found.' ELSE replace(t, chr(10), '\\n') END || '"}' AS result_text FROM b""")
def search_status(spark, d):
    key = F.col("c_custkey")
    n = F.when(key % 40 % 4 == 0, 0).otherwise(key % 3).cast("int")
    docs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("t"), i.cast("string"), F.lit("\nbody")))
    rows = table(spark, d, "customer").select((key % 40).alias("batch"), key.alias("k"), F.when(key % 40 % 4 != 1, docs).alias("results"), F.when(key % 40 % 4 == 3, "down").alias("error"))
    return I.search_results(rows, "batch")


# -- tokens, scorers from files --------------------------------------------------------------------------------------


@query("segment_units", """WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).*?\\n\\n+|(?s).+'), lambda x: length(x)) AS n FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(n) = 0 THEN [0] ELSE list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT) END, ',') AS ends FROM p""")
def segment_units(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Z.with_boundaries(docs, unit="paragraph").select("doc_id", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ends"))


def _vocabulary(path: str | None = None) -> str:
    """A tokenizer file that every worker can read at the same path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


@query("token_round_trip", "SELECT item_id, text, length(text) > 0 AS some FROM benchmark")
def token_round_trip(spark, d):
    """Texts through ids and back."""
    rows = Z.encoded(table(spark, d, "benchmark").select("item_id", "text"), "text", _vocabulary())
    back = Z.decoded(rows.drop("text"), "ids", _vocabulary())
    return back.select("item_id", "text", (F.size("ids") > 0).alias("some"))


@query("tokenizer_split_points", f"WITH {EXCHANGES} SELECT conv_id, turn, true AS from_zero, true AS grows, true AS whole FROM x")
def tokenizer_split_points(spark, d):
    """Split points by a tokenizer's offsets, against the number of ids: they begin at 0, grow, and end with the whole text."""
    rows = Z.with_split_points(spread(exchanges(spark, d).select("conv_id", "turn", "response")), "response", stages=4, token_ends=Z.FileOffsets(_vocabulary()))
    p = F.col("token_split_points")
    rows = Z.encoded(rows, "response", _vocabulary())
    grows = F.forall(F.sequence(F.lit(1), F.lit(3)), lambda i: F.get(p, i) >= F.get(p, i - 1))
    return rows.select("conv_id", "turn", (F.get(p, F.lit(0)) == 0).alias("from_zero"), grows.alias("grows"), (F.element_at(p, -1) == F.size("ids")).alias("whole"))


@query("custom_scorer", "SELECT p_partkey AS id, (length(p_name) > 10)::INT::DOUBLE * 2 AS score FROM part")
def custom_scorer(spark, d):
    """A scorer from a user's file, with an argument of its own."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # read by the driver while it builds the plan, and by nobody else
        path = os.path.join(folder, "mine.py")
        with open(path, "w") as f:
            f.write("from pyspark.sql import functions as F\n\n\ndef mine(response, truth, worth=1.0):\n    return F.when(F.length(response) > truth, worth).otherwise(0.0)\n")
        fn = S.load_scorer(path, "mine", worth=2.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fn(F.col("p_name"), F.lit(10)).alias("score"))


@query("leak_before_split", f"WITH {EXCHANGES} SELECT conv_id, turn, conv_id % 3 = 2 AS leaked FROM x")
def leak_before_split(spark, d):
    """A box at the end: the last split point is before it, after another box, or behind it."""
    box = F.concat(F.lit(" \\boxed{"), F.length("response").cast("string"), F.lit("}"))
    think = F.concat(F.lit("\\boxed{no} "), "response", F.lit(" so"), box, F.lit(" done"))
    rows = exchanges(spark, d).select("conv_id", "turn", think.alias("think"), F.concat(think, F.lit("</think> Answer:"), box).alias("full"))
    points = F.element_at(F.array(F.array(F.lit(0)), F.array(F.lit(0), F.lit(5)), F.array(F.lit(0), F.lit(1_000_000))), (F.col("conv_id") % 3 + 1).cast("int"))
    return Z.leaks_before_split(rows.withColumn("token_split_points", points)).select("conv_id", "turn", "leaked")


@query("reward_managers", "SELECT p_partkey AS id, (p_partkey % 2 = 0)::INT::DOUBLE AS naive, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE (p_partkey % 2 = 0)::INT END::DOUBLE AS prime, round((p_partkey % 2 = 0)::INT + least(-(p_size - 20) / 20.0, 0), 6) AS dapo, (p_partkey % 2 = 0)::INT::DOUBLE AS math FROM part")
def reward_managers(spark, d):
    n = F.col("p_size").cast("string")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("box").alias("data_source"), F.concat(F.lit("\\boxed{"), F.when(F.col("p_partkey") % 2 == 0, n).otherwise(F.concat(n, F.lit("1"))), F.lit("}")).alias("response"), n.alias("truth"), F.col("p_size").alias("length"))
    some = rows.withColumn("data_source", F.when(F.col("id") % 5 == 0, "unknown").otherwise("box"))
    parts = {
        "naive": S.managed(rows, "naive", {"box": "math"}), "prime": S.managed(some, "prime", {"box": "math"}),
        "dapo": S.managed(rows, "dapo", {"box": "math"}, limit=40, buffer=20).withColumn("score", r6("score")), "math": S.managed(rows, "math", {"box": ""}, version=4),
    }
    out = None
    for name, df in parts.items():
        mine = df.select("id", F.col("score").alias(name))
        out = mine if out is None else out.join(mine, "id")
    return out


@query("imbalance_report", "WITH s AS (SELECT doc_id % 3 AS a, n_chars, doc_id FROM documents), b AS (SELECT a, sum(n_chars) AS s FROM s GROUP BY a), r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rn FROM s), z AS (SELECT CASE WHEN rn // 3 % 2 = 0 THEN rn % 3 ELSE 2 - rn % 3 END AS p, sum(n_chars) AS s FROM r GROUP BY 1) SELECT (SELECT min(s) FROM b)::BIGINT AS smallest, (SELECT max(s) FROM b)::BIGINT AS largest, (SELECT max(s) - min(s) FROM b)::BIGINT AS difference, round((SELECT avg(s) FROM b), 4) AS mean, (SELECT min(s) FROM z)::BIGINT AS balanced_smallest, (SELECT max(s) FROM z)::BIGINT AS balanced_largest")
def imbalance_report(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"), F.lit(0).alias("batch"), (F.col("doc_id") % 3).alias("before"))
    return B.imbalance_report(B.snake(rows, 3), "before", "part").withColumn("mean", F.round("mean", 4))


@query("token_budget_batches", "WITH b AS (SELECT doc_id // 128 AS batch, count(*) AS n, least(count(*), ceil(sum(n_chars) / 40000.0))::BIGINT AS k FROM documents GROUP BY 1) SELECT batch, n::BIGINT AS n_items, k AS n_parts FROM b")
def token_budget_batches(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 128).alias("batch"), "doc_id", F.col("n_chars").alias("length"))
    return B.micro_batches(rows, 40000).groupBy("batch").agg(F.count_distinct("doc_id").alias("n_items"), F.count_distinct("part").alias("n_parts"))


@query("balanced_order", "WITH b AS (SELECT doc_id // 8 AS batch, count(*) AS n FROM documents GROUP BY doc_id // 8) SELECT batch, n::BIGINT AS n_items, n::BIGINT AS n_places, (n - 1)::BIGINT AS last, 2::BIGINT AS largest_part FROM b WHERE n = 8")
def balanced_order(spark, d):
    """Every item of a batch of eight has one place, and each of four parts holds two."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), "doc_id", F.col("n_chars").alias("length"))
    whole = rows.groupBy("batch").count().where("count = 8").select("batch")
    ordered = B.balanced_order(rows.join(whole, "batch"), 4)
    sizes = ordered.groupBy("batch", "part").agg(F.count("*").alias("c")).groupBy("batch").agg(F.max("c").alias("largest_part"))
    return ordered.groupBy("batch").agg(F.count_distinct("doc_id").alias("n_items"), F.count_distinct("pos").alias("n_places"), F.max("pos").alias("last")).join(sizes, "batch")


@query("off_policy_output", """WITH r AS (SELECT c_custkey, c_nationkey % 5 AS p, c_nationkey % 9 AS a FROM customer), s AS (SELECT *, least(p, 4) AS np, least(a, 6) AS na FROM r)
SELECT c_custkey, repeat('0', (4 - np)::INT) || repeat('1', np::INT) || repeat('2', na::INT) || repeat('0', (6 - na)::INT) AS ids, repeat('0', (4 - np)::INT) || repeat('1', (np + na)::INT) || repeat('0', (6 - na)::INT) AS attention, na::INT AS n_prefix, (9 - (4 - np))::INT AS last_position FROM s""")
def off_policy_output(spark, d):
    n = F.col("c_nationkey")
    out = R.off_policy_output(F.array_repeat(F.lit(1), n % 5), F.array_repeat(F.lit(2), n % 9), 4, 6, 0)
    text = lambda c: F.array_join(out[c].cast("array<string>"), "")
    return table(spark, d, "customer").select("c_custkey", text("input_ids").alias("ids"), text("attention_mask").alias("attention"), F.size(F.filter(out["prefix_mask"], lambda x: x)).alias("n_prefix"), F.element_at(out["position_ids"], -1).alias("last_position"))
