"""Queries over reasoning texts: tags, templates, schemas, filters, samples, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import text as T
from ..operators import adapters as D
from ..operators import curation as C
from ..operators import segmentation as G
from .base import UNIT, EXCHANGES, MARKED, exchanges, marked, query, r6, table

_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
SYSTEM, USER = "Solve the problem.", "Problem: {problem}\nShow {{every}} step at 100%."
EXPLAIN = "Explain.\nQ: {problem}\nT: {think}\nA: {answer}"


@query("normalize_think", f"""WITH {MARKED}, s AS (SELECT conv_id, turn, {_STRIP.format('solution')} AS t FROM y) SELECT conv_id, turn,
CASE WHEN contains(t, '<think>') AND contains(t, '</think>') THEN t WHEN contains(t, '</think>') THEN '<think>' || chr(10) || t ELSE '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || chr(10) END AS target FROM s""")
def normalize_think(spark, d):
    return marked(spark, d).select("conv_id", "turn", T.normalize_think("solution").alias("target"))


@query("split_target", f"""WITH {MARKED}, s AS (SELECT conv_id, turn, solution, instr(solution, '</think>') AS cut FROM y) SELECT conv_id, turn,
{_STRIP.format("replace(CASE WHEN cut > 0 THEN left(solution, cut - 1) ELSE solution END, '<think>', '')")} AS think, {_STRIP.format("replace(CASE WHEN cut > 0 THEN substr(solution, cut + 8) ELSE '' END, '<think>', '')")} AS solution FROM s""")
def split_target(spark, d):
    think, solution = T.split_target("solution")
    return marked(spark, d).select("conv_id", "turn", think.alias("think"), solution.alias("solution"))


@query("rewrite_prompt", f"""WITH {MARKED}, s AS (SELECT conv_id, turn, problem, solution, instr(solution, '</think>') AS cut FROM y) SELECT conv_id, turn, 'Solve the problem.' AS system, 'Problem: ' || problem || chr(10) || 'Show {{every}} step at 100%.' AS user,
{_STRIP.format("replace(CASE WHEN cut > 0 THEN substr(solution, cut + 8) ELSE '' END, '<think>', '')")} AS target, solution AS old_target FROM s""")
def rewrite_prompt(spark, d):
    rows = marked(spark, d).select("conv_id", "turn", C.messages(("system", F.lit("old")), ("user", "problem")).alias("prompt"), C.messages(("assistant", "solution")).alias("target"))
    out = C.rewrite_prompts(rows, SYSTEM, USER, "solution_only")
    return out.select("conv_id", "turn", F.col("prompt")[0]["content"].alias("system"), F.col("prompt")[1]["content"].alias("user"), F.col("target")[0]["content"].alias("target"), F.col("old_target")[0]["content"].alias("old_target"))


@query("se_prompt_build", f"""WITH {MARKED}, s AS (SELECT conv_id, turn, problem, string_split(solution, '</think>') AS p FROM y WHERE contains(solution, '</think>')) SELECT conv_id, turn,
'Explain.' || chr(10) || 'Q: ' || problem || chr(10) || 'T: ' || {_STRIP.format("replace(p[1], '<think>', '')")} || chr(10) || 'A: ' || {_STRIP.format('p[2]')} AS se_prompt FROM s""")
def se_prompt_build(spark, d):
    rows = marked(spark, d).select("conv_id", "turn", C.messages(("system", F.lit("old")), ("user", "problem")).alias("prompt"), C.messages(("assistant", "solution")).alias("target"))
    return C.explanation_prompts(rows, SYSTEM, EXPLAIN).select("conv_id", "turn", F.col("se_prompt")[1]["content"].alias("se_prompt"))


@query("extract_problem", "SELECT conv_id, max(CASE WHEN rn = 2 THEN text END) AS problem FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def extract_problem(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    prompt = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return rows.select("conv_id", T.problem_of(prompt).alias("problem"))


@query("rl_schema", f"""WITH {MARKED}, s AS (SELECT *, {_STRIP.format('solution')} AS t FROM y) SELECT 'corpus' AS data_source, problem AS user, (length(response))::VARCHAR AS ground_truth, conv_id AS idx, (turn / 2.0)::DOUBLE AS difficulty,
CASE WHEN contains(t, '<think>') AND contains(t, '</think>') THEN t WHEN contains(t, '</think>') THEN '<think>' || chr(10) || t ELSE '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || chr(10) END AS target FROM s""")
def rl_schema(spark, d):
    raw = marked(spark, d).select(F.col("problem").alias("question"), F.length("response").alias("final_answer"), "solution", F.lit("t").alias("topic"), (F.col("turn") / 2).alias("difficulty"), F.col("conv_id").alias("index"))
    rows = C.rl_rows(raw, "corpus", SYSTEM)
    return rows.select("data_source", F.col("prompt")[1]["content"].alias("user"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.index").alias("idx"), F.col("extra_info.difficulty").alias("difficulty"), F.col("target")[0]["content"].alias("target"))


@query("pick_candidate", f"WITH {EXCHANGES}, n AS (SELECT conv_id, turn, list_filter([response, '', problem], lambda c: trim(c, ' ' || chr(10) || chr(9)) <> '') AS f, response FROM x) SELECT conv_id, turn, coalesce(f[(floor({UNIT.format(seed=42, key='conv_id || chr(58) || turn')} * len(f)) + 1)::INT], response, '') AS solution FROM n")
def pick_candidate(spark, d):
    rows = exchanges(spark, d).withColumns({"a": F.col("response"), "b": F.lit(""), "c": F.col("problem")})
    return rows.select("conv_id", "turn", C.pick_candidate(F.concat_ws(":", "conv_id", "turn"), "a", "b", "c").alias("solution"))


@query("chat_template", """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS rendered FROM conversations GROUP BY conv_id""")
def chat_template(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    m = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return rows.select("conv_id", T.chat_template(m, True).alias("rendered"))


@query("strip_shared_opening", f"WITH {MARKED} SELECT conv_id, turn, CASE WHEN starts_with(solution, '<think>' || chr(10)) THEN substr(solution, 9) ELSE solution END AS target FROM y")
def strip_shared_opening(spark, d):
    return marked(spark, d).select("conv_id", "turn", T.strip_shared_opening(F.concat("problem", F.lit("<think>\n")), "solution").alias("target"))


@query("passages_to_text", "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS title, o_orderstatus AS body FROM orders) SELECT o_custkey, string_agg('Doc ' || i || ' (Title: ' || title || ')' || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS passages FROM t GROUP BY o_custkey")
def passages_to_text(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus").alias("c"))
    docs = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "c"))).alias("t"))
    return docs.select("o_custkey", T.passages_text(F.transform("t", lambda x: x["c"])).alias("passages"))


@query("media_segments", """SELECT p_partkey, '[{"type":"image"},{"type":"text","text":"' || p_name || '"},{"type":"video"},{"type":"text","text":"' || p_type || '"},{"type":"image"}]' AS segments FROM part""")
def media_segments(spark, d):
    text = F.concat(F.lit("<image>"), "p_name", F.lit("<video>"), "p_type", F.lit("<image>"))
    return table(spark, d, "part").select("p_partkey", F.to_json(T.media_segments(text)).alias("segments"))


@query("capitalize", "SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS t FROM part")
def capitalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.capitalize("p_type").alias("t"))


@query("difficulty_filter_gt", "SELECT p_partkey, p_size::DOUBLE AS difficulty FROM part WHERE p_size > 25")
def difficulty_filter_gt(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("difficulty"))
    return C.difficulty_filter(rows, 25, field="difficulty")


@query("difficulty_filter_ge", "SELECT p_partkey, p_size::DOUBLE AS difficulty FROM part WHERE p_size >= 25")
def difficulty_filter_ge(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_size").cast("double").alias("difficulty")).alias("extra_info"))
    return C.difficulty_filter(rows, 25, inclusive=True).select("p_partkey", F.col("extra_info.difficulty").alias("difficulty"))


@query("filter_stats", "SELECT count(*)::BIGINT AS n_total, count(*) FILTER (p_size <= 10)::BIGINT AS n_kept, count(*) FILTER (p_size > 10)::BIGINT AS n_dropped, round(count(*) FILTER (p_size <= 10) * 100.0 / greatest(count(*), 1), 6) AS pct_kept, min(p_retailprice) FILTER (p_size <= 10) AS kept_min, round(avg(p_retailprice) FILTER (p_size <= 10), 6) AS kept_mean, max(p_retailprice) FILTER (p_size <= 10) AS kept_max FROM part")
def filter_stats(spark, d):
    out = C.filter_stats(table(spark, d, "part"), F.col("p_size") <= 10, F.col("p_retailprice"))
    return out.withColumns({"pct_kept": r6(F.col("pct_kept").cast("double")), "kept_mean": r6("kept_mean")})


@query("difficulty_summary", "SELECT min(p_size)::DOUBLE AS lo, round(avg(p_size), 6) AS mean, max(p_size)::DOUBLE AS hi FROM part")
def difficulty_summary(spark, d):
    return table(spark, d, "part").agg(F.min("p_size").cast("double").alias("lo"), r6(F.avg("p_size")).alias("mean"), F.max("p_size").cast("double").alias("hi"))


@query("exact_sample", "SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || ':42'), p_partkey LIMIT 100")
def exact_sample(spark, d):
    return C.sample_exactly(table(spark, d, "part").select("p_partkey"), 100, "p_partkey")


@query("hash_split", "WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || ':42'), p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM h")
def hash_split(spark, d):
    train, test = C.hash_split(table(spark, d, "part").select("p_partkey"), 0.8, "p_partkey")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("head_share", "WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey FROM h WHERE rn <= round_even(n * 0.75, 0)")
def head_share(spark, d):
    return C.head_share(table(spark, d, "part").select("p_partkey"), 0.75, "p_partkey")


@query("date_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1995-08-00'")
def date_range(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", day.alias("day")).where("day >= '1995-01-01' and day < '1995-08-00'")


@query("label_not_empty", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def label_not_empty(spark, d):
    return table(spark, d, "conversations").where(F.length("text") > 0).select("conv_id", "turn")


@query("prompt_length_filter", "SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))::BIGINT AS n_tokens FROM conversations WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) <= 64")
def prompt_length_filter(spark, d):
    n = F.regexp_count("text", F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n_tokens")).where("n_tokens <= 64")


@query("target_dropout", f"WITH {EXCHANGES} SELECT conv_id || ':' || turn AS id, {UNIT.format(seed=42, key='conv_id || chr(58) || turn')} < 0.3 AS dropped FROM x")
def target_dropout(spark, d):
    rows = exchanges(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("response").alias("target"))
    return C.drop_targets(rows, 0.3, "id").select("id", F.col("target").isNull().alias("dropped"))


@query("last_user_turn", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations WHERE role = 'user') SELECT c.conv_id, u.text AS last_user FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id = c.conv_id AND u.rn = 1")
def last_user_turn(spark, d):
    return C.last_user_turn(table(spark, d, "conversations"))


@query("preference_unpivot", f"WITH {EXCHANGES} SELECT problem AS prompt, response, true AS preferred FROM x UNION ALL SELECT problem, 'no: ' || response, false FROM x")
def preference_unpivot(spark, d):
    return D.preference_to_sft(exchanges(spark, d).select(F.col("problem").alias("prompt"), F.col("response").alias("chosen"), F.concat(F.lit("no: "), "response").alias("rejected")))


@query("adapter_word_problems", f"WITH {EXCHANGES} SELECT conv_id AS idx, problem || ' Think.' AS content, length(response)::VARCHAR AS ground_truth FROM x")
def adapter_word_problems(spark, d):
    rows = exchanges(spark, d).select(F.col("conv_id").alias("index"), F.col("problem").alias("question"), F.concat("response", F.lit("#### "), F.length("response").cast("string")).alias("answer"))
    out = D.word_problems(rows, "Think.", "train")
    return out.select(F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("adapter_boxed_problems", f"WITH {EXCHANGES} SELECT conv_id AS idx, problem || ' Box it.' AS content, length(response)::VARCHAR AS ground_truth FROM x")
def adapter_boxed_problems(spark, d):
    rows = exchanges(spark, d).select(F.col("conv_id").alias("index"), "problem", F.concat("response", F.lit(" so \\boxed{"), F.length("response").cast("string"), F.lit("}")).alias("solution"))
    out = D.boxed_problems(rows, "Box it.", "train")
    return out.select(F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("adapter_completion", "SELECT p_partkey, p_brand || ': ' || p_name || ' ' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS content, (p_size % 4)::VARCHAR AS ground_truth FROM part")
def adapter_completion(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("activity_label"), F.col("p_name").alias("ctx_a"), F.concat("p_type", F.lit("[note]")).alias("ctx_b"), F.array("p_name", F.concat(F.lit("[x] "), "p_type")).alias("endings"), (F.col("p_size") % 4).cast("string").alias("label"))
    # The key rides along in the split field, which the adapter passes through.
    out = rows.select("p_partkey", *[c for c in rows.columns if c != "p_partkey"])
    keyed = out.withColumn("activity_label", F.concat(F.col("p_partkey").cast("string"), F.lit("\u0001"), "activity_label"))
    done = D.completion_choices(keyed, "train")
    content = F.col("prompt")[0]["content"]
    return done.select(F.substring_index(content, "\u0001", 1).cast("long").alias("p_partkey"), F.substring_index(content, "\u0001", -1).alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("multiple_choice", """WITH o AS (SELECT p_partkey, p_name, i, CASE i WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN 'x ' || p_brand ELSE 'y ' || p_brand END AS o, md5(p_partkey || ':42:' || i) AS h FROM part, (SELECT unnest(range(4)) AS i)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY h, o) - 1 AS spot FROM o) SELECT p_partkey, any_value(p_name) || chr(10) || chr(10) || string_agg(chr((65 + spot)::INT) || ') ' || o, chr(10) ORDER BY spot) AS prompt, max(CASE WHEN i = 0 THEN chr((65 + spot)::INT) END) AS letter FROM r GROUP BY p_partkey""")
def multiple_choice(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.concat(F.lit("x "), "p_brand").alias("w2"), F.concat(F.lit("y "), "p_brand").alias("w3"))
    return D.multiple_choice(rows, "p_partkey", "p_name", "p_brand", ["p_type", "w2", "w3"]).select("p_partkey", "prompt", "letter")


@query("multiturn_loss_mask", "WITH c AS (SELECT conv_id, turn, role, (length(text) % 7)::INT AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS n_tokens, coalesce(sum(CASE WHEN role = 'assistant' THEN n END), 0)::BIGINT AS n_loss FROM c GROUP BY conv_id")
def multiturn_loss_mask(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", (F.length("text") % 7).alias("n")))).alias("t"))
    mask = D.multiturn_loss_mask(F.transform("t", lambda x: F.struct(x["role"].alias("role"))), F.transform("t", lambda x: x["n"]))
    return rows.select("conv_id", F.size(mask).cast("long").alias("n_tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"))


@query("paragraph_boundaries", """WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '(?s).*?\\n\\n+|(?s).+'), lambda x: length(x)) AS n FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(n) = 0 THEN [0] ELSE list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT) END, ',') AS ends FROM p""")
def paragraph_boundaries(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return G.with_boundaries(docs).select("doc_id", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ends"))


@query("sentence_split_points")
def sentence_split_points(spark, d):
    return G.with_split_points(table(spark, d, "documents").select("doc_id", "text"), "text", stages=8, power=1.5).select("doc_id", "token_split_points")


@query("split_points_from_boundaries", """WITH t AS (SELECT l_orderkey AS uid, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT unnest([1, 2, 3]) AS i)
SELECT uid, i::INT AS i, CASE WHEN least(n, 10 * ceil(pow(i / 3.0, 1.5) * n / 10)) >= n THEN n ELSE 10 * ceil(pow(i / 3.0, 1.5) * n / 10) END::BIGINT AS tokens FROM t, r""")
def split_points_from_boundaries(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.sum("l_quantity").cast("long").alias("n"))
    tens = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / 10)), lambda i: F.least(i * 10, F.col("n")))
    ends = F.sequence(F.lit(1).cast("long"), F.col("n"))
    points = G.split_points_from("tens", "ends", "n", [(i / 3) ** 1.5 for i in (1, 2, 3)])
    # A cut at offset c leaves the tokens that end before it, so ends are shifted by one unit here.
    rows = t.select("uid", "n", tens.alias("tens"), ends.alias("ends")).select("uid", F.posexplode(points).alias("i", "tokens"), "n")
    return rows.select("uid", (F.col("i") + 1).alias("i"), F.when(F.col("tokens") >= F.col("n"), F.col("n")).otherwise(F.col("tokens") + 1).cast("long").alias("tokens"))


@query("prefix_schedule", "SELECT c_custkey, i::INT AS i, round(i / 7.0, 6) AS linear, CASE WHEN i = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sparse FROM customer, (SELECT unnest(range(8)) AS i)")
def prefix_schedule(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.posexplode(F.arrays_zip(R.prefix_ratios("linear", 8).alias("linear"), R.prefix_ratios("sparse", 8).alias("sparse"))).alias("i", "z"))
    return rows.select("c_custkey", "i", r6("z.linear").alias("linear"), F.col("z.sparse").alias("sparse"))


@query("leak_audit", f"WITH {EXCHANGES} SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_answers, 0::BIGINT AS n_leaked FROM x")
def leak_audit(spark, d):
    box = F.concat(F.lit("\\boxed{"), F.length("response").cast("string"), F.lit("}"))
    think = F.concat("response", F.lit(". So it is "), box, F.lit(" indeed."))
    rows = exchanges(spark, d).select(think.alias("think"), F.concat(F.lit("<think>"), think, F.lit("</think>\nThe answer: "), box).alias("full"))
    return G.audit_totals(G.leak_audit(rows))


@query("truncated_thinking", f"WITH {EXCHANGES} SELECT conv_id, turn, false AS leaked, true AS has_answer FROM x")
def truncated_thinking(spark, d):
    box = F.concat(F.lit("\\boxed{"), F.length("response").cast("string"), F.lit("}"))
    think = F.concat("response", F.lit(". So it is "), box, F.lit(" indeed."))
    rows = exchanges(spark, d).select("conv_id", "turn", think.alias("think"), F.concat(F.lit("<think>"), think, F.lit("</think>\nThe answer: "), box).alias("full"))
    return G.leak_audit(rows).select("conv_id", "turn", "leaked", "has_answer")
