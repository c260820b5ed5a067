"""Queries over answers: extraction, normalisation, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import scoring as S
from .base import EXCHANGES, exchanges, query, r6, table


def _worked(spark, d):
    """Orders as worked answers with several numbers: id, response, truth."""
    o = table(spark, d, "orders")
    price = F.format_number(F.floor("o_totalprice"), 0)
    # Every third response has a wrong last answer, every seventh none at all.
    wrong = F.when(F.col("o_orderkey") % 3 == 0, F.lit("#### 12")).otherwise(F.concat(F.lit("#### $").substr(F.lit(1), F.lit(5)), price))
    body = F.concat(F.lit("First #### 7, then "), price, F.lit(" in all. "))
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("No idea .")).otherwise(F.concat(body, wrong)).alias("response"), F.floor("o_totalprice").cast("string").alias("truth"), "o_orderpriority")


_PRICE = "format('{:,}', floor(o_totalprice)::BIGINT)"
WORKED = f"""w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'No idea .' ELSE 'First #### 7, then ' || {_PRICE} || ' in all. ' || CASE WHEN o_orderkey % 3 = 0 THEN '#### 12' ELSE '#### ' || {_PRICE} END END AS response,
  (floor(o_totalprice)::BIGINT)::VARCHAR AS truth, o_orderpriority FROM orders)"""
_LAST = "list_extract(regexp_extract_all(response, '{0}', 1), -1)"
_STRICT = "replace(replace(" + _LAST.format("#### (\\-?[0-9\\.\\,]+)") + ", ',', ''), '$', '')"
_NUMS = "regexp_extract_all(response, '(\\-?[0-9\\.\\,]+)', 1)"


@query("gsm8k_truth", f"WITH {WORKED} SELECT id, nullif(replace(regexp_extract(response, '#### (\\-?[0-9\\.\\,]+)', 1), ',', ''), '') AS truth FROM w")
def gsm8k_truth(spark, d):
    return _worked(spark, d).select("id", A.gsm_truth("response").alias("truth"))


@query("gsm8k_strict", f"WITH {WORKED} SELECT id, {_STRICT} AS answer FROM w")
def gsm8k_strict(spark, d):
    return _worked(spark, d).select("id", A.gsm_strict("response").alias("answer"))


@query("gsm8k_flexible", f"WITH {WORKED}, n AS (SELECT id, {_NUMS} AS n FROM w) SELECT id, coalesce(list_extract(list_filter(n, lambda x: x NOT IN ('', '.')), -1), list_extract(n, 1)) AS answer FROM n")
def gsm8k_flexible(spark, d):
    return _worked(spark, d).select("id", A.gsm_flexible("response").alias("answer"))


@query("gsm8k_score", f"WITH {WORKED}, s AS (SELECT id, {_STRICT} AS a, truth FROM w) SELECT id, CASE WHEN a IS NULL THEN 0.0::DOUBLE WHEN a = truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM s")
def gsm8k_score(spark, d):
    return _worked(spark, d).select("id", A.gsm_score("response", "truth", format_score=0.1).alias("score"))


@query("dispatch_score", f"WITH {WORKED}, s AS (SELECT id, o_orderpriority, {_STRICT} AS a, {_NUMS} AS n, truth FROM w), t AS (SELECT *, coalesce(list_extract(list_filter(n, lambda x: x NOT IN ('', '.')), -1), list_extract(n, 1)) AS f FROM s) SELECT id, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN a = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN f = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM t")
def dispatch_score(spark, d):
    return S.score(_worked(spark, d), {"1-URGENT": "gsm8k", "2-HIGH": "gsm8k_flexible"}, "o_orderpriority", unknown="null").select("id", "score")


def _latex(spark, d):
    """Parts as LaTeX answers: id, answer, truth."""
    p, n = table(spark, d, "part"), F.col("p_size").cast("string")
    kinds = [F.concat(F.lit("x = \\frac"), n.substr(F.lit(1), F.lit(1)), F.lit("7 \\text{ cm}")), F.concat(n, F.lit("/4")), F.concat(F.lit("\\left( \\sqrt"), n.substr(F.lit(1), F.lit(1)), F.lit(" \\right)")), F.concat(F.lit("."), n), F.concat(n, F.lit("^{\\circ}"))]
    answer = F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), answer.alias("answer"), "p_size")


@query("math_normal_form", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '\\frac{' || left(p_size::VARCHAR, 1) || '}{7}' WHEN 1 THEN '\\frac{' || p_size || '}{4}' WHEN 2 THEN '(\\sqrt{' || left(p_size::VARCHAR, 1) || '})' WHEN 3 THEN CASE WHEN p_size = 5 THEN '\\frac{1}{2}' ELSE '0.' || p_size END ELSE p_size::VARCHAR END AS normal FROM part""")
def math_normal_form(spark, d):
    return _latex(spark, d).select("id", A.math_normal_form("answer").alias("normal"))


@query("math_score", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part WHERE NOT (p_partkey % 5 = 3 AND p_size = 5) UNION ALL SELECT p_partkey, 0.0::DOUBLE FROM part WHERE p_partkey % 5 = 3 AND p_size = 5""")
def math_score(spark, d):
    r = F.concat(F.lit("So \\boxed{1} or rather \\boxed{"), "answer", F.lit("}."))
    return _latex(spark, d).select("id", A.math_score(r, F.col("p_size").cast("string")).alias("score"))


@query("boxed_last", """WITH b AS (SELECT p_partkey, p_size, ['\\boxed{{' || p_size || '}} and \\boxed{open', '\\boxed{' || p_brand || '} \\fbox{x}', 'no box', '\\boxed{a\\boxed{' || p_size || '}}'][p_partkey % 4 + 1] AS r FROM part)
SELECT p_partkey AS id, nullif(CASE p_partkey % 4 WHEN 3 THEN regexp_extract(r, 'boxed\\{([0-9]+)\\}', 1) ELSE regexp_extract(r, 'boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1) END, '') AS content FROM b""")
def boxed_last(spark, d):
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("\\boxed{{"), n, F.lit("}} and \\boxed{open")), F.concat(F.lit("\\boxed{"), "p_brand", F.lit("} \\fbox{x}")), F.lit("no box"), F.concat(F.lit("\\boxed{a\\boxed{"), n, F.lit("}}"))]
    r = F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))
    # The last, unclosed box is unreadable for the last-box rule; all balanced spans still are.
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.try_element_at(A.all_boxed(r), F.lit(-1))["content"].alias("content"))


@query("grade_numbers", "SELECT p_partkey AS id, p_partkey % 8 < 4 AS correct FROM part")
def grade_numbers(spark, d):
    n = F.col("p_size").cast("string")
    more = (F.col("p_size") + 1).cast("string")
    right = [F.concat(n, F.lit(".0")), F.concat(n, F.lit("00\\%")), F.concat(F.lit("\\frac{"), n, F.lit("}{1}")), F.concat(F.lit("$"), n, F.lit("$"))]
    wrong = [F.concat(more, F.lit(".0")), F.concat(n, F.lit(".5")), F.concat(F.lit("\\frac{"), n, F.lit("}{3}")), F.concat(n, F.lit(" apples"))]
    form = F.element_at(F.array(*right, *wrong), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.grade_udf(form, n).alias("correct"))


@query("minerva_normalize", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'frac{' || left(p_size::VARCHAR, 1) || '}{7}' WHEN 1 THEN (p_size * 1000)::VARCHAR WHEN 2 THEN 'sqrt{' || left(p_size::VARCHAR, 1) || '}' || substr(p_size::VARCHAR, 2) ELSE p_size::VARCHAR END AS normal FROM part""")
def minerva_normalize(spark, d):
    n = F.col("p_size").cast("string")
    first = n.substr(F.lit(1), F.lit(1))
    forms = [F.concat(F.lit("y = $frac"), first, F.lit("7$ units")), F.concat(n, F.lit(",000 dollars")), F.concat(F.lit("$sqrt"), n, F.lit("$")), F.concat(F.lit("\\text{"), n, F.lit("} degrees"))]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.minerva_normalize(F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("normal"))


@query("dapo_score", f"WITH {WORKED} SELECT id, CASE WHEN id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, CASE WHEN id % 2 = 0 THEN truth ELSE '0' END AS pred FROM w")
def dapo_score(spark, d):
    w = _worked(spark, d)
    r = F.concat(F.repeat(F.lit("filler "), 60), F.lit("\nAnswer: 1\nAnswer: "), F.when(F.col("id") % 2 == 0, F.col("truth")).otherwise(F.lit("0")))
    out = A.dapo_score(r, "truth")
    return w.select("id", out["score"].alias("score"), out["pred"].alias("pred"))


_QA = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("qa_normalize", f"SELECT p_partkey AS id, {_QA.format(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ', an (a)  ' + chr(39) + ' || p_type')} AS normal FROM part")
def qa_normalize(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.qa_normalize(F.concat(F.lit("The "), "p_name", F.lit(", an (a)  "), "p_type")).alias("normal"))


@query("qa_em", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 3 = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS em, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 3 = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS subem FROM part")
def qa_em(spark, d):
    tag = F.concat(F.lit("<answer> The "), "p_name", F.lit(". </answer>"))
    r = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, tag).otherwise(F.concat(F.repeat(F.lit("<answer>x</answer>"), 11), tag))
    golds = F.array(F.col("p_brand"), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.search_score(r, golds).alias("em"), A.search_score(r, golds, contained=True).alias("subem"))


@query("answer_tag_last", f"WITH {EXCHANGES} SELECT conv_id, turn, trim(response, ' ' || chr(10)) AS answer FROM x")
def answer_tag_last(spark, d):
    r = F.concat(F.lit("<answer>no</answer> "), "problem", F.lit("<answer>\n"), "response", F.lit(" \n</answer> end"))
    return exchanges(spark, d).select("conv_id", "turn", A.answer_tag(r).alias("answer"))


@query("gpqa_letter", "SELECT p_partkey AS id, CASE WHEN p_size % 5 < 4 THEN chr((65 + p_size % 5)::INT) END AS letter FROM part")
def gpqa_letter(spark, d):
    r = F.concat(F.lit("thus answer : $"), F.char(F.lit(65) + F.col("p_size") % 5), F.lit("$ and Answer: A"))
    bad = F.concat(F.lit("answer is "), F.char(F.lit(65) + F.col("p_size") % 5))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.choice_letter(F.when(F.col("p_size") % 5 < 4, r).otherwise(bad)).alias("letter"))


@query("format_reward", f"WITH {EXCHANGES} SELECT conv_id, turn, (turn // 2) % 2 = 0 AS think, conv_id % 3 > 0 AS geo FROM x")
def format_reward(spark, d):
    even = F.floor(F.col("turn") / 2) % 2 == 0
    r = F.concat(F.when(even, "<think>\n").otherwise("<think>"), F.col("response"), F.when(F.col("conv_id") % 3 > 0, "\n</think> \\boxed{1}").otherwise("\n</think> boxed 1"))
    return exchanges(spark, d).select("conv_id", "turn", A.think_format(r).alias("think"), A.geo_format(r).alias("geo"))


@query("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000.0 * 1.0, 0.0), 6) AS penalty FROM documents")
def overlong_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(A.overlong_penalty("n_chars", 4000, 1000)).alias("penalty"))


@query("eos_suffix_strip", "WITH e AS (SELECT conv_id, turn, text || ['<|end|>', '<|end|><|end|>', '<|end|> ', ''][(conv_id + turn) % 4 + 1] AS t FROM conversations) SELECT conv_id, turn, CASE WHEN right(t, 7) = '<|end|>' THEN left(t, length(t) - 7) ELSE t END AS text FROM e")
def eos_suffix_strip(spark, d):
    ends = F.element_at(F.array(*map(F.lit, ("<|end|>", "<|end|><|end|>", "<|end|> ", ""))), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", A.strip_suffix(F.concat("text", ends), "<|end|>").alias("text"))


@query("code_block", "SELECT p_partkey AS id, 'print(' || p_size || ')' || chr(10) AS code FROM part")
def code_block(spark, d):
    code = F.concat(F.lit("print("), F.col("p_size").cast("string"), F.lit(")\n"))
    r = F.concat(F.lit("x ```python\nold\n``` then ```python\n"), code, F.lit("``` done"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.code_block(r).alias("code"))


@query("same_output", "SELECT p_partkey AS id, p_size % 2 = 0 AS same FROM part")
def same_output(spark, d):
    n = F.col("p_size").cast("string")
    got = F.concat(F.lit(" "), n, F.lit(" \n"), n, F.when(F.col("p_size") % 2 == 0, "\n").otherwise(".5"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.same_output(F.concat(n, F.lit("\n"), n), got).alias("same"))


@query("response_scores", "SELECT user_id AS uid, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_score, max(value) AS max_score FROM events GROUP BY user_id")
def response_scores(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("uid")).agg(F.collect_list("value").alias("scores"))
    out = S.response_scores(rows)
    return out.select("uid", F.size("scores").cast("long").alias("n"), r6("test_score.mean_score").alias("mean_score"), F.col("test_score.max_score").alias("max_score"))
