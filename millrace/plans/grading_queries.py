"""Queries over the graders beyond the normal form: right and wrong answers of every tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from ..functions.guard import limited_udf
from ..operators import scoring as S
from .base import query, spread, table


def _cases(spark, d, *cases):
    """part rows as (id, given, truth), the k-th pair of columns for the k-th rest of the id."""
    at = (F.col("p_partkey") % len(cases) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[c[k] for c in cases]), at)
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), pick(0).alias("given"), pick(1).alias("truth"), "p_size")


def _text(*parts):
    """Columns, p_size and literal texts, joined."""
    return F.concat(*[p if not isinstance(p, str) else F.col(p).cast("string") if p == "p_size" else F.lit(p) for p in parts])


def _expected(*right: bool) -> str:
    return f"SELECT p_partkey AS id, [{', '.join(str(r).lower() for r in right)}][p_partkey % {len(right)} + 1] AS correct FROM part"


@query("grade_symbolic", _expected(True, False, True, False, True, False, True, False, True, False))
def grade_symbolic(spark, d):
    more = (F.col("p_size") + 1).cast("string")
    rows = _cases(
        spark, d, (_text("p_size", " cm"), _text("p_size")), (_text("\\frac{2}{4}"), _text("1/2")), (_text("p_size", "\\sqrt{2}"), _text("\\sqrt{2} \\cdot ", "p_size")), (_text("(1, ", "p_size", ")"), _text("[1, ", "p_size", "]")),
        (_text("p_size", "\\frac{1}{2}"), _text("p_size", "+1/2")), (_text("p_size", " million"), _text("p_size", "000000")), (_text("x + ", "p_size"), _text("p_size", "+x")), (F.concat(more), _text("p_size")),
        (_text("(\\frac{1}{3}, ", "p_size", ")"), _text("(1/3,", "p_size", ")")), (_text("a+b+c"), _text("c+b+a")),
    )
    return rows.select("id", G.symbolic_udf("given", "truth").alias("correct"))


@query("normal_answer", """SELECT p_partkey AS id, [p_size::VARCHAR, p_size || '+1/2', 'sqrt(' || p_size || ')', p_size || '000', '(1,' || p_size || ')', 'yes'][p_partkey % 6 + 1] AS normal FROM part""")
def normal_answer(spark, d):
    rows = _cases(spark, d, *[(x, F.lit("")) for x in (_text("\\$", "p_size", ".0 \\%"), _text("p_size", " \\tfrac12 hours"), _text("\\sqrt{ ", "p_size", "}"), _text("p_size", ",000 meters"), _text("\\left( 1, ", "p_size", " \\right)"), _text("\\text{Yes}"))])
    return rows.select("id", G.normal_answer_udf("given").alias("normal"))


@query("grade_boxed", _expected(True, False, True, False, False))
def grade_boxed(spark, d):
    rows = _cases(spark, d, (_text("so \\boxed{", "p_size", "}"), _text("p_size")), (_text("so ", "p_size"), _text("p_size")), (_text("\\boxed{0} \\boxed{\\frac{", "p_size", "}{7}}"), _text("\\boxed{\\frac{", "p_size", "}{7}}")), (_text("\\boxed{", "p_size", "} \\boxed{open"), _text("p_size")), (_text("\\boxed{", "p_size", "1}"), _text("p_size")))
    return rows.select("id", G.boxed_udf("given", "truth").alias("correct"))


@query("marked_answer", """SELECT p_partkey AS id, p_partkey % 4 < 3 AS found, CASE WHEN p_partkey % 4 < 3 THEN p_size::VARCHAR END AS answer FROM part""")
def marked_answer(spark, d):
    rows = _cases(spark, d, (_text("Thus the answer is x = ", "p_size"), F.lit("")), (_text("p_size", " is the answer"), F.lit("")), (_text("Answer: we get \\boxed{ ", "p_size", " }"), F.lit("")), (_text("answer: none at all"), F.lit("")))
    found = G.marked_answer_udf("given")
    return rows.select("id", found.alias("f")).select("id", "f.found", F.when(F.col("f.found"), F.col("f.answer")).alias("answer"))


@query("grade_marked", _expected(True, True, True, False, True, False, True, False))
def grade_marked(spark, d):
    rows = _cases(
        spark, d, (_text("The answer is \\boxed{", "p_size", "}."), _text("p_size")), (_text("answer: ", "p_size", "%"), _text((F.col("p_size") / 100).cast("string"))), (_text("answer: 2\\pi"), _text("6.2832")), (_text("answer: ", "p_size", "1"), _text("p_size")),
        (_text("answer: Interval.open(0, ", "p_size", ")"), _text("(0,", "p_size", ")")), (_text("answer: [0, ", "p_size", ")"), _text("(0,", "p_size", "]")), (_text("answer: \\begin{pmatrix}1&", "p_size", "\\\\3&4\\end{pmatrix}"), _text("\\begin{pmatrix} 1 & ", "p_size", " \\\\ 3 & 4 \\end{pmatrix}")), (_text("no digits"), _text("p_size")),
    )
    return rows.select("id", G.marked_udf("given", "truth").alias("correct"))


@query("verify_answer", _expected(True, True, False, True, False))
def verify_answer(spark, d):
    rows = _cases(spark, d, (_text("we get $x = ", "p_size", "$ at last"), _text("p_size")), (_text("that makes ", "p_size", "."), _text("p_size")), (_text("\\boxed{", "p_size", "1}"), _text("p_size")), (_text("\\boxed{\\{1,", "p_size", "\\}}"), _text("\\{", "p_size", ",1\\}")), (_text("nothing"), _text("p_size")))
    return rows.select("id", G.verify_udf("given", "truth").alias("correct"))


@query("think_gated_score", "SELECT p_partkey AS id, [1.0::DOUBLE, -1.0, -1.0, 1.0, -1.0][p_partkey % 5 + 1] AS score FROM part")
def think_gated_score(spark, d):
    rows = _cases(spark, d, (_text("<think>a</think> \\boxed{", "p_size", "}"), _text("p_size")), (_text("\\boxed{", "p_size", "}"), _text("p_size")), (_text("<think>\\boxed{", "p_size", "}</think> none"), _text("p_size")), (_text("<think></think>\\boxed{7}"), _text("\\boxed{7}")), (_text("<think>a</think> \\boxed{", "p_size", "1}"), _text("p_size")))
    return rows.select("id", G.think_gated_udf("given", F.array(F.lit("no"), "truth")).alias("score"))


@query("strict_box", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN ' ' || p_size END AS pred FROM part")
def strict_box(spark, d):
    rows = _cases(spark, d, (_text("\\boxed{", "p_size", "}"), _text("p_size")), (_text("\\boxed{ ", "p_size", "}"), _text("p_size")), (F.concat(_text("\\boxed{", "p_size", "}"), F.repeat(F.lit("."), 100)), _text("p_size")), (_text("\\fbox{", "p_size", "}"), _text("p_size")))
    return rows.select("id", G.strict_box("given", "truth").alias("s")).select("id", "s.score", "s.pred")


@query("boxed_other_forms", "SELECT p_partkey AS id, [p_size || ' ', p_size::VARCHAR, NULL][p_partkey % 3 + 1] AS content FROM part")
def boxed_other_forms(spark, d):
    rows = _cases(spark, d, (_text("so $\\boxed ", "p_size", " $ is it"), F.lit("")), (_text("so \\fbox{", "p_size", "} is it"), F.lit("")), (_text("so \\fbox{", "p_size"), F.lit("")))
    return rows.select("id", A.last_boxed_content("given").alias("content"))


@query("char_count_score", "SELECT p_partkey AS id, (p_partkey % 3 = 0)::INT::DOUBLE AS score FROM part")
def char_count_score(spark, d):
    rows = _cases(spark, d, (_text("\\boxed{", "p_size", "}"), _text("p_size")), (_text("\\boxed{", "p_size", ".0}"), _text("p_size")), (_text("p_size"), _text("p_size")))
    return S.score(rows.withColumn("source", F.lit("count")), {"count": "char_count"}, "source", "given", "truth").select("id", "score")


@query("score_by_version", "SELECT p_partkey AS id, (p_partkey % 4 IN (0, 3))::INT::DOUBLE AS score FROM part")
def score_by_version(spark, d):
    """Versions 3 (after thinking) and 4 (anywhere), by source."""
    rows = _cases(spark, d, (_text("<think>b</think>\\boxed{", "p_size", "}"), _text("p_size")), (_text("\\boxed{", "p_size", "1}"), _text("p_size")), (_text("\\boxed{", "p_size", "}"), _text("p_size")), (_text("\\boxed{", "p_size", "}"), _text("p_size")))
    rows = rows.withColumn("source", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return S.score(rows, {"even": S.scorer_of("even", 3), "odd": S.scorer_of("odd", 4)}, "source", "given", "truth").select("id", "score")


@query("reasoning_suite_score", "SELECT p_partkey AS id, [1.0::DOUBLE, 1.0, 0.0][p_partkey % 3 + 1] AS score FROM part")
def reasoning_suite_score(spark, d):
    names = list(S.REASONING_SUITE)
    rows = _cases(spark, d, (_text("\\boxed{", "p_size", "}"), _text("p_size")), (_text("Answer: $B$"), _text("B")), (_text("\\boxed{", "p_size", "2}"), _text("p_size")))
    source = F.element_at(F.array(F.lit(names[0]), F.lit("Idavidrein/gpqa"), F.lit(names[2])), (F.col("id") % 3 + 1).cast("int"))
    return S.score(rows.withColumn("source", source), S.REASONING_SUITE, "source", "given", "truth").select("id", "score")


@query("code_score", """SELECT p_partkey AS id, ['print(' || p_size || ')' || chr(10), 'print(1)', NULL, chr(10) || 'x', chr(10) || 'y'][p_partkey % 5 + 1] AS code,
  [0.75::DOUBLE, 0.75, 0.0, 0.0, 0.75][p_partkey % 5 + 1] AS score, [0.5::DOUBLE, 0.5, 0.0, 0.0, 0.5][p_partkey % 5 + 1] AS score_of_two FROM part""")
def code_score(spark, d):
    tests = F.lit('{"inputs": ["1"], "outputs": ["1"]}')
    rows = _cases(spark, d, (_text("```python\nold``` ```python", "print(", "p_size", ")\n``` end"), tests), (_text("a ```py\nprint(1)``` b"), tests), (_text("print(1)"), tests), (_text("```python\nx```"), F.lit('{"inputs": []')), (_text("```python\ny```"), tests))
    results = F.array(*map(F.lit, (1, 0, 1, 1)))
    return rows.select("id", G.solution_code("given").alias("code"), G.code_score("given", "truth", results).alias("score"), G.code_score("given", "truth", results, first=2).alias("score_of_two"))


@query("compile_errors", "SELECT p_partkey AS id, [[1, -4, -4, -4], [1, -1, 0, 1], [-4, -4, -4, -4]][p_partkey % 3 + 1][p_size % 4 + 1]::INT AS result FROM part")
def compile_errors(spark, d):
    forms = [F.array(*map(F.lit, x)) for x in ((1, -4, 1, 0), (1, -1, 0, 1), (-4, -2, -3, 1))]
    r = F.element_at(F.array(*forms), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(G.after_compile_error(r), (F.col("p_size") % 4 + 1).cast("int")).alias("result"))


def _sometimes_endless(key: str, size: int) -> float:
    while int(key) % 1000 == 0:
        pass
    return 1.0 if int(key) % size == 0 else 0.5


@query("limited_scores", "SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 = 0 THEN 0.0 WHEN p_partkey % p_size = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM part")
def limited_scores(spark, d):
    """A scorer that never ends for some rows: those are 0 after their time, the other rows of the batch have their scores."""
    scorer = limited_udf(_sometimes_endless, "double", 0.0, 0.3)
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), scorer(F.col("p_partkey").cast("string"), F.col("p_size")).alias("score"))
