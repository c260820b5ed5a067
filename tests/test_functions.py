"""Column functions and kernels against plain restatements of their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import arrays as R
from millrace.functions import text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "<think>\n\n</think>\n\n"),
        (" a ", "<think>\na\n</think>\n\n"),
        ("a</think>b", "<think>\na</think>b"),
        ("<THINK >a</Think >b", "<THINK >a</Think >b"),
        ("<think>a", "<think>\n<think>a\n</think>\n\n"),
        ("  x\x1c", "<think>\nx\n</think>\n\n"),
    ],
)
def test_normalize_think(spark, text, want):
    assert one(spark, text, T.normalize_think) == want


@pytest.mark.parametrize("text", ["<think>a</think>b</think>c", "no tags", "</think>x", "<think>only", None, "a<think>b<think></think> c "])
def test_split_target(spark, text):
    t = text or ""
    think, _, solution = t.partition("</think>") if "</think>" in t else (t, "", "")
    want = tuple(x.replace("<think>", "").strip() for x in (think, solution))
    got = spark.createDataFrame([(text,)], "x string").select(*T.split_target("x")).first()
    assert tuple(got) == want


def test_template_is_safe(spark):
    row = spark.createDataFrame([("100% {problem} {{x}} $1",)], "p string").select(T.template("Q: {problem}\n{{keep}} %s", problem="p").alias("y")).first()
    assert row["y"] == "Q: 100% {problem} {{x}} $1\n{keep} %s"
    with pytest.raises(KeyError):
        T.template("{missing}", problem="p")


def test_rewrite_targets(spark):
    df = spark.createDataFrame([([("assistant", "<think>a</think>b"), ("user", "c</think>d")],), (None,), ([],)], "t array<struct<role:string,content:string>>")
    got = [r["y"] for r in df.select(T.rewrite_messages("t", "solution_only").alias("y")).collect()]
    assert [m["content"] for m in got[0]] == ["b", "c</think>d"] and got[1] is None and got[2] == []


def test_media_segments(spark):
    got = one(spark, "a<image>b<video><image>", T.media_segments)
    assert [(s["type"], s["text"]) for s in got] == [("text", "a"), ("image", None), ("text", "b"), ("video", None), ("image", None)]


@pytest.mark.parametrize(("text", "strict", "flexible"), [("x #### 1,234 y #### $5", "1234", "5"), ("12 and 13.5", None, "13.5"), (". ,", None, ","), ("none", None, None), ("#### -7.", "-7.", "-7.")])
def test_gsm(spark, text, strict, flexible):
    assert one(spark, text, A.gsm_strict) == strict
    assert one(spark, text, A.gsm_flexible) == flexible


def test_boxed():
    assert A.boxed_spans("a\\boxed{x{y}}b\\boxed{z") == [(1, 13, "x{y}")]
    assert [c for *_, c in A.boxed_spans("\\boxed{a\\boxed{b}}")] == ["a\\boxed{b}", "b"]
    assert A.last_boxed("\\boxed{1} \\boxed{{2}}") == "\\boxed{{2}}"
    assert A.last_boxed("\\boxed 5$ done") == "\\boxed 5"
    assert A.last_boxed("\\fbox{q}") == "\\fbox{q}" and A.last_boxed("\\boxed{open") is None and A.last_boxed("") is None
    assert A.remove_boxed("\\boxed{{2}}") == "{2}"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\dfrac{1}{2}", "\\frac{1}{2}"), ("1/2", "\\frac{1}{2}"), ("01/2", "01/2"), ("-3/4", "\\frac{-3}{4}"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"),
        ("x=3", "3"), ("abc=3", "abc=3"), ("\\sqrt3 ", "\\sqrt{3}"), ("12\\text{ cm}", "12"), ("50\\%", "50"), ("\\left(1, 2\\right)", "(1,2)"), ("45^\\circ", "45"), ("", ""), ("\\frac1", "\\frac1"), ("\\frac12 + \\frac3", "\\frac12+\\frac3"),
    ],
)
def test_math_strip(raw, want):
    assert A.math_strip(raw) == want


@pytest.mark.parametrize(("a", "b", "want"), [("0.5", "1/2", True), ("50\\%", "0.5", True), ("(1, 2)", "(1,2)", True), ("(1,2]", "(1,2)", False), ("\\frac{2}{4}", "0.5", True), ("3", "4", False), (None, "1", False), ("x+1", "x+1", True), ("333.33333", "333.33334", True)])
def test_grade(a, b, want):
    assert A.grade(a, b) is want


@pytest.mark.parametrize(("raw", "want"), [("x = \\text{12} units", "12"), ("1,000 dollars", "1000"), ("$\\frac12$", "\\frac{1}{2}"), ("sqrt3", "sqrt{3}"), ("a 5.$", "5")])
def test_minerva(spark, raw, want):
    assert one(spark, raw, A.minerva_normalize) == want


def test_qa(spark):
    assert one(spark, "The  Cat, an (animal)!", A.qa_normalize) == "cat animal"
    assert one(spark, "x <answer>a</answer> <answer>\n b\n</answer>", A.answer_tag) == "b"
    assert one(spark, "no tag", A.answer_tag) is None


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([7],)], "a array<int>")
    got = df.select(R.pad("a", 3, 0, True).alias("l"), R.truncate("a", 3, "middle").alias("m"), R.truncate("a", 2, "left").alias("t"), R.position_ids(F.transform("a", lambda x: x > 2)).alias("p"), R.response_mask("a", 3, 7).alias("r"), R.remove_left_padding(F.concat(F.array(F.lit(0)), "a"), 0).alias("u")).collect()
    assert [r["l"] for r in got] == [[1, 2, 3, 4, 5], [0, 0, 0], [0, 0, 7]]
    assert [r["m"] for r in got] == [[1, 4, 5], [], [7]]
    assert [r["t"] for r in got] == [[4, 5], [], [7]]
    assert [r["p"] for r in got] == [[0, 0, 0, 1, 2], [], [0]]
    assert [r["r"] for r in got] == [[1, 1, 1, 0, 0], [], [1]]
    assert [r["u"] for r in got] == [[1, 2, 3, 4, 5], [], [7]]


def test_truncate_error(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    with pytest.raises(Exception, match="longer than 2"):
        df.select(R.truncate("a", 2, "error")).collect()


def test_scans_against_loops(spark):
    rng = random.Random(3)
    rows = [([rng.random() for _ in range(n)], [rng.random() for _ in range(n)]) for n in (0, 1, 2, 7, 40)]
    got = spark.createDataFrame(rows, "r array<double>, v array<double>").select("r", "v", R.gae("r", "v", 0.9, 0.95).alias("a"), R.discounted_returns("r", 0.9).alias("d")).collect()
    for row in got:
        acc = nxt = total = 0.0
        a, d = [], []
        for r, v in zip(reversed(row["r"]), reversed(row["v"]), strict=True):
            acc = r + 0.9 * nxt - v + 0.9 * 0.95 * acc
            nxt, total = v, r + 0.9 * total
            a.append(acc)
            d.append(total)
        assert row["a"] == pytest.approx(a[::-1]) and row["d"] == pytest.approx(d[::-1])


def test_linspace(spark):
    assert spark.range(1).select(R.linspace(3, 2.0).alias("y")).first()["y"] == [0.0, 0.25, 1.0]
    assert spark.range(1).select(R.linspace(1).alias("y")).first()["y"] == [0.0]
    assert math.isclose(spark.range(1).select(R.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("y")).first()["y"], 11)


def test_ratio_windows(spark):
    assert R.ratio_window(0, 300, 0.8, "linear_max") == (0.0, pytest.approx(0.8))
    assert R.ratio_window(300, 300, 0.8, "linear_max") == (0.0, pytest.approx(0.08))
    assert R.ratio_window(30, 300, 0.8, "reverse_linear") == (0.0, pytest.approx(0.08))
    assert R.ratio_window(999, 300, 0.8, "reverse_linear") == (0.0, pytest.approx(0.8))
    assert R.ratio_window(150, 300, 0.8, "linear") == (pytest.approx(0.4), pytest.approx(0.4))
    with pytest.raises(ValueError):
        R.ratio_window(0, 1, 1.0, "other")
    got = [r["y"] for r in spark.range(500).select(R.sampled_ratio("id", 0.2, 0.6).alias("y")).collect()]
    assert min(got) >= 0.2 and max(got) <= 0.6 and abs(sum(got) / 500 - 0.4) < 0.03
