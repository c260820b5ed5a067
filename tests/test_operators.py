"""Operators: fixtures with known results, edge cases, errors."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import adapters as D
from millrace.operators import advantages as V
from millrace.operators import balancing as B
from millrace.operators import curation as C
from millrace.operators import evaluation as E
from millrace.operators import groups as G
from millrace.operators import layout as L
from millrace.operators import losses as X
from millrace.operators import scoring as S
from millrace.operators import segmentation as Z
from millrace.operators import stats as M
from millrace.operators.registry import Registry


def frame(spark):
    return spark.createDataFrame([(i, o, x) for i, (o, x) in enumerate(zip([1, 2, 3, 4, 5, 6], "abcdef", strict=True))], "pos long, obs long, label string")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_reorder_repeat_chunk_pad(spark):
    df = frame(spark)
    index = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "new_pos long, pos long")
    assert column(L.take_positions(df, index), "obs") == [4, 5, 3, 1, 2, 6]
    small = L.take_slice(df, 0, 3)
    assert "".join(column(L.repeat(small, 2), "label")) == "aabbcc"
    assert "".join(column(L.repeat(small, 2, interleave=False), "label")) == "abcabc"
    assert column(L.chunk(df, 2, 6), "chunk") == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError, match="divide"):
        L.chunk(df, 4, 6)
    for divisor, pads in ((2, 1), (3, 0), (7, 4)):
        padded = L.pad_to_divisor(small, divisor, 3)
        assert padded.count() == 3 + pads and column(padded, "label") == [x for x, _ in zip(itertools.cycle("abc"), range(3 + pads), strict=False)]
        assert column(L.unpad(padded), "obs") == [1, 2, 3]
    assert column(L.unfold(L.fold(df, 3, "label"), 3, "label"), "label") == list("abcdef")
    with pytest.raises(KeyError):
        L.pop(df, "nope")
    with pytest.raises(ValueError):
        L.concat(df, df.drop("obs"))
    with pytest.raises(Exception, match="label differs"):
        L.column_union(df, df.withColumn("label", F.lit("z")), "pos").collect()
    assert L.column_union(df, df.drop("obs"), "pos").count() == 6


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = L.with_positions(df, "x", partitions=5).orderBy("x").collect()
    assert [r["pos"] for r in got] == list(range(1000))


def test_majority_and_bootstrap(spark):
    votes = spark.createDataFrame([("u", 0, "A", 0.9), ("u", 1, "B", 0.8), ("u", 2, "B", 0.7), ("u", 3, "A", 0.6)], "uid string, k int, pred string, score double")
    assert E.majority(votes, ["uid"]).first()["value"] == 0.9
    (mean, _), (top, _) = E.bootstrap([1, 2, 3, 4, 5], 3, [np.mean, max], 100)
    assert abs(mean - 3) < 0.3 and 3.5 < top < 5
    with pytest.raises(ValueError):
        E.bootstrap([], 3, [max])
    assert E.ladder(8) == [2, 4, 8] and E.ladder(6) == [2, 4, 6] and E.ladder(1) == []
    exact = E.order_statistic_mean(votes, ["uid"], 3).first()["best_at_3"]
    many = E.bootstrap([0.9, 0.8, 0.7, 0.6], 3, [max], 20000)[0][0]
    assert abs(exact - many) < 0.005


def test_bootstrap_replays_the_seeded_stream(spark):
    from millrace.plans import catalog
    from millrace.plans.base import rollouts

    def replay(values, n):
        np.random.seed(42)
        drawn = [[values[i] for i in np.random.choice(len(values), size=n, replace=True)] for _ in range(1000)]
        best, worst = [max(x) for x in drawn], [min(x) for x in drawn]
        return np.mean(best), np.std(best), np.mean(worst), np.std(worst)

    d = "/root/testdata/sf0.001"
    groups = {}
    for r in rollouts(spark, d).select("uid", "k", "value").orderBy("uid", "k").collect():
        groups.setdefault(r["uid"], []).append(r["value"])
    got = {r["uid"]: tuple(r)[1:] for r in catalog.QUERIES["bootstrap_best_worst"](spark, d).collect()}
    assert got.keys() == groups.keys()
    for uid in sorted(groups)[:5]:
        assert got[uid] == pytest.approx(replay(groups[uid], 4))
    # Whatever order the rows come in, samples are drawn by their place k.
    shuffled = spark.createDataFrame([("u", k, float(k * k)) for k in (4, 1, 3, 0, 2)], "uid string, k int, score double")
    assert tuple(E.bootstrap_best_worst(shuffled, ["uid"], 3).first())[1:] == pytest.approx(replay([0.0, 1.0, 4.0, 9.0, 16.0], 3))


def test_group_of_one_and_constant_group(spark):
    df = spark.createDataFrame([("a", 0, 2.0, True), ("b", 0, 1.0, True), ("b", 1, 1.0, False)], "uid string, k int, score double, on_policy boolean")
    got = {(r["uid"], r["k"]): r["advantage"] for r in V.grpo(df).collect()}
    assert got[("a", 0)] == pytest.approx(2 / (1 + 1e-6)) and got[("b", 0)] == 0
    off = df.withColumn("on_policy", F.lit(False))
    assert all(r["advantage"] is None for r in V.grpo_split(off).collect())
    with pytest.raises(Exception, match="no on-policy"):
        V.grpo_split(off, strict=True).collect()
    with pytest.raises(Exception, match="two responses"):
        V.grpo_passk(df).collect()
    assert {r["uid"] for r in G.dynamic_sampling(df).collect()} == {"a"}
    assert V.ESTIMATORS.lookup("grpo") is V.grpo
    with pytest.raises(ValueError):
        V.ESTIMATORS.lookup("none")
    r = Registry("thing")
    r.register("x")(len)
    with pytest.raises(ValueError, match="already"):
        r.register("x")(max)


def test_variance_needs_two(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False)], "v double, m boolean")
    with pytest.raises(Exception, match="two values"):
        M.moments(df, "v", "m").collect()
    assert M.ess_batch(df.withColumn("m", F.lit(False)), "v", "m").first()["ess"] == 0
    zero = M.ratio_histogram(df.where("false"), "v", "m").first()
    assert zero["ratio_mean"] == 0 and zero["bin_0"] == 0
    assert M.adaptive_kl(1.0, [(2.0, 10)], 1.0, 100.0) == [pytest.approx(1.02)]
    with pytest.raises(NotImplementedError):
        M.kl_penalty("a", "b", "full")
    with pytest.raises(ValueError):
        M.agg_loss(df, "v", "m", "other")


def test_long_and_array_forms(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [True, False]), ("b", [3.0], [True])], "uid string, x array<double>, m array<boolean>")
    back = M.to_arrays(M.to_long(df, ["uid"], ["x", "m"]), ["uid"], ["x", "m"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_log_sigmoid_is_stable(spark):
    got = spark.createDataFrame([(x,) for x in (-1000.0, 0.0, 1000.0)], "x double").select(X.log_sigmoid(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == pytest.approx([-1000.0, -0.6931471805599453, 0.0])


@pytest.mark.parametrize(("n", "k", "equal"), [(40, 4, False), (40, 4, True), (7, 7, False), (13, 3, False)])
def test_partitions(n, k, equal):
    rng = random.Random(n)
    lengths = [rng.randint(1, 5000) for _ in range(n)]
    parts = B.partitions(lengths, k, equal)
    assert sorted(i for p in parts for i in p) == list(range(n)) and all(parts)
    sums = [sum(lengths[i] for i in p) for p in parts]
    greedy = [sum(lengths[i] for i in p) for p in B.greedy(lengths, k)]
    if equal:
        assert len({len(p) for p in parts}) == 1
    else:
        assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    with pytest.raises(ValueError):
        B.partitions([1], 2)
    assert B.micro_batch_count(100, 1000, 300) == 4 and B.micro_batch_count(2, 1000, 300) == 2 and B.micro_batch_count(100, 1000, 300, divisor=3) == 6


def test_sentence_boundaries():
    text = "It is $3.14$ now. Then \\[ a = 1. \\] We go!\n\nDone"
    cuts = Z.sentence_boundaries(text)
    assert [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] == ["It is $3.14$ now. ", "Then \\[ a = 1. \\] ", "We go!\n\n", "Done"]
    assert Z.sentence_boundaries("") == [] and Z.paragraph_boundaries("") == [0] and Z.paragraph_boundaries("a\n\nb\n\n") == [3, 6]
    with pytest.raises(ValueError):
        Z.boundaries("x", "line")


def test_split_points(spark):
    text = "One two. Three four. Five six."
    assert Z.split_points(text, 3) == [0, 6, 9] and Z.split_points("", 3) == [0, 0, 0] and Z.split_points(text, ratio=0.1) == [3]
    df = spark.createDataFrame([("a\n\nbc\n\n\nd",), ("",), ("x",)], "t string")
    assert [r["y"] for r in df.select(Z.paragraph_ends("t").alias("y")).collect()] == [Z.paragraph_boundaries(r["t"]) for r in df.collect()]


def test_leaks():
    think = "We try. So the answer is \\boxed{5}. Check."
    full = f"<think>{think}</think> \\boxed{{5}}"
    kept = Z.truncate_answer(think, full)
    assert kept == "We try." and not Z.leaks(kept, Z.final_answers(full))
    first = "\\boxed{5} at once"
    assert Z.truncate_answer(first, first) == first and Z.leaks(first, ["5"])
    assert Z.final_answers("no box") == []


def test_hard_set_and_difficulty(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.51), (3, None)], "id int, m double")
    assert sorted(r["id"] for r in C.hard_set(df, 0.5, "m").collect()) == [1, 3]
    assert [r["id"] for r in C.difficulty_filter(df, 0.5, field="m").collect()] == [2]
    assert C.sample_exactly(df, 2, "id").count() == 2 and C.sample_exactly(df, 9, "id").count() == 3


def test_coerce_target(spark):
    for value, kind in (("a", "string"), (["a"], "array<string>"), (("assistant", "a"), "struct<role:string,content:string>"), ([("assistant", "a")], "array<struct<role:string,content:string>>")):
        df = spark.createDataFrame([(value,)], f"target {kind}")
        assert df.select(C.coerce_target(df).alias("t")).first()["t"][0]["content"] == "a"
    with pytest.raises(TypeError):
        C.coerce_target(spark.createDataFrame([(1,)], "target int"))


def test_dispatch_and_roles(spark):
    df = spark.createDataFrame([("a", "#### 5", "5"), ("b", "x", "y")], "data_source string, response string, truth string")
    assert [r["score"] for r in S.score(df, {"a": "gsm8k"}, unknown="null").collect()] == [1.0, None]
    with pytest.raises(Exception, match="no scorer"):
        S.score(df, {"a": "gsm8k"}).collect()
    bad = spark.createDataFrame([([("user", "a"), ("system", "b")], [1, 1])], "m array<struct<role:string,content:string>>, n array<int>")
    with pytest.raises(Exception, match="roles"):
        bad.select(D.multiturn_loss_mask("m", "n")).collect()


def test_user_scorer(tmp_path, spark):
    f = tmp_path / "mine.py"
    f.write_text("def half(r, t, by=2.0):\n    return (r == t).cast('double') / by\n")
    fn = S.load_scorer(str(f), "half", by=4.0)
    assert spark.createDataFrame([("a", "a")], "r string, t string").select(fn(F.col("r"), F.col("t")).alias("y")).first()["y"] == 0.25
    with pytest.raises(FileNotFoundError):
        S.load_scorer(str(tmp_path / "none.py"), "half")
    with pytest.raises(AttributeError):
        S.load_scorer(str(f), "nope")
