"""Validation metrics, resampling, shards, tokenizer files, tracking, retrieval: against plain code."""

import collections
import os
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import advantages as V
from millrace.operators import balancing as B
from millrace.operators import evaluation as E
from millrace.operators import layout as L
from millrace.operators import requests as Q
from millrace.operators import retrieval as R
from millrace.operators import scoring as S
from millrace.operators import selection as K
from millrace.operators import segmentation as Z
from millrace.sources.tracking import BACKENDS, Tracking

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def plain_metrics(values, preds, seed=42):
    out = {f"mean@{len(values)}": np.mean(values)}
    if len(values) > 1:
        out[f"std@{len(values)}"] = np.std(values)
        for n in E.ladder(len(values)):
            rng = np.random.RandomState(seed)
            draws = [[int(i) for i in row] for row in rng.randint(0, len(values), (1000, n))]
            for name, f in (("best", max), ("worst", min)):
                got = [f(values[i] for i in row) for row in draws]
                out[f"{name}@{n}/mean"], out[f"{name}@{n}/std"] = np.mean(got), np.std(got)
            got = []
            for row in draws:
                votes = collections.Counter(preds[i] for i in row)  # ties: the first met
                top = max(votes, key=votes.get)
                got.append(next(values[i] for i in row if preds[i] == top))
            out[f"maj@{n}/mean"], out[f"maj@{n}/std"] = np.mean(got), np.std(got)
    return out


def test_validation_metrics_equal_plain_code(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"{s}{p}", k, float(rng.integers(0, 5)), str(rng.integers(0, 3)), "note") for s, p, n in (("a", 0, 5), ("a", 1, 5), ("b", 0, 1), ("b", 1, 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "data_source string, uid string, k int, score double, pred string, note string").repartition(3)
    got = {(r["data_source"], r["variable"], r["metric"]): r["value"] for r in E.full_validation_metrics(df, ["score", "note"], pred="pred").collect()}
    want = collections.defaultdict(list)
    for prompt in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == prompt]
        for m, x in plain_metrics([r[3] for r in mine], [r[4] for r in mine]).items():
            want[mine[0][0], "score", m].append(x)
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()})
    assert not any("maj" in m for _, _, m in {(r["data_source"], r["variable"], r["metric"]) for r in E.full_validation_metrics(df, ["score"]).collect()})


def test_bootstrap_takes_any_reducer():
    values = [3.0, 1.0, 2.0]
    fast, slow = E.bootstrap(values, 2, [max, min], 50), E.bootstrap(values, 2, [lambda x: max(x), lambda x: min(x)], 50)
    assert fast == slow
    with pytest.raises(ValueError):
        E.bootstrap([], 2, [max])


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([1e-8] * 50 + [1.0] * 400 + [5.0] * 100)], "i int, weight double").repartition(5)
    got = [r["i"] for r in V.resample(df, ["i"]).collect()]
    assert len(got) == 550, "as many draws as rows"
    heavy = sum(i >= 450 for i in got) / len(got)
    assert not any(i < 50 for i in got) and abs(heavy - 500 / 900) < 0.07
    assert sorted(got) == sorted(r["i"] for r in V.resample(df.repartition(2), ["i"]).collect())


@pytest.mark.parametrize("total, world", [(10, 3), (9, 3), (2, 5), (1, 4)])
def test_shards(spark, total, world):
    df = spark.range(total).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("x"))
    full = [sorted(L.shard(df, r, world, total, drop_last=False).collect()) for r in range(world)]
    assert {len(x) for x in full} == {-(-total // world)}
    want = [i % total * 10 for i in range(-(-total // world) * world)]
    assert sorted(r["x"] for s in full for r in s) == sorted(want)
    cut = [L.shard(df, r, world, total).count() for r in range(world)]
    assert cut == [total // world] * world


def test_mini_batches(spark):
    df = spark.range(12).select(F.col("id").alias("pos"))
    rows = L.mini_batches(df, 4, 12, 2, seed=1).collect()
    assert collections.Counter(r["step"] for r in rows) == dict.fromkeys(range(6), 4)
    orders = [[r["pos"] for r in sorted(rows, key=lambda r: r["place"]) if r["epoch"] == e] for e in (0, 1)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) == list(range(12))
    with pytest.raises(ValueError):
        L.mini_batches(df, 5, 12)


def test_requests_refuse_uneven_arrays(spark):
    df = spark.createDataFrame([([1], [1, 2, 3], [1, 1])], "prompt_ids array<int>, input_ids array<int>, loss_mask array<int>")
    with pytest.raises(Exception, match="different lengths"):
        Q.finalised(df, 5, 5, [], others=("loss_mask",)).collect()


def test_scorers_by_version():
    assert S.scorer_of("openai/gsm8k", 0) == "gsm8k" and S.scorer_of("other", 3) == "math_verify_think"
    with pytest.raises(NotImplementedError):
        S.scorer_of("other", 2)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files here")
def test_tokenizer_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = ["The first one. The second one is longer!\n\nA third.", "Ünïcode 😀 text. More of it. ", "", "x"]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(9, None)], "i int, ids array<int>")
    assert {r["i"]: r["text"] for r in Z.decoded(df, "ids", VOCABULARY).collect()} == {**dict(enumerate(texts)), 9: None}
    offsets = Z.FileOffsets(VOCABULARY)
    for text in texts[:2]:
        points = Z.split_points(text, stages=4, token_ends=offsets)
        assert points[0] == 0 and points[-1] == len(t.encode(text, add_special_tokens=False).ids) and points == sorted(points)

    class Broken(Z.FileOffsets):
        def __call__(self, text):
            raise ValueError("no offsets")

    counted = Z.split_points(texts[0], stages=3, token_ends=Broken(VOCABULARY))
    assert counted[0] == 0 and counted[-1] == len(ids[0]) and counted == sorted(counted)

    def refuses(text):
        raise ValueError("no offsets")

    with pytest.raises(ValueError):
        Z.split_points("a. b", token_ends=refuses)


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (200, 6)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in R.dense(df.where("vec_id < 900"), df.where("vec_id % 9 = 0 and vec_id < 200"), 5, block=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 200, 9))
    for q, found in got.items():
        s = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(200), -s)) if i != q][:5]
        assert [i for _, i, _ in sorted(found)] == order and [v for _, _, v in sorted(found)] == pytest.approx([s[i] for i in order])


def test_tracking(spark, tmp_path, capsys):
    t = Tracking(spark, ["console", "json", "parquet"], str(tmp_path))
    t.log({"loss": 1.5, "flag": True, "bad": float("nan"), "text": "no"}, 1)
    t.log({"loss": 1.0}, 2, backends=["parquet"])
    assert "step:1 - loss:1.5" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4 and spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        Tracking(spark, ["elsewhere"])
    assert set(BACKENDS) == {"console", "json", "parquet"}


@pytest.mark.parametrize("order", [("x", "id"), ("-x", "id"), ("s", "-id"), ("-s", "x", "id")])
def test_positions_of_many_rows_equal_a_sort(spark, order):
    rng = np.random.default_rng(5)
    rows = [(i, None if rng.random() < 0.1 else float(rng.choice([rng.normal(), 0.0, float("inf"), -0.5])), None if rng.random() < 0.05 else "".join(rng.choice(list("aé😀Z"), 3))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, x double, s string").repartition(3, "id")
    got = {r["id"]: r["pos"] for r in L.with_positions(df, *order).select("id", "pos").collect()}

    def key(r):
        out = []
        for o in order:
            v = r[("id", "x", "s").index(o.removeprefix("-"))]
            known = v is not None
            if isinstance(v, str):
                v = [-ord(c) for c in v] + [1] if o[0] == "-" else [ord(c) for c in v]
            elif known and o[0] == "-":
                v = -v
            out += [known if o[0] != "-" else not known, v if known else 0]
        return out

    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=key)]
    assert sorted(got.values()) == list(range(len(rows)))
    sums = L.with_running(df.withColumn("w", F.col("id") % 7), {"w": "upto"}, *order)
    assert {r["id"]: r["upto"] for r in sums.collect()} == {r[0]: t for r, t in zip(sorted(rows, key=key), np.cumsum([r[0] % 7 for r in sorted(rows, key=key)]).tolist(), strict=True)}


@pytest.mark.parametrize("partitions", [1, 200, 2000])
def test_positions_come_from_a_staged_sort_of_any_width(spark, partitions):
    df = spark.range(20_000).withColumn("x", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 13)).repartition(5)
    placed = L.with_positions(df, "x", "id", partitions=partitions)
    text = placed._jdf.queryExecution().toString()
    # Rows are joined to their partition's offset where they lie; only sizes, a row a partition and task, are exchanged.
    assert len(text) < 20_000 and "rangepartitioning" not in text and text.count("Exchange hashpartitioning(_part") == 1
    want = df.withColumn("want", F.row_number().over(Window.orderBy("x", "id")) - 1)
    assert placed.join(want, ["id", "x"]).filter("pos <> want").count() == 0 and placed.count() == 20_000


def test_positions_keep_columns_of_any_name_and_spread_ties(spark):
    df = spark.range(4000).selectExpr("1 as _part", "2 as _row", "3 as _before", "id as _of", "4 as _n", "5 as _tie")
    placed = L.with_positions(df, "_part", partitions=8)
    assert placed.columns == [*df.columns, "pos"] and sorted(r["pos"] for r in placed.collect()) == list(range(4000))
    kept = L._sorted_rows(df, ("_part",), 8)
    assert kept[0].groupBy(kept[1]).count().agg(F.max("count")).first()[0] < 2000  # one value in all rows is no single task
    assert spark.range(0).withColumn("x", F.lit(1)).transform(lambda d: L.with_positions(d, "id")).count() == 0
    sums = L.with_running(df, {"_of": "upto"}, "_of", partitions=3)
    assert sums.columns == [*df.columns, "upto"] and sums.filter("upto <> _of * (_of + 1) / 2").count() == 0


def test_selection_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(K, "FEW", 50)
    monkeypatch.setattr(K, "BUCKETS", 16)
    rng = np.random.default_rng(8)
    values = [float(rng.choice([rng.normal(), 0.25, 1e308 * rng.normal(), 5e-324, float("inf"), -float("inf"), float("nan")], p=[0.5, 0.3, 0.1, 0.02, 0.03, 0.03, 0.02])) for _ in range(2000)]
    values[7] = None
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(4)
    order = df.filter("v is not null").orderBy(F.desc("v"), "id").collect()
    for k in (1, 30, 45, 100, 150, 900, 1300, 1950, 1999):
        row = K.kth_largest(df, k, "v", "id")
        assert row["id"] == order[k - 1]["id"], k
        assert {r["id"] for r in df.filter(K.at_or_above(row, "v", "id")).collect()} == {r["id"] for r in order[:k]}
    assert K.kth_largest(df, 2000, "v", "id") is None and K.kth_largest(df, 0, "v", "id") is None and K.kth_largest(df.limit(0), 1, "v", "id") is None
    assert df.filter(K.at_or_above(None, "v", "id")).count() == 1999


def test_greedy_sequence_carries_sums_over_links(spark):
    """One sequence over the whole table, in links of 7 rows: the parts are those of the plain loop."""
    rows = [(i * 3, (i * 7919) % 23) for i in range(50)]
    df = spark.createDataFrame(rows, "c long, x int").repartition(5)
    want = {rows[i][0]: p for p, members in enumerate(B.greedy([x for _, x in rows], 4)) for i in members}
    assert {r["c"]: r["part"] for r in B.greedy_sequence(df, 4, "c", "x", rows=7).collect()} == want
    assert B.greedy_sequence(df.where("c < 0"), 4, "c", "x").count() == 0
    table = df.withColumn("x", F.col("x").cast("double"))
    assert {r["c"]: r["part"] for r in B.greedy_sequence(table, 4, "c", "x", rows=20).collect()} == want


def test_split_points_from_columns_take_halving(spark):
    """Many rising arrays against bisection, empty ones included; no look at every element."""
    rng = np.random.default_rng(3)
    cases = [(sorted(rng.choice(60, rng.integers(0, 9), False).tolist()), sorted(rng.integers(0, 60, rng.integers(0, 40)).tolist()), int(rng.integers(1, 70))) for _ in range(60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, b array<long>, e array<long>, n long")
    ratios = [0.0, 0.3, 0.8, 1.0]

    def one(b, e, n, r):
        cut = next((x for x in b if x >= r * n), b[-1] if b else 0)
        return 0 if r == 0 else len(e) if cut >= n else bisect_left(e, cut)

    points = df.select("i", Z.split_points_from("b", "e", "n", ratios).alias("p"))
    assert {x["i"]: x["p"] for x in points.collect()} == {i: [one(*c, r) for r in ratios] for i, c in enumerate(cases)}
    assert " filter(" not in points._jdf.queryExecution().optimizedPlan().toString()


def test_majority_of_many_kinds_and_of_few():
    """The most common code's first place, ties to the code met first, whatever the number of kinds; not quadratic in n."""
    rng = np.random.default_rng(5)
    for kinds, n in ((1, 3), (4, 2), (4, 9), (30, 7), (40, 64)):
        codes = rng.integers(0, kinds, (200, n))
        codes[0, 0] = kinds - 1
        votes = [collections.Counter(row.tolist()) for row in codes]
        assert E._majority_places(codes).tolist() == [row.tolist().index(max(v, key=v.get)) for row, v in zip(codes, votes, strict=True)]


def test_validation_metrics_draw_once_a_size(spark):
    """Groups of a size share their draws; nulls, missing predictions and a null source are values like others."""
    rows = [("a" if g % 3 else None, g, k, float((g * k) % 4) if (g, k) != (7, 1) else None, None if k == 2 else "xyz"[(g + k) % 3]) for g in range(12) for k in range(3 + g % 2)]
    df = spark.createDataFrame(rows, "data_source string, uid int, k int, score double, pred string")
    got = {(r["data_source"], r["variable"], r["metric"]): r["value"] for r in E.full_validation_metrics(df, ["score"], pred="pred").collect()}
    want = collections.defaultdict(list)
    for g in range(12):
        mine = [r for r in rows if r[1] == g]
        for m, x in plain_metrics([r[3] if r[3] is not None else float("nan") for r in mine], [r[4] for r in mine]).items():
            if g != 7:
                want[mine[0][0], "score", m].append(x)
    assert {k for k, v in got.items() if v != v} == {("a", "score", m) for m in plain_metrics([1.0] * 4, [1] * 4)}  # the group with a null value
    assert {k: v for k, v in got.items() if v == v} == pytest.approx({k: np.mean(v) for k, v in want.items() if k in got and got[k] == got[k]})
    assert E._draws(3, 2, 1000, 42) is E._draws(3, 2, 1000, 42)


def test_texts_are_encoded_in_bounded_groups(spark):
    """An encoding is far larger than its ids, so few texts are encoded at once; the ids are those of each text alone."""
    texts = ["word " * 3, "", "x" * (Z.ENCODED_CHARS + 5), *["a b"] * 200]
    groups = list(Z._groups(texts))
    assert sum(groups, []) == texts and max(map(len, groups)) <= 64 and all(len(g) == 1 or sum(map(len, g)) <= Z.ENCODED_CHARS for g in groups)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:2], None, *texts[3:]])], "i int, text string")
    found = {r["i"]: r["ids"] for r in Z.encoded(df, "text", VOCABULARY).collect()}
    assert found[1] == [] and found[2] is None and all(found[i] == found[3] for i in range(3, 203)) and found[0][0] != found[3][0]
