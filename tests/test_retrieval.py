"""BM25 and dense search against plain code, their bounds, pooling."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as R


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bm25(corpus, queries, k, k1=0.9, b=0.4):
    docs = [(i, Counter(words(t))) for i, t in corpus if i is not None]
    lengths = [sum(c.values()) for _, c in docs]
    n, mean = sum(x > 0 for x in lengths), sum(lengths) / max(1, sum(x > 0 for x in lengths))
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in queries:
        best = {}
        for (i, c), dl in zip(docs, lengths, strict=True):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * dl / mean)) for t in set(words(text)) if c[t])
            if s > 0:
                best[i] = max(best.get(i, 0), s)
        out += [(q, i, rank + 1, round(s, 6)) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])]
    return sorted(out)


def found(df, query, key):
    return sorted((r[query], r[key], r["rank"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("pairs", [1 << 20, 12])
def test_bm25_equals_plain_scores(spark, monkeypatch, pairs):
    monkeypatch.setattr(R, "PAIRS", pairs)
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" + rng.choice(["", ".", " É", "_x"]) for _ in range(n))
    corpus = [(i, text(rng.randrange(0, 60))) for i in range(400)] + [(900, None), (901, ""), (None, text(9)), (5, text(40)), *[(1000 + i, "same text twice w1") for i in range(5)]]
    queries = [(f"q{i}", text(6)) for i in range(15)] + [("none", "zzz qqq"), ("null", None), ("same", "same text"), (None, "w1")]
    df = R.bm25(spark.createDataFrame(corpus, "doc_id int, text string").repartition(3), spark.createDataFrame(queries, "item_id string, text string"), 4)
    assert found(df, "item_id", "doc_id") == plain_bm25(corpus, [q for q in queries if q[0]], 4)
    assert R.bm25(spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame(queries, "item_id string, text string"), 4).count() == 0
    assert R.bm25(spark.createDataFrame(corpus, "doc_id int, text string"), spark.createDataFrame([], "item_id string, text string"), 4).columns == ["item_id", "doc_id", "score", "rank"]


def test_blocks_are_left_out_by_their_bound():
    """Rare words lie in few blocks: once a query has its k, the others are left out."""
    rng = np.random.default_rng(4)
    best, counted = R._Best(1, 3), [0, 0]
    asked = (np.array([0, 2]), np.array([0, 1]), np.array([0.1, 5.0]))  # a frequent word, and a rare one
    for block in range(100):
        term, doc = np.zeros(128, np.int64), np.arange(128)
        if block < 5:
            term, doc = np.append(term, [1, 1]), np.append(doc, [3, 7])
        R.scored_block(asked, R.block_postings(term, doc, rng.integers(50, 200, 128), 100.0, 0.9, 0.4), np.arange(128) + 128 * block, best, counted)
    assert counted[0] == 100 and counted[1] <= 6 and set(best.kept[0][1] % 128) <= {3, 7}


def plain_dense(corpus, queries, k):
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for q in sorted({i for i, v in queries if i is not None and usable(v)}):
        v = min(v for i, v in queries if i == q and usable(v))
        best = {}
        for i, x in corpus:
            if i is not None and i != q and usable(x) and len(x) == len(v):
                best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(v, x, strict=True)))
        out += [(q, i, rank + 1, round(s, 6)) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_search_of_awkward_vectors(spark, block):
    rng = random.Random(3)
    vector = lambda n: [rng.choice([0.0, 1.0, -2.0, rng.gauss(0, 1)]) * rng.choice([1, 5]) for _ in range(n)]
    corpus = [(i, vector(4)) for i in range(300)] + [(500 + i, vector(3)) for i in range(20)]
    corpus += [(700, None), (701, []), (702, [1.0, None, 0.0, 0.0]), (703, [float("nan")] * 4), (704, [float("inf")] * 4), (None, [9.0] * 4), (8, vector(4)), (8, vector(4)), (705, [0.0] * 4)]
    queries = [r for r in corpus if r[0] is None or r[0] % 9 == 8 or r[0] >= 700 or 500 <= r[0] < 505]
    schema = "vec_id int, embedding array<float>"
    narrow = lambda rows: [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    corpus, queries = narrow(corpus), narrow(queries)
    df = R.dense(spark.createDataFrame(corpus, schema).repartition(3), spark.createDataFrame(queries, schema), 5, block=block)
    assert found(df, "query_id", "vec_id") == plain_dense(corpus, queries, 5)
    assert R.dense(spark.createDataFrame(corpus, schema), spark.createDataFrame([], schema), 5).count() == 0


def test_vectors_are_left_out_by_their_norm():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50_000, 16)) * rng.pareto(2.0, 50_000)[:, None]
    q = rng.normal(size=(40, 16))
    best, counted = R._Best(40, 10), [0, 0]
    R.nearest_products(np.full(40, -1), q, np.arange(50_000), x, best, counted)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert all(set(best.kept[i][1]) == set(want[i]) for i in range(40))
    assert counted[0] == 40 * 98 and counted[1] < 0.1 * counted[0]  # more than nine tenths of the blocks are skipped


def test_pooling(spark):
    rows = [
        (1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, None], [3.0, 4.0]], [1, 1]), (3, [], []), (4, None, None), (5, [[1.0, 2.0]], [0]),
        (6, [[3.0, 4.0], [1.0], None, [5.0, 0.0]], [1, 1, 1, 1]), (7, [[3.0, 4.0], [7.0, 7.0]], [1]), (8, [[0.0, 0.0]], [1]), (9, [[3.0, 4.0]], None),
    ]
    df = spark.createDataFrame(rows, "id int, h array<array<float>>, m array<int>")
    got = {r["id"]: r for r in df.select("id", R.pooled("h", "m", normalise=False).alias("mean"), R.pooled("h", method="cls", normalise=False).alias("cls"), R.pooled("h", "m").alias("unit"), R.pooled("h").alias("all")).collect()}
    assert [got[i]["mean"] for i in range(1, 9)] == [[2, 3], [2, 2], None, None, None, [4, 2], [3, 4], [0, 0]]
    assert got[9]["mean"] is None and got[9]["all"] == [0.6, 0.8]
    assert [got[i]["cls"] for i in (1, 2, 3, 4)] == [[1, 2], [1, 0], None, None]
    assert got[7]["unit"] == pytest.approx([0.6, 0.8]) and got[8]["unit"] == [0, 0]
    with pytest.raises(ValueError):
        R.pooled("h", method="max")


def test_title_and_text(spark):
    df = spark.createDataFrame([('"A title"\nfirst\nsecond',), ("only",), ("",), (None,), ('"\n',)], "c string")
    got = [tuple(r["p"])[:2] if r["p"] else None for r in df.select(R.title_and_text("c").alias("p")).collect()]
    assert got == [("A title", "first\nsecond"), ("only", ""), ("", ""), (None, ""), ("", "")]
