"""Sort-means against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np

from millrace.llm import sortmeans

from ..support import connect, rows


def plain(vectors, k, rounds, dim):
    """(vec_id, integers, cluster, distance) and the centroids, by comparing every vector with every centroid."""
    kept = []
    for vec_id, v in vectors:
        if vec_id is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v):
            kept.append((vec_id, [math.floor(256 * float(x)) for x in v]))
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        found = [min((square(v, c), i) for i, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for i in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == i]
                if mine:
                    centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(vec_id, v, c, d) for (vec_id, v), (d, c) in zip(kept, found, strict=True)], centroids


def table(spark, vectors, extra=False):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    return df.selectExpr("*", "1 as cluster", "2 as v", "3 as h", "4 as distance") if extra else df


def check(spark, vectors, k, rounds, dim, extra=False):
    want, centroids = plain(vectors, k, rounds, dim)
    got = sortmeans.clusters(table(spark, vectors, extra), k=k, rounds=rounds, dim=dim).collect()
    total, per = sum(r[3] for r in want), {}
    for r in want:
        per[r[2]] = per.get(r[2], 0) + r[3]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert sorted(tuple(r) for r in got) == sorted((i, c, d, per[c], total, digest[c]) for i, _, c, d in want)
    return got


def test_equals_plain_rounds(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(9)]
    vectors = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(700)]
    check(spark, vectors, 12, 5, 5)
    check(spark, vectors[:8], 12, 5, 5)  # fewer vectors than centroids


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rng = random.Random(2)
    grid = [(i, [float(rng.randrange(-2, 3)) / 256, float(rng.randrange(-2, 3)) / 256]) for i in range(200)]  # many equal distances
    odd = [(None, [0.0, 0.0]), (900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [float("inf"), 1.0]), (906, [1e300, 0.0]), (907, [0.0, 0.0, 0.0]), (5, [0.5, -0.5]), (5, [0.5, -0.5]), (908, [0.0, 0.0])]
    got = check(spark, grid + odd, 7, 4, 2, extra=True)
    assert len(got) == 203
    check(spark, [(7, [0.1, 0.2])] * 50, 3, 2, 2)  # one vector many times
    assert sortmeans.clusters(table(spark, [])).collect() == [] and sortmeans.clusters(table(spark, odd[:3])).collect() == []


def test_scans_stop_early_and_stay_exact():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-2000, 2000, (30, 16))
    x = centroids[rng.integers(0, 30, 5000)] + rng.integers(-60, 60, (5000, 16))
    before, _ = sortmeans.first_assignment(x, centroids)
    before = np.where(rng.random(5000) < 0.1, rng.integers(0, 30, 5000), before)
    moved = centroids + rng.integers(-30, 30, centroids.shape)
    counted = []
    cluster, distance = sortmeans.nearest(x, before, moved, *sortmeans.centroid_order(moved), counted)
    want = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert counted[0] < 0.25 * want.size


def test_first_centroids_of_many_rows_are_bounded(spark):
    df = spark.range(5000).selectExpr("id as vec_id", "array(cast(id as int), 1) as v")
    want = sorted(range(5000), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:40]
    assert sortmeans.first_centroids(df)[:, 0].tolist() == want


def test_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows(sortmeans.op13(spark, folder).toPandas()) == rows(connect(folder).execute(sortmeans.SQL).df())
