"""Operator 13, centroid clustering by sort-means: exact integer k-means that leaves out centroids by their order.

Each component x of a vector becomes the integer ``floor(256 * x)``.  Centroids start as the vectors with the smallest
hashes of their ids; a round assigns every vector to its nearest centroid and replaces every centroid by the
componentwise ``floor(sum / count)`` of its vectors.

Sort-means: before a round, the other centroids are ordered by distance from each centroid.  A vector's scan starts
at its previous assignment, goes on in that centroid's order and stops at the first centroid strictly beyond twice the
vector's distance to the previous assignment: by the triangle inequality that one and all later ones are farther away
than the assignment.  Equal bounds are scanned, as a tie goes to the smaller number.  All distances are squared
integers, so neither the bound nor the result is rounded.

Spark's part: the vectors are staged once as integers; each round is one ``mapInArrow`` pass over the last round's
table that writes vectors and assignments (an executor that is lost costs its running tasks), and one aggregation with
map-side partial sums whose result has a row per centroid.  Only centroids, at most ``k``, and their tables of order
go to the driver and to the tasks.  The last round's table is deleted once the next one is whole.

Defined cases: rows without vec_id, and vectors that are null, of another length, hold null or non-finite components,
or a component of magnitude ``LIMIT`` or more (its squared distances would leave 64 bits) take no part; rows that repeat
are vectors of their own; of equal hashes (repeated vec_id) the lexicographically smaller integer vector is the earlier
centroid; with fewer vectors than k all of them are centroids; centroids that no vector is nearest to stay where they
are; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import staged, unstage

#: Centroids, rounds, components of a vector, factor of its integers, seed of the first centroids.
K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Magnitude from which a component is too large for exact 64-bit squares.
LIMIT = float(1 << 19)
#: Vectors that are compared in one step.
ROWS = 8192


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and the integers of every vector that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dim)).filter(F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes, in that order, as a matrix.

    A bound on the hash, from the number of rows, leaves about 4k of them before anything is sorted, so a task sends
    few vectors however many it holds; the bound is raised until k are found."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    total = rows.count()
    share = 1.0 if total <= 16 * k else 4 * k / total
    while True:
        near = rows.withColumn("h", h)
        if share < 1:
            near = near.filter(F.col("h") < format(int(share * (1 << 52)), "013x"))
        found = near.orderBy("h", "v").limit(k).select("v").collect()  # k rows
        if len(found) >= min(k, total):
            return np.array([r["v"] for r in found], np.int64).reshape(len(found), len(found[0]["v"]) if found else 0)
        share *= 4


def centroid_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid the others by distance (ties: smaller number), and these squared distances."""
    d = ((centroids[:, None, :] - centroids[None]) ** 2).sum(2)
    np.fill_diagonal(d, -1)  # itself comes first and is left out
    order = np.argsort(d, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(d, order, 1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(assignment, squared distance) of the rows of x, from their previous assignments; ``counted`` gets the number of
    distances that were computed."""
    cluster, distance = before.astype(np.int64).copy(), np.empty(len(x), np.int64)
    done = 0
    for c in np.unique(before):
        mine = np.flatnonzero(before == c)
        start = ((x[mine] - centroids[c]) ** 2).sum(1)
        best, number = start.copy(), np.full(len(mine), c, np.int64)
        # Rows by descending reach: those that go on are the first ones.
        by = np.argsort(-start, kind="stable")
        reach = 4 * start[by]
        done += len(mine)
        for other, gap in zip(order[c], apart[c], strict=True):
            active = by[: np.searchsorted(-reach, -gap, "right")]  # all with gap <= reach
            if not len(active):
                break
            d = ((x[mine[active]] - centroids[other]) ** 2).sum(1)
            done += len(active)
            better = (d < best[active]) | ((d == best[active]) & (other < number[active]))
            best[active[better]], number[active[better]] = d[better], other
        cluster[mine], distance[mine] = number, best
    if counted is not None:
        counted.append(done)
    return cluster, distance


def first_assignment(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(assignment, squared distance) without a previous one: all centroids are scanned, in their order."""
    best = ((x - centroids[0]) ** 2).sum(1)
    number = np.zeros(len(x), np.int64)
    for c in range(1, len(centroids)):
        d = ((x - centroids[c]) ** 2).sum(1)
        better = d < best
        best[better], number[better] = d[better], c
    return number, best


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, v, cluster, distance, a row per vector; without a column cluster this is the first assignment."""
    again = "cluster" in rows.columns
    shared = rows.sparkSession.sparkContext.broadcast((centroids, *centroid_order(centroids)))  # k centroids, k * k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order, apart = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                if again:
                    cluster, distance = nearest(x, batch.column("cluster").to_numpy(), centroids, order, apart)
                else:
                    cluster, distance = first_assignment(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", *(["cluster"] if again else [])).mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, in exact integers; empty ones stay."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])))
    out = centroids.copy()
    for r in sums.collect():  # a row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance: the final assignment, staged; the final centroids)."""
    rows = staged(integer_vectors(vectors, dim, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "v", "cast(0 as int) as cluster", "0L as distance"), centroids
    for step in range(rounds + 1):
        last, rows = rows, staged(assigned(rows, centroids), "assigned")
        unstage(last)
        if step < rounds:
            centroids = moved(rows, centroids)
    return rows, centroids


def clusters(vectors: DataFrame, **rule) -> DataFrame:
    """Per vector: vec_id, cluster, distance, its cluster's and the whole inertia, and the digest of its final centroid."""
    rows, centroids = sort_means(vectors, **rule)
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    digests = rows.sparkSession.createDataFrame(names, "_c int, centroid_sha256 string")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    # A row per centroid, at most k.
    known = inertia.join(F.broadcast(digests), F.col("cluster") == F.col("_c")).join(F.broadcast(every)).drop("_c")
    return rows.drop("v").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark, sf_dir):
    from .runtime import table

    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by plain Lloyd rounds: every vector meets every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {int(LIMIT)})) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    for step in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{step} AS MATERIALIZED (SELECT vec_id, r, min({{'d': {square}, 'c': c.c}}) AS a FROM v, c{step} c GROUP BY vec_id, r)")
        if step < rounds:
            steps.append(
                f"m{step} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS v FROM (SELECT a.a.c AS c, i, (sum(v.v[i]) // count(*) - CASE WHEN sum(v.v[i]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS x "
                f"FROM a{step} a JOIN v USING (r), range(1, {dim + 1}) t(i) GROUP BY ALL) GROUP BY c)"
            )
            steps.append(f"c{step + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{step} c LEFT JOIN m{step} m USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
