"""Operator 6, approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, normalised, rotated by one random orthogonal matrix and kept as its signs, packed into
64-bit words, with two correction scalars: its distance to the centre and the inner product of code and
vector.  A query's inner product with a vector is estimated by popcounts of the packed words against the bit
planes of the quantised query; an error bound gives a lower bound of the distance, and exactly the vectors
whose bound does not exceed the query's k-th exact distance so far are reranked on the original vectors.

All rows are indexed.  Queries meet them in blocks: a block of queries (at most ``QUERY_BLOCK``, so a proven
size) is broadcast and one pass over the index keeps k candidates per query and task.  Two exact bounds spare
most of the popcounts where vectors lie in groups: a query starts with its k-th distance to a bounded sample of
the candidates, and rows are sorted within their partition by the nearest of a few coarse centres, so a run of
rows whose distances to their centre put all of them beyond the query's limit (triangle inequality) is left out
at once.  Neither bound can lose a neighbour.  Nothing is collected but query blocks and the sample, and no
vector is shuffled.

Defined cases: vectors that are null, zero, of another dimension than the most common one (ties: the smaller),
or hold null or non-finite components take no part, nor do rows without vec_id; of rows that repeat a vec_id the
query is the smallest vector (by its first differing component) and a candidate counts once with its smallest distance; ties go to the smaller vec_id; with fewer
candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import staged

K, SEED = 10, 20
#: Queries that are broadcast at once (a few dozen MB at common dimensions).
QUERY_BLOCK = 16_384
#: Bits of the quantised query, and the error bound in standard deviations.
QUERY_BITS, SIGMAS = 4, 2.5
#: Vectors, and queries, compared in one step.
ROWS, QUERIES = 4096, 512
#: Vectors of the sample that gives first limits and coarse centres; centres: one for so many rows, at most so many.
SAMPLE, ROWS_A_CENTRE, CENTRES = 4096, 4096, 256
#: Room for rounding in comparisons of distances.
SLACK = 1 + 1e-6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(ids: pa.Array, vectors: pa.Array, dim: int | None = None):
    """Ids and the matrix of vectors that take part (one matrix per dimension if none is given)."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
    out = []
    for d in [dim] if dim else sorted({int(x) for x in lengths if x > 0}):
        rows = np.flatnonzero((lengths == d) & known)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), d)  # null components become NaN
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        out.append((ids.take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(x[good])))
    return out


def centre(vectors: DataFrame) -> tuple[np.ndarray | None, int]:
    """The mean of the vectors of the most common dimension, and their number; None if no vector takes part.

    Sums per task and dimension are reduced by Spark; what reaches the driver is one vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in usable(batch.column(0), batch.column(1)):
                if len(x):
                    s = sums.setdefault(x.shape[1], [0, np.zeros(x.shape[1])])
                    s[0] += len(x)
                    s[1] += x.sum(0)
        for d, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total)], names=["dim", "pos", "n", "s"])

    sums = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "dim int, pos int, n long, s double")
    rows = sums.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = rows.filter("pos = 0").orderBy(F.desc("n"), "dim").limit(1).select("dim", "n").collect()
    if not best:
        return None, 0
    mean = rows.filter(F.col("dim") == best[0]["dim"]).select("pos", "s").collect()  # `dim` rows
    return np.array([r["s"] for r in sorted(mean, key=lambda r: r["pos"])]) / best[0]["n"], best[0]["n"]


def sampled(vectors: DataFrame, dim: int, n_rows: int, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a sample of candidates: those with the smallest hashes of their ids, each id once.

    A bound on the hash, from the number of rows, leaves about four times as many ids before any is sorted, and a
    vector moves only once its id is chosen, one of each id and task."""
    slim = vectors.filter(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    h, ids = F.xxhash64("vec_id"), slim.select("vec_id").filter("vec_id is not null")
    if n_rows > 16 * size:
        ids = ids.filter(h < int((4 * size / n_rows - 0.5) * 2.0**64))
    chosen = ids.distinct().orderBy(h, "vec_id").limit(size).withColumnRenamed("vec_id", "_id")
    rows = slim.join(F.broadcast(chosen), F.col("vec_id") == F.col("_id")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow()  # `size` ids
    if not rows.num_rows:
        return np.empty(0, np.int64), np.empty((0, dim))
    ((ids_, x),) = usable(rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), dim)
    order = np.argsort(ids_)
    return ids_[order], x[order]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def coarse_centres(x: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n centres of a sample by a few rounds of nearest-mean; empty ones stay where they were."""
    n = max(1, min(n, len(x)))
    centres = x[:n].copy()
    for _ in range(rounds if n > 1 else 0):
        nearest_ = squared(x, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest_, minlength=n)
        np.add.at(sums, nearest_, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def first_limits(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Per query its k-th smallest distance to the sample's other ids, with room for rounding; infinite without k of them."""
    out = np.full(len(ids), np.inf)
    for at in range(0, len(ids) if len(sample_ids) > k else 0, QUERIES):
        part = slice(at, at + QUERIES)
        d = squared(x[part], sample)
        d[ids[part, None] == sample_ids[None]] = np.inf
        out[part] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) * SLACK
    # Rounding of far-off vectors' squares.
    return out + 1e-6 * np.sqrt((x * x).sum(1))


def encode(x: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows x words), distance to the centre, and inner product of code and unit vector."""
    rest = (x - c) @ p
    norm = np.sqrt((rest**2).sum(1))
    bits = rest > 0
    d = x.shape[1]
    padded = np.zeros((len(x), -(-d // 64) * 64), bool)
    padded[:, :d] = bits
    codes = np.packbits(padded, axis=1).view(np.uint64)
    inner = np.abs(rest).sum(1) / (np.sqrt(d) * np.maximum(norm, 1e-300))
    return codes, norm, np.maximum(inner, 1e-9)


class Queries:
    """A block of queries, rotated, quantised to bit planes and packed like the codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, c: np.ndarray, p: np.ndarray, bits: int = QUERY_BITS):
        self.ids, self.x, self.d = ids, x, x.shape[1]
        turned = (x - c) @ p
        self.norm = np.sqrt((turned**2).sum(1))
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << bits) - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        padded = np.zeros((len(x), -(-self.d // 64) * 64), np.uint8)
        padded[:, : self.d] = levels
        self.planes = np.stack([np.packbits((padded >> b) & 1, axis=1).view(np.uint64) for b in range(bits)], 1)
        self.total = turned.sum(1)

    def bounds(self, codes, norm, inner, part: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate and lower bound of the squared distances, queries of the part x rows."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        hits = np.zeros((len(self.norm[part]), len(codes)))
        for b in range(self.planes.shape[1]):
            plane = self.planes[part, b]
            hits += float(1 << b) * np.bitwise_count(plane[:, None, :] & codes[None]).sum(2, dtype=np.int64)
        root = np.sqrt(self.d)
        product = (2 * (self.low[part, None] * ones[None] + self.step[part, None] * hits) - self.total[part, None]) / root
        estimate = self.norm[part, None] ** 2 + norm[None] ** 2 - 2 * norm[None] * product / inner[None]
        # Deviation of the code's direction, and of rounding the query to its levels.
        spread = self.norm[part, None] * np.sqrt(np.maximum(1 - inner**2, 0) / max(self.d - 1, 1))[None] + 0.41 * self.step[part, None]
        return estimate, estimate - 2 * norm[None] * SIGMAS * spread / inner[None]


def runs(cluster: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of equal values in a row."""
    cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(cluster) else []


def search_block(queries: Queries, parts: Iterator, k: int = K, limits: np.ndarray | None = None, centres: np.ndarray | None = None):
    """Per query the k nearest of all parts (ids, vectors, codes, norm, inner, and with centres each row's centre and
    its distance to it), ties to the smaller id."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(queries.ids)
    worst = np.full(len(queries.ids), np.inf) if limits is None else limits.copy()
    away = np.sqrt(squared(queries.x, centres)) if centres is not None else None
    for ids, x, codes, norm, inner, *coarse in parts:
        for low, high in runs(coarse[0]) if coarse else [(0, len(ids))]:
            asked = np.arange(len(queries.ids))
            if coarse:
                d, reach = away[:, coarse[0][low]], coarse[1][low:high]
                room = 1e-6 * (d + reach.max())
                asked = np.flatnonzero(np.maximum(d - reach.max(), reach.min() - d) - room <= worst * SLACK)
            some = slice(low, high)
            for at in range(0, len(asked), QUERIES):
                part = asked[at : at + QUERIES]
                estimate, lower = queries.bounds(codes[some], norm[some], inner[some], part)
                for row, q in enumerate(part):
                    _meet(queries, int(q), ids[some], x[some], estimate[row], lower[row], best, worst, k)
    return best


def _meet(queries: Queries, q: int, ids, x, estimate, lower, best: list, worst: np.ndarray, k: int) -> None:
    """Reranks the rows whose lower bound is within the query's limit, and keeps its k best."""
    limit = worst[q]
    if limit == np.inf and len(ids) > 4 * k:  # a first distance to beat, from the best estimates
        first = np.argpartition(estimate, 4 * k)[: 4 * k]
        first = first[ids[first] != queries.ids[q]]
        exact = np.concatenate([best[q][0], np.sqrt(((x[first] - queries.x[q]) ** 2).sum(1))])
        order = np.argsort(exact)
        place = np.sort(np.unique(np.concatenate([best[q][1], ids[first]])[order], return_index=True)[1])
        limit = exact[order[place[k - 1]]] if len(place) >= k else np.inf  # an id counts once
    near = np.flatnonzero(lower <= limit**2 * SLACK)
    near = near[ids[near] != queries.ids[q]]
    if len(near):
        exact = np.sqrt(((x[near] - queries.x[q]) ** 2).sum(1))
        d, i = np.concatenate([best[q][0], exact]), np.concatenate([best[q][1], ids[near]])
        order = np.lexsort((i, d))
        keep = order[np.sort(np.unique(i[order], return_index=True)[1])[:k]]  # an id counts once
        best[q] = d[keep], i[keep]
        if len(keep) == k:
            worst[q] = min(worst[q], d[keep[-1]])


def build_index(vectors: DataFrame, c: np.ndarray, centres: np.ndarray, seed: int = SEED) -> DataFrame:
    """vec_id, embedding, code, norm and inner of every vector that takes part, its coarse centre and distance to it,
    sorted by centre within each partition."""
    dim = len(c)
    kind = vectors.schema["embedding"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, centres = rotation(dim, seed), shared.value
        for batch in batches:
            ((ids, x),) = usable(batch.column(0), batch.column(1), dim)
            if len(ids):
                codes, norm, inner = encode(x, c, p)
                nearest_ = squared(x, centres).argmin(1)
                reach = np.sqrt(((x - centres[nearest_]) ** 2).sum(1))
                offsets = pa.array(np.arange(0, dim * len(ids) + 1, dim, dtype=np.int32))
                value = batch.schema.field(1).type.value_type
                vector = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()).cast(value, safe=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), vector, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norm), pa.array(inner), pa.array(nearest_.astype(np.int32)), pa.array(reach)],
                    names=["vec_id", "embedding", "code", "norm", "inner", "cluster", "reach"],
                )

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, code binary, norm double, inner double, cluster int, reach double")
    return rows.sortWithinPartitions("cluster")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, seed: int = SEED, block: int = QUERY_BLOCK, rows_a_centre: int = ROWS_A_CENTRE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by Euclidean distance, in double precision."""
    spark = vectors.sparkSession
    c, n_rows = centre(vectors)
    if c is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample_ids, sample = sampled(vectors, len(c), n_rows)
    centres = coarse_centres(sample, min(CENTRES, n_rows // rows_a_centre)) if len(sample) else c[None]
    index = staged(build_index(vectors, c, centres, seed), "codes")
    asked = staged(index.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // (block * 3 // 4)))
    found = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # a block of bounded size
        ((ids, x),) = usable(mine.column("vec_id").combine_chunks(), mine.column("embedding").combine_chunks(), len(c)) if mine.num_rows else ((np.empty(0, np.int64), np.empty((0, len(c)))),)
        if not len(ids):
            continue
        shared = spark.sparkContext.broadcast((ids, x, c, first_limits(ids, x, sample_ids, sample, k), centres))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, c, limits, centres = shared.value
            queries = Queries(ids, x, c, rotation(len(c), seed))

            def parts():
                for whole in batches:
                    for at in range(0, whole.num_rows, ROWS):
                        batch = whole.slice(at, ROWS)
                        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                        vectors_ = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                        yield batch.column(0).to_numpy(), vectors_, codes, *(batch.column(n).to_numpy() for n in (3, 4, 5, 6))

            best = search_block(queries, parts(), k, limits, centres)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(i) for _, i in best])), pa.array(np.concatenate([i for _, i in best]).astype(np.int64)), pa.array(np.concatenate([d for d, _ in best]))],
                names=["query_id", "vec_id", "score"],
            )

        found.append(staged(index.mapInArrow(run, "query_id long, vec_id long, score double"), "found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    once = every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir):
    from .runtime import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
