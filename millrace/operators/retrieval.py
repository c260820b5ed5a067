"""Retrieval: BM25 with block bounds, exact dense top-k with norm bounds, pooling, encoder prefixes, results as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import l2_normalize
from ..functions.text import passages_text

#: Pairs of query and term, and queries of the dense search, that meet the corpus in one pass.
PAIRS, QUERIES = 1 << 20, 4096
#: Documents of a block of postings, and vectors of a block of the dense search.
DOCUMENTS, VECTORS = 128, 512
#: Room for rounding when a bound is compared with a score; scores that differ by less are told apart by their ids.
SLACK = 2e-9


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-cased runs of letters and digits."""
    return df.select(key, F.explode(_words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


class _Best:
    """The k best (score, name) of every query, ties to the smaller name, each name once."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [(np.empty(0), np.empty(0, np.int64))] * n
        #: The score that a new one must reach: that of the k-th, less the room for rounding.
        self.least = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, name: np.ndarray) -> None:
        score, name = np.concatenate([self.kept[q][0], score]), np.concatenate([self.kept[q][1], name])
        order = np.lexsort((name, -np.round(score, 9)))
        order = order[np.sort(np.unique(name[order], return_index=True)[1])[: self.k]]
        self.kept[q] = score[order], name[order]
        if len(order) == self.k:
            self.least[q] = score[order[-1]] - SLACK

    def batch(self, ids, query: str, key: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s, _ in self.kept])), pa.array(np.concatenate([n for _, n in self.kept] or [np.empty(0, np.int64)])), pa.array(np.concatenate([s for s, _ in self.kept] or [np.empty(0)]))], names=[query, key, "score"])


def _ranked(found: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """k rows of each query and task meet; Spark cuts them to k a task once more before they do."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)))
    return ranked.filter(F.col("rank") <= k)


def block_postings(term: np.ndarray, doc: np.ndarray, length: np.ndarray, mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, impact) of a block from the occurrences of terms in its documents: terms in order, within a
    term the largest impact first.  An impact is the part of a score that does not depend on the query."""
    pairs, tf = np.unique(term * len(length) + doc, return_counts=True)
    term, doc = np.divmod(pairs, max(len(length), 1))
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
    order = np.lexsort((-impact, term))
    return term[order], doc[order], impact[order]


def scored_block(asked: tuple, postings: tuple, names: np.ndarray, best: _Best, counted: list[int] | None = None) -> None:
    """Scores a block's documents for the queries that it can matter to.

    The first impact of a term is its largest in the block, so the weighted sum of a query's is a bound for every
    document in it; a query whose k-th score the bound does not reach leaves the block out."""
    starts, terms_, idf = asked
    term, doc, impact = postings
    first = np.searchsorted(term, terms_)
    there = first < len(term)
    there[there] = term[first[there]] == terms_[there]
    bound = np.zeros(len(terms_))
    bound[there] = idf[there] * impact[first[there]]
    total = np.add.reduceat(np.append(bound, 0.0), starts[:-1]) if len(starts) > 1 else np.empty(0)
    possible = np.flatnonzero((total > 0) & (total >= best.least))
    ends = np.searchsorted(term, terms_, "right")
    for q in possible.tolist():
        scores = np.zeros(len(names))
        for t in range(starts[q], starts[q + 1]):
            if there[t]:
                mine = slice(first[t], ends[t])
                scores[doc[mine]] += idf[t] * impact[mine]
        hit = np.flatnonzero((scores > 0) & (scores >= best.least[q]))
        if len(hit):
            best.add(q, scores[hit], names[hit])
    if counted is not None:
        counted[0] += int((total > 0).sum())
        counted[1] += len(possible)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", query: str = "item_id", text: str = "text", k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query, doc, score, rank: the k best documents of each query (ties to the smaller document).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  Two passes over the corpus, in both of which documents stay where they
    are: one counts documents and lengths and, per task, the documents of each asked term; the other makes postings of
    the asked terms in blocks of documents, in order of their impact, and scores the blocks whose bound reaches a query's
    k-th score.  Only k rows of a query and task are exchanged.  Queries come in blocks of a bounded number of pairs.

    Ids are long.  Null texts have no words; queries without a known word have no rows; documents that share an id are
    documents of their own, of which the best one counts; a document without id takes no part."""
    spark, words = corpus.sparkSession, corpus.select(F.col(doc).cast("long").alias("_id"), _words(text).alias("_w")).filter("_id is not null")
    asked = queries.select(F.col(query).alias("_q"), F.explode(F.array_distinct(_words(text))).alias("term")).filter("_q is not null").distinct()
    kind = dict(queries.dtypes)[query]
    blocks = max(1, -(-asked.count() // (PAIRS * 3 // 4)))
    out = None
    for at in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == at).orderBy("_q").toArrow()  # about PAIRS rows
        if mine.num_rows:
            part = _bm25_block(spark, words, mine, k, k1, b, f"`{query}` {kind}, `{doc}` long, score double", query, doc)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"`{query}` {kind}, `{doc}` long, score double, rank int")
    return _ranked(out, query, doc, k)


def _positions(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the known word, list) of every occurrence, and the lengths of the lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return number[number >= 0], owner[number >= 0], lengths


def _bm25_block(spark: SparkSession, words: DataFrame, asked: pa.Table, k: int, k1: float, b: float, schema: str, query: str, doc: str) -> DataFrame:
    known = pc.unique(asked.column("term").combine_chunks())
    shared = spark.sparkContext.broadcast(known)  # at most PAIRS terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, length = shared.value, 0, 0
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            number, owner, lengths = _positions(batch.column(1), known)
            docs, length = docs + int((lengths > 0).sum()), length + int(lengths.sum())
            pairs = np.unique(number * max(len(lengths), 1) + owner) // max(len(lengths), 1)
            df += np.bincount(pairs, minlength=len(known))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *there]), pa.array([docs, length, *df[there]])], names=["what", "n"])

    counts = {r["what"]: r["n"] for r in words.mapInArrow(count, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}  # a row an asked term
    n, mean = counts.get(-1, 0), counts.get(-2, 0) / max(counts.get(-1, 0), 1)
    ids = asked.column("_q").combine_chunks().dictionary_encode()
    starts = np.searchsorted(ids.indices.to_numpy(), np.arange(len(ids.dictionary) + 1))
    number = pc.index_in(asked.column("term").combine_chunks(), value_set=known).to_numpy().astype(np.int64)
    df = np.array([counts.get(t, 0) for t in range(len(known))])[number]
    plan = spark.sparkContext.broadcast((known, ids.dictionary, (starts, number, np.log(1 + (n - df + 0.5) / (df + 0.5))), mean))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, asked, mean = plan.value
        best = _Best(len(ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                term, owner, lengths = _positions(batch.column(1), known)
                scored_block(asked, block_postings(term, owner, lengths, mean, k1, b), batch.column(0).to_numpy(), best)
        names = pa.array(np.repeat(np.arange(len(ids)), [len(s) for s, _ in best.kept]), pa.int64())
        found = best.batch(np.arange(len(ids)), query, doc)
        yield pa.RecordBatch.from_arrays([ids.take(names), found.column(1), found.column(2)], names=[query, doc, "score"])

    return words.mapInArrow(search, schema)


def _matrix(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that have the dimension and only finite components."""
    rows = np.flatnonzero(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
    x = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    good = np.isfinite(x).all(1)
    return rows[good], np.ascontiguousarray(x[good])


def nearest_products(ids: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, best: _Best, counted: list[int] | None = None) -> None:
    """Adds the products of the queries with some vectors to their best, in blocks of falling norm.

    No product exceeds the product of both norms (Cauchy-Schwarz), so a block whose largest norm does not bring a query
    to its k-th product is left out for it, and so are all later ones."""
    norms, size = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    order = np.argsort(-norms, kind="stable")
    for at in range(0, len(order), VECTORS):
        some = order[at : at + VECTORS]
        asked = np.flatnonzero(size * norms[some[0]] * (1 + 1e-12) >= best.least)
        if counted is not None:
            counted[0] += len(ids)
            counted[1] += len(asked)
        if not len(asked):
            if counted is not None:
                counted[0] += len(ids) * ((len(order) - at - 1) // VECTORS)
            return
        products = q[asked] @ x[some].T
        for row, i in enumerate(asked.tolist()):
            hit = np.flatnonzero((products[row] >= best.least[i]) & (names[some] != ids[i]))
            if len(hit):
                best.add(i, products[row, hit], names[some[hit]])


def dense(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERIES, rows_a_step: int = 16_384) -> DataFrame:
    """query_id, key, score, rank: the k largest inner products in double precision, a query's own id left out.

    Queries are broadcast in blocks of bounded size; one pass over the corpus a block multiplies blocks of vectors in
    order of their norm, as far as the norms can still bring a query to its k-th product, and keeps the k best of each
    query and task.  So no pair and no vector of the corpus is shuffled.

    Queries of several dimensions meet the vectors of their own; vectors that are null or hold null or non-finite
    components take no part, nor do rows without id; an id that repeats counts once, with its largest product, and asks
    once, with its smallest vector."""
    spark = corpus.sparkSession
    sound = F.forall(F.col("_v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("_v")).where("query_id is not null and size(_v) > 0").where(sound)
    slim = slim.groupBy("query_id").agg(F.min("_v").alias("_v"))
    out = None
    sizes = slim.groupBy(F.size("_v").alias("dim")).count().orderBy("dim").collect()  # a row a dimension
    for dim, n in ((r["dim"], r["count"]) for r in sizes):
        blocks = max(1, -(-n // block))
        for at in range(blocks):
            mine = slim.where((F.size("_v") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)).toArrow()  # about `block` rows
            if not mine.num_rows:
                continue
            shared = spark.sparkContext.broadcast((mine.column(0).to_numpy(), mine.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim)))

            def search(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                best, names, xs, held = _Best(len(ids), k), [], [], 0
                for batch in batches:
                    rows, x = _matrix(batch.column(1), dim)
                    names.append(batch.column(0).to_numpy()[rows])
                    xs.append(x)
                    held += len(rows)
                    if held >= rows_a_step:
                        nearest_products(ids, q, np.concatenate(names), np.concatenate(xs), best)
                        names, xs, held = [], [], 0
                if held:
                    nearest_products(ids, q, np.concatenate(names), np.concatenate(xs), best)
                yield best.batch(ids, "query_id", key)

            rows = corpus.select(F.col(key).cast("long"), vector).filter(F.col(key).isNotNull())
            part = rows.mapInArrow(search, f"query_id long, `{key}` long, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id long, `{key}` long, score double, rank int")
    return _ranked(out, "query_id", key, k)


def pooled(hidden: Column | str, mask: Column | str | None = None, method: str = "mean", normalise: bool = True) -> Column:
    """One vector from a text's token vectors (array of arrays): the mean of the masked-in ones, or the first one (cls).

    Sums run along the arrays of one row, so nothing is exploded or shuffled.  Without a mask all tokens count; a mask
    that is shorter leaves the other tokens out, and one without ones gives null, like a row without tokens; null
    components count as 0; tokens whose vectors are null, or of another length than the first one, are left out of a mean."""
    h = F.col(hidden) if isinstance(hidden, str) else hidden
    first = F.get(h, F.lit(0))
    if method == "cls":
        v = F.transform(first, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    elif method == "mean":
        m = F.transform(h, lambda _: F.lit(1)) if mask is None else F.col(mask) if isinstance(mask, str) else mask
        keep = F.filter(F.arrays_zip(h.alias("h"), m.cast("array<int>").alias("m")), lambda t: (t["m"] != 0) & (F.size(t["h"]) == F.size(first)))
        zero = F.transform(first, lambda _: F.lit(0.0))
        total = F.aggregate(keep, zero, lambda a, t: F.zip_with(a, t["h"], lambda x, y: x + F.coalesce(y.cast("double"), F.lit(0.0))))
        v = F.when(F.size(keep) > 0, F.transform(total, lambda x: x / F.size(keep)))
    else:
        raise ValueError(f"unknown pooling {method!r}")
    return l2_normalize(v) if normalise else v


def title_and_text(contents: Column | str) -> Column:
    """struct<title, text, contents> of a document: its first line without quotes around it, and the other lines."""
    c = F.col(contents) if isinstance(contents, str) else contents
    title = F.regexp_replace(F.substring_index(c, "\n", 1), '^"+|"+$', "")
    rest = F.when(F.contains(c, F.lit("\n")), F.substr(c, F.instr(c, "\n") + 1)).otherwise("")
    return F.struct(title.alias("title"), rest.alias("text"), c.alias("contents"))


# What encoders of a family expect before their texts.
_PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}


def encoder_input(text: Column | str, model: str, is_query: bool = True) -> Column:
    """The text as an encoder of the model's family expects it; other models take it as it is."""
    t = F.col(text) if isinstance(text, str) else text
    for family, (query, passage) in _PREFIXES.items():
        if family in model.lower():
            t = F.concat(F.lit(query if is_query else passage), t)
    return t


def search_results(df: DataFrame, batch: str, results: str = "results", error: str = "error", order: str = "k") -> DataFrame:
    """Per batch of queries (columns results: array of documents or null, error): query_count, status (api_error,
    unknown_api_state, no_results or success), total_results, and result_text, a JSON object with the joined passages."""
    one = passages_text(results)
    per = df.groupBy(batch).agg(
        F.count("*").alias("query_count"), F.min(error).alias("_error"), F.count_if(F.col(results).isNotNull()).alias("_answered"), F.sum(F.when(F.size(results) > 0, F.size(results)).otherwise(0)).alias("total_results"),
        F.array_sort(F.collect_list(F.when(F.size(results) > 0, F.struct(F.col(order).alias("o"), one.alias("t"))))).alias("_texts"),
    )
    status = F.when(F.col("_error").isNotNull(), "api_error").when(F.col("_answered") == 0, "unknown_api_state").when(F.col("total_results") == 0, "no_results").otherwise("success")
    # Fixed texts.
    text = F.when(status == "api_error", F.concat(F.lit("Search error: "), "_error")).when(status == "unknown_api_state", F.lit("Unknown API state (no response and no error message).")).when(status == "no_results", F.lit("No search results found."))
    joined = F.array_join(F.transform("_texts", lambda x: x["t"]), "\n---\n")
    return per.select(batch, "query_count", status.alias("status"), F.when(status == "success", F.col("total_results")).otherwise(0).alias("total_results"), F.to_json(F.struct(F.coalesce(text, joined).alias("result"))).alias("result_text"))


def with_documents(hits: DataFrame, corpus: DataFrame, query: str, doc: str = "doc_id") -> DataFrame:
    """Per query an array of struct<rank, document, score>, in order of rank."""
    rows = hits.join(corpus, doc).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("document"), "score"))).alias("results"))
    return rows
