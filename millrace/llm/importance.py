"""Operator 12, target-distribution importance resampling with a distinct-feature dictionary.

Features are runs of 1 to 3 consecutive words.  Their strings are counted globally, each distinct string is hashed once,
its count is added to its bucket, and the buckets' gains are joined back to the documents' feature counts:

1.  *Pages.*  A page is a bounded run of documents within one block of a file.  Its words are numbered, its n-grams
    counted as numbers, and only its distinct n-grams become strings: per part of the dictionary one sorted, compressed
    list with their counts, in which a run of three words is written as its third word below its first two.
2.  *Dictionary.*  A part gathers its lists from all pages (a string costs a page once, however often it occurs),
    adds up equal strings, takes the CRC of each distinct one once (that of three words goes on from that of the first
    two), and returns the counts of its buckets and, for each page, the buckets of the page's strings in their order.  Strings are dealt to parts by their first two words, and
    where two words go on in many ways also by the third, so no part gathers the continuations of a frequent pair; a
    pair that is frequent in some pages only may meet in two parts, which then add to the same bucket.
3.  *Gains.*  One number per bucket, from the counts of both tables.
4.  *Join.*  Each page meets its buckets again by the page's name, so gains reach the page's distinct n-grams, and from
    there the documents, as sums over their feature counts.

A page's name is the place of its block in the input, so both passes cut the same pages; a digest of the texts proves
it, and a table that is not read straight from files is staged first.  The draw is Gumbel top-k: the k-th score is
found by histogram passes, and only the drawn rows are sorted.

Defined cases: null and empty texts have no features and weight 0; texts of any length are whole (a very long one is a
page of its own); rows without doc_id have a weight but no score and are not drawn; rows that repeat are documents of
their own, and where equal rows meet the limit as many are drawn as it leaves room for; an empty table gives no rows;
an empty benchmark has no counts; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import with_positions
from ..operators.selection import at_or_above, kth_largest
from .runtime import fresh, release_memory, small_batches, staged
from .textkit import splitmix, split_words

#: Buckets, words of the longest feature, fewest words of a document that may be drawn, percent drawn, seed of the draw.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of a page's texts, and of the strings that a part of the dictionary holds at once (about).
PAGE_BYTES, PART_BYTES = 8 << 20, 40 << 20
#: Rows that are Python objects at once.
ROWS = 256
#: Bytes of distinct strings for each byte of text, at most about.
STRINGS_A_BYTE = 4
#: Continuations of a pair of words in a page from which they are dealt by the third word too.
HOT = 128

#: A-Z become a-z; all that is no ASCII letter, digit or part of a longer character separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CODEC, _SPACE = pa.Codec("zstd", 3), pa.scalar(" ", pa.large_string())


class Page:
    """The distinct n-grams of some texts: first the words in order, then pairs, then triples, each sorted by words."""

    def __init__(self, texts: list):
        numbers, words, ends = split_words([(t or "").encode("utf-8", "replace").translate(_FOLD) for t in texts])
        used = np.flatnonzero(np.bincount(numbers, minlength=len(words)))  # all but the empty piece at a text's end
        order = used[pc.sort_indices(words.take(pa.array(used))).to_numpy()]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.ends = words.take(pa.array(order)), ends
        code, n = rank[numbers], max(len(order), 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        two = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, pair = distinct(code[two] * n + code[two + 1], n * n)
        at = np.zeros(len(code) + 1, np.int64)
        at[two] = pair
        three = np.flatnonzero(owner[:-2] == owner[2:])
        triples, triple = distinct(at[three] * n + code[three + 2], max(len(pairs), 1) * n)
        self.first, self.second = np.divmod(pairs, n)
        self.stem, self.third = np.divmod(triples, n)
        self.sizes = (len(order), len(pairs), len(triples))
        #: Number of each occurrence's n-gram, and its text.
        base = np.cumsum([0, *self.sizes])
        self.grams = np.concatenate([code.astype(np.int32), (pair + base[1]).astype(np.int32), (triple + base[2]).astype(np.int32)])
        owner = owner.astype(np.int32)
        self.texts = np.concatenate([owner, owner[two], owner[three]])

    def counts(self) -> np.ndarray:
        return np.bincount(self.grams, minlength=sum(self.sizes))

    def pairs(self, which: np.ndarray) -> pa.Array:
        """Pairs of words as strings."""
        return pc.binary_join_element_wise(self.words.take(pa.array(self.first[which])), self.words.take(pa.array(self.second[which])), _SPACE)

    def cuts(self, n_parts: int) -> Cuts:
        """What each part of the dictionary gets."""
        h, part = splitmix(_crcs(_texts(self.words)).astype(np.uint64)), lambda x: ((x >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
        with np.errstate(over="ignore"):
            pair = splitmix(h[self.first] * np.uint64(3) + splitmix(h[self.second]))
            own = part(pair)
            third = own[self.stem]
            hot = np.flatnonzero((np.bincount(self.stem, minlength=len(pair)) > HOT)[self.stem])
            third[hot] = part(splitmix(pair[self.stem[hot]] + h[self.third[hot]]))
        # Pairs below which a part gets triples though they belong to another one come last in it.
        n, away = max(len(pair), 1), third != own[self.stem]
        foreign, below = np.unique(third[away] * n + self.stem[away], return_counts=True)
        stems, of = np.append(np.arange(len(pair)), foreign % n), np.append(own, foreign // n)
        below = np.append(np.bincount(self.stem[~away], minlength=len(pair)), below)
        single = part(splitmix(h))
        bounds = lambda parts: np.append(0, np.cumsum(np.bincount(parts, minlength=n_parts)))
        by = ordered(of, n_parts)
        return Cuts(ordered(single, n_parts), bounds(single), stems[by], by < len(pair), below[by], bounds(of), ordered(third * 2 + away, 2 * n_parts), bounds(third))


def distinct(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (from 0, below ``top``) in order, and each key's place among them."""
    bits = len(keys).bit_length()
    if top.bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    # A key and its place in one number sort faster than places by their keys.
    packed = np.sort((keys << bits) | np.arange(len(keys)))
    values = packed >> bits
    new = np.ones(len(keys), bool)
    new[1:] = values[1:] != values[:-1]
    place = np.empty(len(keys), np.int64)
    place[packed & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return values[new], place


def ordered(values: np.ndarray, top: int) -> np.ndarray:
    """Places by value, equal ones in order; few values are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if top <= 1 << 16 else values, kind="stable")


def _texts(strings: pa.Array) -> np.ndarray:
    return strings.cast(pa.large_binary()).to_numpy(zero_copy_only=False)


def _crcs(texts: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """CRC of each text, going on from a start."""
    return np.fromiter(map(zlib.crc32, texts) if starts is None else map(zlib.crc32, texts, starts.tolist()), np.uint32, len(texts))


class Cuts(NamedTuple):
    """Words, stems (pairs that are there for themselves or for the triples below them) and triples in order of their
    part, and where each part begins."""

    singles: np.ndarray
    single_at: np.ndarray
    stems: np.ndarray
    own: np.ndarray
    below: np.ndarray
    stem_at: np.ndarray
    triples: np.ndarray
    triple_at: np.ndarray

    def part(self, p: int) -> tuple[slice, slice, slice]:
        return tuple(slice(int(at[p]), int(at[p + 1])) for at in (self.single_at, self.stem_at, self.triple_at))


def _squeezed(raw: pa.Buffer) -> bytes:
    """Compressed bytes with their size before them."""
    return raw.size.to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _expanded(raw) -> pa.Buffer:
    raw = memoryview(raw)
    return _CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"))


def _joined(strings: pa.Array, by: str) -> pa.Buffer:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings), pa.scalar(by, pa.large_string()))[0].as_buffer()


def _unpacked(raw) -> pa.Array:
    """The strings of a list, which hold no line breaks."""
    whole = _expanded(raw)
    one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, whole.size], np.int64)), whole)
    return pc.split_pattern(one, "\n").flatten()


def _numbers(values: np.ndarray) -> bytes:
    return _squeezed(pa.py_buffer(np.ascontiguousarray(values)))


def _values(raw, kind) -> np.ndarray:
    return np.frombuffer(_expanded(raw), kind)


def _planes(buckets: np.ndarray) -> bytes:
    """16-bit numbers as all their low bytes, then all their high ones, which are few different ones and so get small."""
    return _squeezed(pa.py_buffer(np.ascontiguousarray(buckets.astype("<u2").view(np.uint8).reshape(-1, 2).T)))


def _from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(_values(raw, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _from_files(df: DataFrame) -> bool:
    """Whether a row's block of a file is known where it is read."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def _located(docs: DataFrame, id_: str) -> DataFrame:
    slim = docs.select(F.col(id_).cast("long").alias("id"), "text")
    if not _from_files(slim):
        slim = staged(slim, "pages")
    return slim.select(F.concat_ws(":", F.input_file_name(), F.expr("input_file_block_start()").cast("string")).alias("block"), "id", "text")


def _pages(batches: Iterator[pa.RecordBatch], page_bytes: int) -> Iterator[tuple[str, list, list]]:
    """(name, ids, texts) of the pages: rows of one block in their order, until they have the bytes of a page."""
    block, number, ids, texts, size = None, 0, [], [], 0
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for name, i, t in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "text")), strict=True):
            if texts and (name != block or size >= page_bytes):
                yield f"{block}:{number}:{_digest(ids, texts)}", ids, texts
                ids, texts, size, number = [], [], 0, number + 1
            if name != block:
                block, number = name, 0
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
    if texts:
        yield f"{block}:{number}:{_digest(ids, texts)}", ids, texts


def _digest(ids: list, texts: list) -> str:
    h = xxhash.xxh3_64()
    for i, t in zip(ids, texts, strict=True):
        h.update(f"{i}:{-1 if t is None else len(t)}:".encode())
        h.update((t or "").encode("utf-8", "replace"))
    return h.hexdigest()


def dictionary_lists(docs: DataFrame, n_parts: int, side: int, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """side, part, page, strings, numbers: the distinct n-grams of each page that belong to a part.

    The strings are words, then stems, then third words; the numbers are how many there are of each, the counts of
    the words, the counts of the stems (0 if the pair itself belongs to another part), how many third words follow below
    each stem, and the counts of those."""

    def cut(name: str, texts: list) -> pa.RecordBatch:
        page = Page(texts)
        counts, cuts = np.split(page.counts().astype(np.uint32), np.cumsum(page.sizes)[:2]), page.cuts(n_parts)
        singles, stems, thirds = page.words.take(pa.array(cuts.singles)), page.pairs(cuts.stems), page.words.take(pa.array(page.third[cuts.triples]))
        there, strings, numbers = [], [], []
        for p in range(n_parts):
            one, two, three = cuts.part(p)
            sizes = [x.stop - x.start for x in (one, two, three)]
            if any(sizes):
                there.append(p)
                strings.append(_squeezed(_joined(pa.concat_arrays([a.slice(x.start, n) for a, x, n in zip((singles, stems, thirds), (one, two, three), sizes, strict=True)]), "\n")))
                numbers.append(_numbers(np.concatenate([np.array(sizes), counts[0][cuts.singles[one]], np.where(cuts.own[two], counts[1][cuts.stems[two]], 0), cuts.below[two], counts[2][cuts.triples[three]]]).astype(np.uint32)))
        rows = [pa.array([side] * len(there), pa.int32()), pa.array(there, pa.int32()), pa.array([name] * len(there), pa.string()), pa.array(strings, pa.binary()), pa.array(numbers, pa.binary())]
        return pa.RecordBatch.from_arrays(rows, names=["side", "part", "page", "strings", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in _pages(batches, page_bytes):
            yield cut(name, texts)
            release_memory()

    return docs.mapInArrow(run, "side int, part int, page string, strings binary, numbers binary")


def hashed_lists(lists: list[tuple[pa.Array, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(counts, buckets) of each list's strings, in order: equal strings of all lists are one, and hashed once."""
    heads = [numbers[:3].astype(np.int64) for _, numbers in lists]
    cut = [np.cumsum([0, *h]) for h in heads]
    coded = []
    for kind in range(3):
        one = pa.concat_arrays([strings.slice(c[kind], c[kind + 1] - c[kind]) for (strings, _), c in zip(lists, cut, strict=True)]).dictionary_encode()
        coded.append((one.indices.to_numpy().astype(np.int64), one.dictionary))
    # Behind the sizes: counts of words, counts of stems, triples below each stem, counts of triples.
    parts = [np.split(numbers[3:], np.cumsum([h[0], h[1], h[1]])) for (_, numbers), h in zip(lists, heads, strict=True)]
    (single, words), (stem, pairs), (third, thirds) = coded
    n = max(len(thirds), 1)
    triples, triple = distinct(np.repeat(stem, np.concatenate([p[2] for p in parts])) * n + third, max(len(pairs), 1) * n)
    above, last = np.divmod(triples, n)
    crc = _crcs(_texts(pairs))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.int64, len(crc))
    known, hashes = _texts(thirds), np.empty(len(last), np.uint32)
    for at in range(0, len(last), 1 << 17):  # so many numbers are Python objects at once
        some = slice(at, at + (1 << 17))
        hashes[some] = _crcs(known[last[some]], spaced[above[some]])
    found = [(_crcs(_texts(words)) % BUCKETS)[single], (crc % BUCKETS)[stem], (hashes % BUCKETS)[triple]]
    ends = [np.cumsum([0, *(h[kind] for h in heads)]) for kind in range(3)]
    return [(np.concatenate([p[0], p[1], p[3]]), np.concatenate([found[kind][ends[kind][k] : ends[kind][k + 1]] for kind in range(3)]).astype(np.uint16)) for k, p in enumerate(parts)]


def hashed_dictionary(lists: DataFrame) -> DataFrame:
    """Per part its distinct strings, each hashed once: a row per side with the counts of its buckets (arrays), and
    a row per page of the documents with the buckets of the page's strings."""

    def solve(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        sides, pages = (rows.column(c).to_pylist() for c in ("side", "page"))
        hashed = hashed_lists([(_unpacked(a.as_buffer()), _values(b.as_buffer(), np.uint32)) for a, b in zip(rows.column("strings"), rows.column("numbers"), strict=True)])
        out: dict[str, list] = {c: [] for c in ("page", "part", "buckets", "side", "of", "n")}

        def put(**row):
            for c in out:
                out[c].append(row.get(c))

        for side in sorted(set(sides)):
            n = np.zeros(BUCKETS, np.int64)
            for (counts, buckets), s in zip(hashed, sides, strict=True):
                if s == side:
                    n += np.bincount(buckets, counts, BUCKETS).astype(np.int64)  # exact below 2**53
            put(side=side, of=np.flatnonzero(n).tolist(), n=n[n > 0].tolist())
        for (_, buckets), page, side in zip(hashed, pages, sides, strict=True):
            if side == 0:
                put(page=page, part=part, buckets=_planes(buckets))
        kinds = {"page": pa.string(), "part": pa.int32(), "buckets": pa.binary(), "side": pa.int32(), "of": pa.list_(pa.int32()), "n": pa.list_(pa.int64())}
        table = pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})
        del out, hashed
        release_memory()
        return table

    return lists.groupBy("part").applyInArrow(solve, "page string, part int, buckets binary, side int, of array<int>, n array<long>")


def bucket_gains(documents: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln of the smoothed share among target features over that among documents)."""
    s, t = sum(documents.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((documents.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], np.int64)


def feature_weights(docs: DataFrame, target: DataFrame, page_bytes: int = PAGE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, n_words, n_features, weight: a row per document (columns doc_id, text; the target table has a text)."""
    spark = docs.sparkSession
    small_batches(spark)
    located = _located(docs, "doc_id")
    size = located.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-STRINGS_A_BYTE * size // part_bytes))
    wanted = target.select(F.lit(None).cast("long").alias("id"), "text")
    lists = dictionary_lists(located, n_parts, 0, page_bytes).unionByName(dictionary_lists(_located(wanted, "id"), n_parts, 1, page_bytes))
    hashed = staged(hashed_dictionary(lists), "hashed")
    sums = hashed.filter("page is null").select("side", F.explode(F.arrays_zip("of", "n")).alias("x")).groupBy("side", "x.of").agg(F.sum("x.n").alias("n")).collect()  # two rows a bucket
    gains = bucket_gains(*({r["of"]: r["n"] for r in sums if r["side"] == side} for side in (0, 1)))
    shared = spark.sparkContext.broadcast(gains)  # a number a bucket

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in _pages(batches, page_bytes):
            known = pa.array(texts, pa.large_string())
            lengths = _numbers(np.array([-1 if t is None else len(t.encode("utf-8", "replace")) for t in texts], np.int64))
            flat = known.drop_null()
            body = _squeezed(_joined(known.drop_null(), ""))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.binary()), pa.array([body], pa.binary())], names=["page", "ids", "lengths", "body"])
        release_memory()

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for ids, lengths, body in zip(*(left.column(c).to_pylist() for c in ("ids", "lengths", "body")), strict=True):
            sizes, raw = _values(lengths, np.int64), _expanded(body).to_pybytes()
            ends = np.cumsum(np.maximum(sizes, 0)).tolist()
            page = Page([None if n < 0 else raw[end - n : end].decode("utf-8") for n, end in zip(sizes.tolist(), ends, strict=True)])
            found = dict(zip(right.column("part").to_pylist(), right.column("buckets").to_pylist(), strict=True))
            if sum(page.sizes) and not found:
                raise ValueError("the documents changed between two reads")
            buckets, cuts = [np.empty(n, np.int64) for n in page.sizes], page.cuts(n_parts)
            for p, raw in found.items():
                one, two, three = cuts.part(p)
                got = np.split(_from_planes(raw), np.cumsum([one.stop - one.start, two.stop - two.start]))
                buckets[0][cuts.singles[one]], buckets[1][cuts.stems[two][cuts.own[two]]], buckets[2][cuts.triples[three]] = got[0], got[1][cuts.own[two]], got[2]
            bucket = np.concatenate(buckets)
            weight = np.bincount(page.texts, shared.value[bucket].astype(np.float64)[page.grams], len(ids))  # exact below 2**53
            out.append((ids, np.diff(page.ends), np.bincount(page.texts, minlength=len(ids)), weight))
        columns = list(zip(*out, strict=True)) or [([],)] * 4
        return pa.table({"id": pa.array([i for ids in columns[0] for i in ids], pa.int64()), **{n: pa.array(np.concatenate(v).astype(np.int64)) for n, v in zip(("n_words", "n_features", "weight"), columns[1:], strict=True)}})

    pages = located.mapInArrow(packed, "page string, ids array<long>, lengths binary, body binary")
    buckets = hashed.filter("page is not null").select("page", "part", "buckets")
    return staged(pages.groupBy("page").cogroup(buckets.groupBy("page")).applyInArrow(weigh, "id long, n_words long, n_features long, weight long"), "weights")


def gumbel(seed: int = SEED):
    """The document's share of chance in its score, from a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **sizes) -> DataFrame:
    """Per row: doc_id, n_features, weight, score and, for the drawn ones, rank (from 1)."""
    weights = feature_weights(docs, target, **sizes).withColumnRenamed("id", "doc_id")
    rows = staged(weights.withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    able = rows.filter((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()).withColumn("_score", F.col("score").cast("double"))
    k = percent * able.count() // 100
    wanted = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*wanted, F.lit(None).cast("long").alias("rank"))
    last = kth_largest(able, k, "_score", "doc_id")
    drawn = (F.col("n_words") >= least_words) & at_or_above(last, "_score", "doc_id")
    marked = rows.withColumn("_score", F.col("score").cast("double")).withColumn("_drawn", F.coalesce(drawn, F.lit(False)))
    ranked = with_positions(marked.filter("_drawn").select(*wanted), "-score", "doc_id", out="_place")
    rank = F.when(F.col("_place") < k, F.col("_place") + 1).alias("rank")
    return ranked.select(*wanted, rank).unionByName(marked.filter("not _drawn").select(*wanted, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **rule) -> DataFrame:
    """The drawn documents themselves, with rank and score (after underscores if they have such columns); rows of one
    doc_id are drawn together."""
    key, rank, score = fresh(docs, "_drawn", "rank", "score")
    ranks = resampled(docs, target, **rule).filter("rank is not null")
    best = ranks.groupBy(F.col("doc_id").alias(key)).agg(F.min("rank").alias(rank), F.max("score").alias(score))
    return docs.join(best, F.col("doc_id").cast("long") == F.col(key)).drop(key)


def op12(spark, sf_dir):
    from .runtime import table

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A byte-wise CRC with a table that is made by its rule; each distinct feature goes through it once.
SQL = r"""
WITH RECURSIVE t(step, i, v) AS (SELECT 0, i, i FROM range(256) r(i) UNION ALL
  SELECT step + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v::BIGINT ORDER BY i) AS v FROM t WHERE step = 8),
w AS MATERIALIZED (SELECT r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT row_number() OVER () AS r, doc_id, text, 0 AS side FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, 1 FROM benchmark)),
f AS MATERIALIZED (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM w),
n AS MATERIALIZED (SELECT f, count_if(side = 0) AS s, count_if(side = 1) AS t FROM f GROUP BY f),
b AS MATERIALIZED (SELECT f, s, t, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, x: xor(c >> 8, crc.v[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
      FROM (SELECT f, s, t, hex(encode(f)) AS h FROM n), crc),
g AS (SELECT b, floor(1000 * ln((sum(t) + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM b GROUP BY b),
x AS (SELECT w.r, any_value(w.doc_id) AS doc_id, any_value(len(w.w)) AS n_words, count(f.f)::BIGINT AS n_features, coalesce(sum(g.gain), 0)::BIGINT AS weight
      FROM w LEFT JOIN f ON f.side = 0 AND f.r = w.r LEFT JOIN b ON b.f = f.f LEFT JOIN g ON g.b = b.b WHERE w.side = 0 GROUP BY w.r),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS able, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= floor(5 * (SELECT count(*) FROM z WHERE able) / 100) THEN k END AS rank FROM z
"""
