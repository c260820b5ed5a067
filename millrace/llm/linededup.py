"""Operator 11, line dedup by sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of white space at both ends with A-Z lower-cased, held as a 128-bit hash.  A line
index (:class:`LineIndex`) is a folder of three tables:

* ``refs``, the exact reference counts: how often a document holds a key.  An insertion appends its counts, a deletion
  appends them negated; the count is the sum, so both are reversible and nothing is rewritten.
* ``filters``, a chain of cuckoo filters per shard of the keys, with one fingerprint for each key that has references.
* ``suspects``, the keys that the filters have ever answered "present" for, or that one task met in several documents.

Inserting documents writes their references where the texts are read, then sends every key (a row per key and task,
so a line of a third of all documents costs a row a task) to its shard, where it passes the filter: absent keys are
inserted, keys that are present are suspects.  Keys that are no suspects have one document and are never counted.  A
suspect that was answered "present" each time is looked up in the exact table; if it has no older references the
answer was false, and its fingerprint is inserted too.  So each key with references has exactly one fingerprint, and a
deletion that takes a key's last reference takes exactly that one away.

Decisions come from the exact counts of the suspects alone: keys in at least ``MIN_DOCS`` documents lose their lines
everywhere but in the largest doc_id that holds them.  Only pairs of such a key and a document are joined back to
texts.

Every step writes a new version beside the old ones, which counts once its marker is there: a step that is broken off
leaves the last whole version.

Defined cases: null and empty texts are one empty line; keys below ``MIN_CHARS`` code points are never dropped; rows
with one doc_id are one document, whatever their texts; rows without doc_id can't be referenced, so they are not
inserted, count nowhere and keep their lines; inserting a document again adds to its references; an empty table gives
no rows; other columns, whatever their names, are ignored by :func:`line_report` and kept by :func:`drop_lines`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .cuckoo import LOAD, SLOTS, CuckooFilters
from .runtime import fresh, map_batches, shared_dir, sized, staged

#: Code points of a key, and documents that hold it, from which its lines are dropped.
MIN_CHARS, MIN_DOCS = 20, 3
#: Buckets of a filter, and keys of a shard when the index is made.
BUCKETS = 1 << 16
SHARD_KEYS = int(LOAD * BUCKETS * SLOTS)
#: Keys that a task gathers before it sends them on, and that pass a filter at once.
TASK_KEYS, BLOCK = 1 << 21, 1 << 16

_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The 128-bit key of a line in UTF-8; None if the line is too short to have one."""
    key = line.strip()  # of bytes: exactly the ASCII white space
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.translate(None, _CONTINUATION)) < least):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def references(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """A row per key and run of documents: k1, k2, docs (ids, ascending) and ns (how often each holds the key)."""

    def make():
        def run(cols):
            keys, owners = [], []
            for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
                for line in _lines(text):
                    key = line_key(line, least) if len(line) >= least else None
                    if key is not None:
                        keys.append(key)
                        owners.append(doc)
            pairs = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            k1, k2, doc = pairs[:, 0], pairs[:, 1], np.array(owners, np.int64)
            order = np.lexsort((doc, k2, k1))
            k1, k2, doc = k1[order], k2[order], doc[order]
            first = np.ones(len(doc), bool)
            first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            pair = first.copy()
            pair[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(pair)
            n = np.diff(np.append(at, len(doc))).astype(np.int32)
            offsets = pa.array(np.append(np.flatnonzero(first[at]), len(at)).astype(np.int32))
            return {"k1": pa.array(k1[first]), "k2": pa.array(k2[first]), "docs": pa.ListArray.from_arrays(offsets, pa.array(doc[at])), "ns": pa.ListArray.from_arrays(offsets, pa.array(n))}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return map_batches(rows, make, "k1 long, k2 long, docs array<long>, ns array<int>")


def distinct_keys(k1: np.ndarray, k2: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, the number of their rows, and the sums of further values."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    return [a[at], b[at], np.diff(np.append(at, len(a))), *(np.add.reduceat(v[order], at) if len(at) else v for v in values)]


def _numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy()) for n in names]


def _gathered(rows: DataFrame) -> DataFrame:
    """(k1, k2, n_docs) with a row per key and task instead of one per key and run of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            k1, k2, _, n = distinct_keys(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(k1), BLOCK):
                some = slice(at, at + BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array(n[some])], names=["k1", "k2", "n_docs"])

        held, size = [], 0
        for batch in batches:
            held.append(_numbers(batch, "k1", "k2", "n_docs"))
            size += batch.num_rows
            if size >= TASK_KEYS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return rows.select("k1", "k2", F.size("docs").cast("long").alias("n_docs")).mapInArrow(run, "k1 long, k2 long, n_docs long")


def pass_filter(filters: CuckooFilters, k1: np.ndarray, k2: np.ndarray, n_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passes rows of keys through a shard's filters in blocks: absent keys are inserted.  Returns the suspects (k1, k2)
    and whether each was answered "present" every time it came, so that it has not been inserted."""
    hits: list[tuple] = []
    for at in range(0, len(k1), BLOCK):
        a, b, rows, docs = distinct_keys(k1[at : at + BLOCK], k2[at : at + BLOCK], n_docs[at : at + BLOCK])
        present = filters.contains(a, b)
        filters.insert(a[~present], b[~present])
        doubtful = present | (docs > 1)
        hits.append((a[doubtful], b[doubtful], np.where(present, rows, rows - 1)[doubtful]))
    a, b, _, answered = distinct_keys(*(np.concatenate(x) for x in zip(*hits, strict=True))) if hits else (k1, k2, None, k1)
    # Rows of the suspects among all rows, in the same order.
    here = np.repeat([1, 0], [len(k1), len(a)])
    *_, came, asked = distinct_keys(np.concatenate([k1, a]), np.concatenate([k2, b]), here, 1 - here)
    return a, b, answered == came[asked > 0]


class LineIndex:
    """The index in a folder; a new instance on the same folder goes on with its last whole version."""

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = MIN_CHARS):
        self.spark, self.least = spark, least
        self.path = (path or f"{shared_dir(spark)}/millrace/lines-{uuid.uuid4().hex}").rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = jvm.Path
        done = [n.split("=") for n in self._names("done")]
        self.version, self.shards = max(((int(v), int(s)) for v, s in (n[1].split("-") for n in done)), default=(0, 0))

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read(self, what: str, versions, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/v={v}" for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, what: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/v={self.version + 1}")

    def _done(self) -> None:
        self.version += 1
        self._fs.mkdirs(self._at(f"{self.path}/done/v={self.version}-{self.shards}"))

    def refs(self) -> DataFrame:
        """All references, negated ones of deletions included: k1, k2, docs, ns."""
        return self._read("refs", range(1, self.version + 1), "k1 long, k2 long, docs array<long>, ns array<int>")

    def suspects(self) -> DataFrame:
        return self._read("suspects", range(1, self.version + 1), "k1 long, k2 long").distinct()

    def filters(self) -> DataFrame:
        """shard, tables: a row per shard."""
        return self._read("filters", [self.version] if self.version else [], "shard int, tables binary")

    def _shard(self, shards: int):
        return F.pmod(F.shiftright("k1", 32), F.lit(shards)).cast("int").alias("shard")

    @staticmethod
    def pairs(refs: DataFrame) -> DataFrame:
        """k1, k2, doc of all documents that hold a key: those whose references don't sum up to nothing."""
        each = refs.select("k1", "k2", F.explode(F.arrays_zip("docs", "ns")).alias("r")).select("k1", "k2", F.col("r.docs").alias("doc"), F.col("r.ns").alias("n"))
        return each.groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n")).filter("n > 0")

    def _update(self, filters: DataFrame, keys: DataFrame, step: str) -> DataFrame:
        """Shards and keys meet: ``pass`` (through the filters), ``insert`` or ``delete``.  A row per shard with its
        tables, and a row per suspect with whether it was never inserted."""

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            raw = right.column("tables").to_pylist()
            chain = CuckooFilters(BUCKETS, raw[0] if raw else b"")
            k1, k2, n_docs = _numbers(left, "k1", "k2", "n_docs")
            found: tuple = (k1[:0], k2[:0], np.zeros(0, bool))
            if step == "pass":
                found = pass_filter(chain, k1, k2, n_docs)
            else:
                getattr(chain, step)(k1, k2)
            shard = (left.column("shard") if left.num_rows else right.column("shard"))[0].as_py()
            n = len(found[0])
            return pa.table({
                "shard": pa.array([shard] * (n + 1), pa.int32()), "tables": pa.array([chain.to_bytes(), *[None] * n], pa.binary()),
                "k1": pa.array([0, *found[0].tolist()], pa.int64()), "k2": pa.array([0, *found[1].tolist()], pa.int64()), "missing": pa.array([False, *found[2].tolist()], pa.bool_()),
            })

        both = keys.select(self._shard(self.shards), "k1", "k2", "n_docs").groupBy("shard").cogroup(filters.groupBy("shard"))
        return staged(both.applyInArrow(meet, "shard int, tables binary, k1 long, k2 long, missing boolean"), f"filters-{step}")

    def insert(self, docs: DataFrame) -> None:
        """Adds the documents' lines."""
        older = self.refs()
        self._write(references(docs, self.least), "refs")
        new = self._read("refs", [self.version + 1], "k1 long, k2 long, docs array<long>, ns array<int>")
        size, filters = new.count(), self.filters()
        if size > 4 * self.shards * SHARD_KEYS or not self.shards:
            # More shards, filled from the exact table, so that a shard's keys of one insertion fit a task.
            self.shards = max(1, -(-size // SHARD_KEYS), 2 * self.shards)
            if self.version:
                live = self.pairs(older).select("k1", "k2").distinct().withColumn("n_docs", F.lit(1).cast("long"))
                filters = self._tables(self._update(filters.limit(0), live, "insert"))
        met = self._update(filters, _gathered(new), "pass")
        filters, suspects = self._tables(met), met.filter("tables is null")
        missing = suspects.filter("missing").select("k1", "k2")
        # Answered "present" each time, yet without older references: the fingerprint was another key's.
        known = self.pairs(older.join(sized(missing), ["k1", "k2"], "left_semi")).select("k1", "k2").distinct()
        false = staged(missing.join(known, ["k1", "k2"], "left_anti").withColumn("n_docs", F.lit(1).cast("long")), "false-answers")
        if not false.isEmpty():
            filters = self._tables(self._update(filters, false, "insert"))
        self._write(suspects.select("k1", "k2"), "suspects")
        self._write(filters, "filters")
        self._done()

    @staticmethod
    def _tables(met: DataFrame) -> DataFrame:
        return met.filter("tables is not null").select("shard", "tables")

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes all references of the documents away; ids that hold nothing are ignored."""
        gone = staged(doc_ids.select(F.col("doc_id").cast("long").alias("doc")).filter("doc is not null").distinct(), "deleted")
        held = staged(self.pairs(self.refs()).join(sized(gone), "doc", "left_semi"), "deleted-pairs")
        back = held.select("k1", "k2", F.array("doc").alias("docs"), F.array((-F.col("n")).cast("int")).alias("ns"))
        touched = held.select("k1", "k2").distinct()
        every = self.refs().join(sized(staged(touched, "touched")), ["k1", "k2"], "left_semi").unionByName(back)
        live = self.pairs(every).select("k1", "k2").distinct()
        dead = staged(touched.join(live, ["k1", "k2"], "left_anti").withColumn("n_docs", F.lit(0).cast("long")), "dead-keys")
        self._write(back, "refs")
        self._write(touched.limit(0), "suspects")
        self._write(self._tables(self._update(self.filters(), dead, "delete")), "filters")
        self._done()

    def common(self, least_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
        """(k1, k2, n_docs, last_doc of the keys in at least that many documents; the pairs of suspects and documents)."""
        held = self.refs().join(sized(staged(self.suspects(), "suspects")), ["k1", "k2"], "left_semi")
        pairs = staged(self.pairs(held).select("k1", "k2", "doc"), "pairs")
        keys = pairs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        return staged(keys.filter(F.col("n_docs") >= least_docs), "common-lines"), pairs

    def drops(self, least_docs: int = MIN_DOCS) -> DataFrame:
        """doc, keys: of each document that loses lines, the keys (16 bytes each, joined) of those."""
        keys, pairs = self.common(least_docs)
        lost = pairs.join(sized(keys), ["k1", "k2"]).filter(F.col("doc") < F.col("last_doc"))
        raw = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
        return staged(lost.groupBy("doc").agg(F.collect_list(raw).alias("keys")), "lost-lines")


def _kept(least: int):
    @arrow_udf("text string, dropped long")
    def kept(text: pa.Array, keys: pa.Array) -> pa.Array:
        texts, counts = [], []
        for t, k in zip(text.to_pylist(), keys.to_pylist(), strict=True):
            if k is None:
                texts.append(None)
                counts.append(0)
                continue
            gone, lines = set(k), _lines(t)
            left = [line for line in lines if line_key(line, least) not in gone]
            texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
            counts.append(len(lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["text", "dropped"])

    return kept


def _rewritten(docs: DataFrame, index: LineIndex, least_docs: int) -> tuple[DataFrame, str, str]:
    """The rows with a column that holds their kept text (null: unchanged) and the number of dropped lines."""
    key, keys, new = fresh(docs, "_doc", "_keys", "_kept")
    lost = index.drops(least_docs).withColumnsRenamed({"doc": key, "keys": keys})
    joined = docs.join(sized(lost), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    # Texts that lose nothing don't go to Python.
    touched = F.when(F.col(keys).isNotNull(), F.col("text"))
    return joined.withColumn(new, _kept(index.least)(touched, F.col(keys))).drop(keys), f"{new}.text", f"{new}.dropped"


def drop_lines(docs: DataFrame, least: int = MIN_CHARS, least_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """The documents without the lines that the index (by default one of these documents) gives to other documents."""
    if index is None:
        index = LineIndex(docs.sparkSession, least=least)
        index.insert(docs)
    out, text, _ = _rewritten(docs, index, least_docs)
    return out.withColumn("text", F.coalesce(text, "text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, least: int = MIN_CHARS, least_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    if index is None:
        index = LineIndex(docs.sparkSession, least=least)
        index.insert(docs)
    out, text, dropped = _rewritten(docs, index, least_docs)
    whole = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.regexp_count(whole, F.lit("\n")) + 1).cast("long").alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2(F.coalesce(F.col(text), whole), 256).alias("kept_sha256"))


def op11(spark, sf_dir):
    from .runtime import table

    return line_report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.r, l.doc_id, l.i, l.line, coalesce(l.doc_id < k.last, false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
