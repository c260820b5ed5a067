"""Operator 4, best-fit packing by best-two-fit on the length histogram.

Only three small things move: a row per piece (never its ids), a histogram with at most ``capacity``
lengths, and the slot table made from it.  Bins are filled greedily with the longest pieces that fit; then
the bin's smallest piece is replaced by the two unpacked pieces that fill its expanded gap best, as long as
that gets tighter.  Equal bins are made in one step with a multiplicity, so the driver's work depends on the
number of distinct lengths and not on the number of documents.  Pieces find their slot by their rank within
their length; ranks are counted within (length, salt) groups and shifted by the groups before, so that no
length is ranked by one task.

Defined cases: null and empty texts are the terminator alone; a text longer than the capacity is cut into
full pieces and a rest; rows that repeat are packed each; doc_id is read as a long, null for ids that are no
numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import map_batches, staged

CAPACITY = 2048
#: The id that ends every document.
END = b"\0\0\0\0"
#: Pieces that share a rank group, on average for a length that holds every piece.
GROUP_ROWS = 50_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece of each document's ids: doc_id, piece, start, length and the CRC-32 of its ids."""

    def make():
        enc = encoder(path)

        def run(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(cols["doc_id"], enc.encode(cols["text"]), strict=True):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            return out

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Length -> how many, packed: [(bin as [(length, times), ...] in order, number of such bins), ...]."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    lengths = np.arange(capacity + 1)
    bins = []

    def below() -> np.ndarray:
        """For each gap the longest piece that is left and fits, 0 if none does."""
        return np.maximum.accumulate(np.where(have > 0, lengths, 0))

    while have.any():
        used: dict[int, int] = {}

        def take(length: int, n: int = 1, used=used) -> None:
            have[length] -= n
            used[length] = used.get(length, 0) + n
            if not used[length]:
                del used[length]

        gap, fit = capacity, below()
        while length := int(fit[gap]):
            n = min(int(have[length]), gap // length)
            take(length, n)
            gap -= n * length
            if not have[length]:
                fit = below()
        while gap and used:
            small = min(used)
            room, fit = gap + small, below()
            first = np.flatnonzero(have[: room + 1] > 0)
            second = fit[room - first]
            alone = (second == first) & (have[first] < 2)  # the same piece can't be taken twice
            second = np.where(alone, fit[np.maximum(first - 1, 0)], second)
            sums = np.where(second > 0, first + second, 0)
            if not len(sums) or sums.max() <= small:
                break
            best = int(sums.argmax())
            take(small, -1)
            take(int(first[best]))
            take(int(second[best]))
            gap = room - int(sums[best])
        more = min(int(have[length]) // n for length, n in used.items())
        for length, n in used.items():
            have[length] -= more * n
        bins.append((sorted(used.items(), reverse=True), more + 1))
    return bins


def slot_table(bins) -> dict[int, tuple[np.ndarray, ...]]:
    """Length -> arrays (first rank, first sequence, pieces of that length a bin, offset of the first) by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: dict[int, int] = {}
    sequence = 0
    for items, times in bins:
        offset = 0
        for length, n in items:
            rank = ranked.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, n, offset))
            ranked[length] = rank + n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces (any table with doc_id, piece, start, length)."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = parts.sparkSession.sparkContext.broadcast(slot_table(best_two_fit(counts, capacity)))
    salts = max(8, -(-sum(counts.values()) // group_rows))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(groups.select("length", "_salt", before.alias("_before")), ["length", "_salt"])
    slim = ranked.select(*parts.columns, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def make():
        table = slots.value

        def run(cols):
            length, rank = np.array(cols["length"], np.int64), np.array(cols["_rank"], np.int64)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, base, each, start = table[int(value)]
                run_ = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[run_]
                sequence[at] = base[run_] + k // each[run_]
                offset[at] = start[run_] + k % each[run_] * value
            return {**cols, "sequence_id": sequence, "offset": offset}

        return run

    ddl = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return map_batches(slim, make, ddl)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(staged(pieces(docs, capacity, path), "pieces"), capacity)


def op4(spark, sf_dir):
    from .runtime import table

    return pack_documents(table(spark, sf_dir, "documents"))
