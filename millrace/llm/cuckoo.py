"""Cuckoo filters over 128-bit keys (two 64-bit numbers), vectorised; nothing here imports Spark.

A key's fingerprint of 16 bits lies in one of two buckets of four slots, so a lookup reads eight slots and a key that
was inserted can be deleted again.  Filters of one size are chained: where the last one is as full as is safe, or a
displaced fingerprint finds no room, another one is added, so a shard never overflows and needs no keys to grow.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of the slots that are filled before another filter is added, and displacements that are tried.
LOAD, KICKS = 0.9, 500
_SPREAD = np.uint64(0x5BD1E9955BD1E995)


class CuckooFilters:
    """A chain of cuckoo filters with ``buckets`` (a power of two) buckets each."""

    def __init__(self, buckets: int, raw: bytes = b""):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.tables = [t.copy() for t in np.frombuffer(raw, np.uint16).reshape(-1, buckets, SLOTS)]

    def to_bytes(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)

    def __len__(self) -> int:
        return sum(int(np.count_nonzero(t)) for t in self.tables)

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets."""
        fp = np.maximum(k2.view(np.uint64) & np.uint64(0xFFFF), np.uint64(1))
        first = (k1.view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp.astype(np.uint16), first, self._other(first, fp)

    def _other(self, bucket, fp):
        with np.errstate(over="ignore"):
            step = (np.asarray(fp, np.uint64) * _SPREAD) >> np.uint64(20)
        return bucket ^ (step & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, first, second = self._places(k1, k2)
        out = np.zeros(len(fp), bool)
        for t in self.tables:
            out |= (t[first] == fp[:, None]).any(1) | (t[second] == fp[:, None]).any(1)
        return out

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """One fingerprint for each of the keys."""
        fp, first, second = self._places(k1, k2)
        at, room = 0, 0
        while at < len(fp):
            if self.tables:
                room = int(LOAD * self.buckets * SLOTS) - int(np.count_nonzero(self.tables[-1]))
            if room <= 0:
                self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
                continue
            part = slice(at, at + room)
            self._fill(fp[part], first[part], second[part])
            at += room

    def _fill(self, fp: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        table, left = self.tables[-1], np.arange(len(fp))
        for bucket in (first, second):
            left = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[left]
            start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])[: len(b)])
            rank = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
            free = table[b] == 0
            ok = rank < free.sum(1)
            slot = ((np.cumsum(free, 1) == rank[:, None] + 1) & free).argmax(1)
            table[b[ok], slot[ok]] = fp[left[ok]]
            left = left[~ok]
        for i in left.tolist():
            self._kick(int(fp[i]), int(first[i]))

    def _kick(self, fp: int, bucket: int) -> None:
        """Displaces fingerprints until one finds a free slot; the last one goes to another filter, at its own buckets."""
        table = self.tables[-1]
        for step in range(KICKS):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = fp
                return
            slot = (fp + step) % SLOTS
            fp, table[bucket, slot] = int(table[bucket, slot]), fp
            bucket = int(self._other(np.int64(bucket), fp))
        self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
        self.tables[-1][bucket, 0] = fp

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes one fingerprint away for each of the keys, which must have been inserted."""
        fp, first, second = self._places(k1, k2)
        left = np.arange(len(fp))
        for t in self.tables:
            for bucket in (first, second):
                while len(left):
                    hit = t[bucket[left]] == fp[left, None]
                    there = np.flatnonzero(hit.any(1))
                    slot = bucket[left[there]] * SLOTS + hit[there].argmax(1)
                    taken = there[np.unique(slot, return_index=True)[1]]  # keys of one slot take turns
                    if not len(taken):
                        break
                    t[bucket[left[taken]], hit[taken].argmax(1)] = 0
                    left = np.delete(left, taken)
        if len(left):
            raise KeyError(f"{len(left)} keys were never inserted")
        self.tables = [t for t in self.tables if t.any()]
