"""Byte-level text kernels shared by the operators of this subpackage.

All functions take whole Python strings (or ``None``) and work on UTF-8 bytes, where the ASCII white
space ``\\x20 \\x09-\\x0D`` can be split on with ``bytes.split`` because no multi-byte code point contains
those bytes.  Nothing here imports Spark, so the kernels are tested without a session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijective finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def split_words(texts: list, fold_case: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number per word in order, distinct words, offsets of the texts), split at ASCII white space.

    Null is an empty text.  Splitting, folding (A-Z only) and numbering are Arrow kernels; Python sees a
    distinct word once.
    """
    column = pa.array([t or "" for t in texts], pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if fold_case else column)
    coded = lists.flatten().dictionary_encode()
    numbers, words = coded.indices.to_numpy(), coded.dictionary
    ends = lists.offsets.to_numpy().astype(np.int64)
    blank = pc.index(words, "").as_py()  # white space at a text's ends leaves empty pieces
    if blank >= 0:
        keep = numbers != blank
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        numbers = numbers[keep]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])
    return numbers, words, ends


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, count=len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes; shorter texts give the whole run as one."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    count = len(words) - n + 1
    acc = np.full(count, np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = splitmix(acc * _GOLD + words[k : k + count])
    return acc


def shingle_sets(texts: list, n: int, fold_case: bool = True) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as a sorted array of 64-bit hashes.

    Words are hashed once and combined in one vectorised pass; shingles that would straddle two texts are
    never taken.
    """
    numbers, words, ends = split_words(texts, fold_case)
    flat = word_hashes(words)[numbers] if len(numbers) else np.empty(0, np.uint64)
    whole = ngram_hashes(flat, n) if len(flat) >= n else np.empty(0, np.uint64)
    out = []
    for at, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(np.unique(whole[at : end - n + 1]) if end - at >= n else ngram_hashes(flat[at:end], n))
    return out
