"""Exact token ids of whole texts through a public vocabulary, with a cache of white-space chunks.

The lower-casing word vocabulary never merges across ASCII white space, so a text's ids are the ids of its
white-space chunks in a row.  The strings of its special tokens, which hold no white space either, stand for these tokens, as
they do for the library.  Chunks are encoded once by the ``tokenizers`` library and reused; a text then
costs a split and one dictionary lookup a chunk.  The equality with encoding the whole text is tested.
"""

from __future__ import annotations

import numpy as np

from .textkit import split_words

#: Distinct chunks of a generation of the cache (about 150 bytes each); a task keeps two.
CHUNKS = 200_000
#: Chunks above this many characters are encoded each time and not kept.
LONG_CHUNK = 64

#: Letters below this code point stay letters, one word each, under the vocabulary's normaliser.
_PLAIN = "\u0130"

_STOPS = (",", ".")

#: What the strings of special tokens begin with; in a text they are those tokens.
_SPECIAL = "<|"

_VOCABULARIES: dict[str | None, Vocabulary] = {}


class Vocabulary:
    """A tokenizer file, loaded once a process: the tokenizer itself, a lighter one for plain words, word ends."""

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case letters come out of the normaliser and the splitter as they are; the model is shared.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])


def _chunks(texts: list[str | None]):
    """Words folded to lower case, which the vocabulary does anyway; but its special strings are told from others by case."""
    return split_words(texts, fold_case=not any(t and _SPECIAL in t for t in texts))


class ChunkEncoder:
    """Encodes texts through a vocabulary; the cache lives as long as the encoder, one task."""

    def __init__(self, vocabulary: Vocabulary, chunks: int = CHUNKS):
        self.vocabulary, self.limit = vocabulary, chunks
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_new(self, chunks: list[str]) -> None:
        """Puts the ids of chunks that the cache lacks into it."""
        cache = self.cache
        # A comma or full stop after a plain letter is a token of its own, so such a chunk is its stem's ids and one more.
        stems, rest = [], []
        for c in chunks:
            (stems if c.endswith(_STOPS) and c[-2:-1].isalpha() and c[-2] < _PLAIN else rest).append(c)
        new = {c[:-1] for c in stems}.difference(rest)
        rest += [c for c in new if c not in cache]
        rest += [c for c in _STOPS if c not in cache]
        # Plain words are encoded as lines of many words and told apart by their end-of-word tokens.
        words = [c for c in rest if c.isalpha() and (c.isascii() or max(c) < _PLAIN)]
        spoken = [c.lower() for c in words]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            lines = [" ".join(spoken[k : k + 500]) for k in range(at, at + len(part), 500)]
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.vocabulary.plain.encode_batch_fast(lines, add_special_tokens=False)])
            raw, bounds = ids.tobytes(), (4 * (np.flatnonzero(self.vocabulary.ends_word[ids]) + 1)).tolist()
            if len(bounds) != len(part):
                raise ValueError("the vocabulary does not end every word with an end-of-word token")
            cache.update(zip(part, [raw[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)], strict=True))
        plain = set(words)
        others = [c for c in rest if c not in plain]
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for chunk, e in zip(part, self.vocabulary.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[chunk] = np.asarray(e.ids, "<u4").tobytes()
        for chunk in stems:
            cache[chunk] = cache[chunk[:-1]] + cache[chunk[-1]]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, from the cache's two generations or encoded now."""
        if len(self.cache) > self.limit:  # the generation before last goes, chunks in use move on
            self.older, self.cache = self.cache, {}
        self.cache[""] = b""
        cache, older = self.cache, self.older
        known = [cache.get(c) for c in chunks]
        missing = []
        for c, k in zip(chunks, known, strict=True):
            if k is None:
                k = older.get(c)
                if k is None:
                    missing.append(c)
                else:
                    cache[c] = k
        if missing:
            self._encode_new(missing)
        out = [cache[c] if k is None else k for c, k in zip(chunks, known, strict=True)]
        for c in missing:
            if len(c) > LONG_CHUNK:
                del cache[c]
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, words, ends = _chunks(texts)
        chunks = self._ids_of(words.to_pylist())
        sizes = np.fromiter(map(len, chunks), np.int64, count=len(chunks)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(sizes[numbers])])[ends])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null and empty texts."""
        numbers, words, ends = _chunks(texts)
        chunks = self._ids_of(words.to_pylist())
        ends = ends.tolist()
        return [b"".join([chunks[i] for i in numbers[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str | None = None) -> ChunkEncoder:
    """A new encoder of a vocabulary that is loaded once a process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return ChunkEncoder(_VOCABULARIES[path])
