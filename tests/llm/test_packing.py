import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import lengths, packing
from millrace.llm.encoding import ChunkEncoder, encoder

from .helpers import awkward, documents, prose


def whole(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # a fresh one, as the contract says
    return [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunked_encoding_equals_the_whole_text():
    rng = random.Random(4)
    alphabet = "aBc éÉ.,'sSİıſ  \t\n1٣-<|>endoftextḰß中😀"
    texts = [*awkward(), "<|endoftext|> it's I'LL x<|startoftext|>", "L'été, c'est ça. Ç,", "a <|endoftext|> b", "A <|ENDOFTEXT|> x<|startoftext|><|EndOfText|>, <|endoftext|>.", "<|endoftext"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(600)]
    assert encoder(None).encode(texts) == whole(texts)
    assert encoder(None).lengths(texts).tolist() == [len(x) // 4 for x in whole(texts)]
    small = ChunkEncoder(encoder(None).vocabulary, chunks=20)  # the cache turns over all the time
    for at in range(0, len(texts), 50):
        assert small.encode(texts[at : at + 50]) == whole(texts[at : at + 50])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_best_two_fit(counts):
    bins = packing.best_two_fit(counts, 64)
    used = {}
    for items, times in bins:
        assert sum(length * n for length, n in items) <= 64 and times > 0
        for length, n in items:
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in bins) <= max(1, 2 * total // 64 + 1)


def test_pairs_beat_the_greedy_fill():
    # 50 + 8 leaves 6; replacing 8 by 7 + 7 fills the bin.
    assert packing.best_two_fit({50: 1, 8: 1, 7: 2}, 64)[0][0] == [(50, 1), (7, 2)]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    rng = random.Random(3)
    texts = [*awkward(), *(prose(rng, rng.randrange(1, 400)) for _ in range(200))]
    docs = documents(spark, texts, extra=True)
    docs = docs.union(docs.where("doc_id < 20"))
    rows = packing.pack_documents(docs, capacity).collect()
    ids = [x + packing.END for x in whole(texts)]
    of = {}
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and r["start"] == r["piece"] * capacity
        assert r["length"] == capacity or r["start"] * 4 + len(part) == len(ids[r["doc_id"]])
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[r["doc_id"]]) // 4 for r in docs.collect())
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(of) <= sum(r["length"] for r in rows) / capacity * 1.05 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_length_histogram(spark):
    texts = awkward() * 2
    n = sorted(len(x) // 4 for x in whole(texts))
    hist = lengths.histogram(lengths.encoded_lengths(documents(spark, texts, extra=True)))
    rows = hist.orderBy("length").collect()
    assert [(r["length"], r["n_docs"]) for r in rows] == sorted((k, n.count(k)) for k in set(n))
    for r in rows:
        k = r["length"]
        assert r["docs_upto"] == sum(x <= k for x in n) and r["tokens_upto"] == sum(x for x in n if x <= k)
        assert r["docs_from"] == sum(x >= k for x in n) and r["tokens_from"] == sum(x for x in n if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n)
        assert r["docs_over"] == sum(x > k for x in n) and r["share_upto"] == sum(x <= k for x in n) / len(n)
    for r in lengths.at_limits(hist, [0, 1, 100, 5000, 10**6]).collect():
        c = r["context_limit"]
        assert r["truncated_tokens"] == sum(min(x, c) for x in n) and r["docs_over"] == sum(x > c for x in n)
    for r in lengths.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["length"] == n[max(0, -(-int(r["share"] * 1000) * len(n) // 1000) - 1)]
    assert lengths.histogram(lengths.encoded_lengths(documents(spark, ["x"]).limit(0))).count() == 0
