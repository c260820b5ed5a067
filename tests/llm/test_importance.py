"""Importance resampling against plain Python counts and a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import importance

from ..support import connect, rows
from .helpers import DOCUMENTS, awkward, prose


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, _, c in found:
        for f, n in c.items():
            s[bucket(f)] += n
    for text in target:
        for f, n in plain_features(text)[1].items():
            t[bucket(f)] += n
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for i, n_words, c in found:
        weight = sum(n * gain(bucket(f)) for f, n in c.items())
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, sum(c.values()), weight, score, None, n_words >= 20 and i is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCUMENTS).repartition(3)


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def got(spark, docs, target, **sizes):
    df = importance.resampled(frame(spark, docs).withColumns({"page": F.lit(1), "block": F.lit(2), "rank": F.lit(3)}), benchmark(spark, target), **sizes)
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_plain_counts(spark):
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.randrange(0, 90), 60)) for i in range(300)] + list(enumerate(awkward(), 1000)) + [(5, "Repeated row one Two"), (5, "Repeated row one Two"), (None, prose(rng, 40, 60)), (None, None)]
    target = [prose(rng, 50, 80), None, "", "Ünicode ß 10% A-b_c", *[prose(rng, 30, 30) for _ in range(5)]]
    # Small pages and parts: the same n-gram comes from many pages.
    assert got(spark, docs, target, page_bytes=2000, part_bytes=4000) == plain(docs, target)


def test_hot_pairs_ties_and_empty_tables(spark):
    rng = random.Random(8)
    hot = [(i, " ".join(f"of the n{rng.randrange(900)}" for _ in range(200))) for i in range(40)]
    assert got(spark, hot, ["of the n1"], page_bytes=5000) == plain(hot, ["of the n1"])
    same = [(7, "word " * 25)] * 60  # equal rows at the limit: as many as there is room for
    ranks = [r[4] for r in got(spark, same, ["word"])]
    assert sorted(r for r in ranks if r) == [1, 2, 3]
    assert got(spark, [], ["word"]) == [] and got(spark, [(1, "a b")], []) == plain([(1, "a b")], [])


def test_each_distinct_string_is_in_one_part_of_a_page(spark):
    page = importance.Page(["A b a b", None, "b, c"])
    assert page.words.to_pylist() == ["a", "b", "c"] and page.pairs(np.arange(3)).to_pylist() == ["a b", "b a", "b c"]
    assert page.sizes == (3, 3, 2) and page.counts().tolist() == [2, 3, 1, 2, 1, 1, 1, 1] and np.bincount(page.texts, minlength=3).tolist() == [9, 0, 3]
    rng = random.Random(1)
    page = importance.Page([" ".join(f"hot pair w{rng.randrange(600)}" for _ in range(900)), prose(rng, 3000, 90)])
    cuts = page.cuts(16)
    spread = np.diff(cuts.triple_at)
    for order, at, n in ((cuts.singles, cuts.single_at, page.sizes[0]), (cuts.stems[cuts.own], None, page.sizes[1]), (cuts.triples, cuts.triple_at, page.sizes[2])):
        assert sorted(order.tolist()) == list(range(n)) and (at is None or at[-1] == n)
    # The continuations of a frequent pair are spread, and each triple lies below its stem in its own part.
    assert spread.max() < 0.25 * spread.sum() and cuts.below.sum() == page.sizes[2]
    for p in range(16):
        _, stems, triples = cuts.part(p)
        assert np.repeat(cuts.stems[stems], cuts.below[stems]).tolist() == page.stem[cuts.triples[triples]].tolist()


def test_changed_documents_are_an_error(spark, tmp_path):
    texts = frame(spark, [(i, f"words of {i}") for i in range(9)])
    texts.write.parquet(str(tmp_path / "docs"))
    assert importance._from_files(spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text").filter("doc_id > 2"))
    assert not importance._from_files(texts) and not importance._from_files(spark.read.parquet(str(tmp_path / "docs")).distinct())
    names = [n for n, _, _ in importance._pages(iter([]), 10)]
    assert names == []
    rows_ = [{"block": "f:0", "id": i, "text": t} for i, t in enumerate(["aaaa", "bbbb", None, "c" * 30, ""])]
    import pyarrow as pa

    pages = list(importance._pages(iter([pa.RecordBatch.from_pylist(rows_[:2]), pa.RecordBatch.from_pylist(rows_[2:])]), 6))
    assert [ids for _, ids, _ in pages] == [[0, 1], [2, 3], [4]] and len({n for n, _, _ in pages}) == 3
    assert pages == list(importance._pages(iter([pa.RecordBatch.from_pylist(rows_)]), 6))


def test_the_draw_keeps_whole_rows(spark):
    rng = random.Random(9)
    docs = [(i, prose(rng, 30, 50)) for i in range(100)]
    drawn = importance.draw(frame(spark, docs).withColumn("score", F.lit("mine")), benchmark(spark, ["w1 w2"])).collect()
    assert all(r["score"] == "mine" and r["_score"] is not None for r in drawn)
    want = [r for r in plain(docs, ["w1 w2"]) if r[4]]
    assert sorted((r["doc_id"], r["rank"], r["text"]) for r in drawn) == sorted((r[0], r[4], dict(docs)[r[0]]) for r in want)


def test_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows(importance.op12(spark, folder).toPandas()) == rows(connect(folder).execute(importance.SQL).df())
    assert pytest.approx(0.05, abs=0.01) == importance.op12(spark, folder).filter("rank is not null").count() / 200
