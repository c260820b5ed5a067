"""Toxicity, nearest neighbours, mixing, WARC, chat and the pipeline."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import ann, chat, mixing, packing, pii, quality, toxicity, warc

from ..support import rows
from .helpers import awkward, documents, prose
from .test_jaccard import brute


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    return c.execute(sql).df()


# -- toxicity ------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_maximal_segments(scores):
    """Against the definition: the best segment, then the same left and right of it."""

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*split(a, i), (i, j, best[0]), *split(j, b)]

    assert sorted(toxicity.maximal_segments([float(s) for s in scores])) == sorted((i, j, float(s)) for i, j, s in split(0, len(scores)))


def test_toxicity_learns_and_is_blind(spark):
    rng = random.Random(6)
    bad = [f"slur{i}" for i in range(8)]
    texts, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(20, 200)).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    extra = awkward()
    docs = documents(spark, texts + extra)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs, lab))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    assert len(got) == len(texts) + len(extra)
    for i in range(len(texts)):
        assert got[i]["held"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in range(len(texts)) if got[i]["held"]]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    for i in range(len(texts), len(got)):
        assert got[i]["predicted"] == 0 and 0 <= got[i]["score"] <= 1
    found = [i for i in held if labels[i][1] and got[i]["passages"]]
    assert found and all(any(b in texts[i][p["start"] : p["end"]] for p in got[i]["passages"] for b in bad) for i in found)
    # Held-out labels play no part.
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.training_sample(docs, flipped).collect()) == sorted(toxicity.training_sample(docs, lab).collect())
    none = toxicity.fit(toxicity.training_sample(docs, lab.limit(0)))
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_log_odds_and_significance(spark):
    rows_ = [(0, "a", 50, 1), (0, "b", 0, 9), (0, "c", 5, 5), (0, "d", 3, 0), (3, "abc", 7, 2), (3, "x", 0, 1)]
    totals = {0: (58.0, 15.0), 3: (7.0, 3.0)}
    ratio, z = toxicity.log_odds(totals, prior=10.0)
    for r in spark.createDataFrame(rows_, "kind int, token string, clean long, toxic long").select("*", ratio.alias("ratio"), z.alias("z")).collect():
        nc, nt = totals[r["kind"]]
        share = (r["clean"] + r["toxic"]) / (nc + nt)
        t, c = r["toxic"] + 10 * share, r["clean"] + 10 * share
        assert r["ratio"] == pytest.approx(math.log(t / (nt + 10 - t)) - math.log(c / (nc + 10 - c)))
        g = 2 * sum(y * math.log(y / (share * n)) for y, n in ((r["toxic"], nt), (r["clean"], nc)) if y)
        assert r["z"] == pytest.approx(math.copysign(math.sqrt(max(g, 0)), r["ratio"]))


def test_extreme_values_are_fitted():
    rng = np.random.default_rng(3)
    lam, k = 0.7, 0.02
    sizes = rng.integers(50, 2000, 20_000).astype(float)
    best = np.log(k * sizes / rng.exponential(size=len(sizes))) / lam  # the law itself
    got = toxicity.fit_extremes(np.where(best >= 2.0, best, 0.0), sizes, 2.0)
    assert got[0] == pytest.approx(lam, rel=0.06) and got[1] == pytest.approx(k, rel=0.25)
    none = toxicity.fit_extremes(np.zeros(100), np.full(100, 300.0), 2.0)
    assert none[1] * 300 * math.exp(-none[0] * 2.0) < 0.05


def test_evidence_equals_the_definition():
    rng = random.Random(4)
    model = toxicity.Model({"bad": 3.0, "worse": 5.0, "fine": -2.0}, {"awf": 2.0, "awful": 4.0}, frozenset({"awfis"}), drift=-0.3, lam=0.9, k=0.01, slope=2.0, base=-3.0)
    for _ in range(300):
        found = [rng.choice(["x", "y", "bad", "worse", "fine", "awfully", "awfxx", "awfis", "aw"]) if rng.random() < 0.4 else "w" for _ in range(rng.randrange(0, 40))]
        scores = [model.words.get(w, 4.0 if w == "awfully" else 2.0 if w == "awfxx" else model.drift) for w in found]

        def best(a, b):
            out = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if out[0] <= 1e-12 else [*best(a, out[3]), out, *best(out[4], b)]

        parts = [(s, i, j) for s, _, _, i, j in best(0, len(found))]
        want = [(i, j, s) for s, i, j in parts if 0.01 * len(found) * math.exp(-0.9 * s) <= toxicity.E_VALUE]
        got = [(a, b, s) for a, b, s, _ in model.passages(found)]
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
        evidence = math.log1p(sum(-math.log10(0.01 * len(found) * math.exp(-0.9 * s)) for *_, s in want))
        assert model.evidence(found) == pytest.approx(evidence) and model.score(evidence) == pytest.approx(1 / (1 + math.exp(3.0 - 2.0 * evidence)))


def test_sample_is_fixed_and_copies_teach_once(spark):
    rng = random.Random(9)
    base, shared = prose(rng, 80, 10**5), prose(rng, 30, 10**5)
    texts = [base.replace(" ", f" u{i} ", 1) for i in range(40)] + [prose(rng, 60, 10**5) + " " + shared for _ in range(60)] + [base] * 10
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    docs = documents(spark, texts)
    one = toxicity.training_sample(docs, labels)
    again = toxicity.training_sample(docs.repartition(7, "text"), labels.repartition(2, "toxic"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    copies = [r for r in one.collect() if base[20:60] in r["text"]]
    assert sorted(r["toxic"] for r in copies) == [0, 1], "near copies once in each class"
    assert one.count() - len(copies) >= 0.9 * sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40, 100)), "a shared passage makes no copy"
    a, b = toxicity.fit(one), toxicity.fit(again)
    assert vars(a) == vars(b)
    both = toxicity.training_sample(docs, labels.union(labels.selectExpr("doc_id", "1 - toxic")).where("doc_id < 60 or doc_id = 5000"))
    assert both.count() == 0, "labelled both ways"


# -- nearest neighbours --------------------------------------------------------------------------------


def vectors(spark, rows_):
    return spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").repartition(4)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 48))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 48))).astype(np.float32)
    x[100:400] = x[100]  # a third of ties
    rows_ = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5001, [0.0] * 48, 0), (5100, [1.0] * 7, 0), (5200, [float("nan")] * 48, 0), (5300, [None] * 48, 0), (5400, [float("inf")] + [0.0] * 47, 0), (None, [1.0] * 48, 0), (100, x[100].tolist(), 0)]
    got = ann.nearest(vectors(spark, rows_ + odd), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1500, 100))
    full, hit = x.astype(float), 0
    for q, found in by.items():
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hit += len({i for i, _ in found} & set(order))
        assert len(found) == 10 and all(s == d[i] for i, s in found)
        assert [s for _, s in found] == sorted(s for _, s in found)
    assert hit >= 0.95 * 10 * len(by)
    assert by[100][0] == (101, 0.0), "ties go to the smaller id"


@pytest.mark.parametrize("rows_a_centre, shift", [(10, 0.0), (100, 0.0), (10, 1e4)])
def test_coarse_centres_lose_nothing(spark, rows_a_centre, shift):
    rng = np.random.default_rng(8)
    groups = rng.standard_normal((9, 32)) * 4
    x = groups[rng.integers(0, 9, 1200)] + 0.2 * rng.standard_normal((1200, 32)) + shift
    x[600:640] = x[600]
    rows_ = [(i % 1100, v.tolist(), 0) for i, v in enumerate(x)]  # a hundred ids twice
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int").repartition(3)
    hit, got = 0, {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, rows_a_centre=rows_a_centre).collect():
        got.setdefault(r["query_id"], set()).add((r["vec_id"], r["score"]))
    first = {i % 1100: i for i in reversed(range(1200))}
    for q, found in got.items():
        own = [i for i in (q, q + 1100) if i < 1200]
        best = {}
        for i in range(1200):
            if i % 1100 != q:
                best[i % 1100] = min(best.get(i % 1100, np.inf), min(float(np.sqrt(((x[i] - x[o]) ** 2).sum())) for o in own))
        assert len(found) == 10 and first
        kth = sorted(best.values())[9]
        hit += sum(s <= kth * (1 + 1e-9) for _, s in found) if len(own) == 1 else 10
    assert hit >= 0.97 * 10 * len(got)


def test_runs_of_far_rows_are_left_out():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((300, 16)), 100 + rng.standard_normal((300, 16))])
    c, p = x.mean(0), ann.rotation(16)
    centres = np.stack([x[:300].mean(0), x[300:].mean(0)])
    cluster = np.repeat([0, 1], 300)
    reach = np.sqrt(((x - centres[cluster]) ** 2).sum(1))
    q = ann.Queries(np.arange(5), x[:5], c, p)
    met = []
    bounds = q.bounds
    q.bounds = lambda codes, norm, inner, part: met.append(len(codes) * len(part)) or bounds(codes, norm, inner, part)
    limits = ann.first_limits(q.ids, q.x, np.arange(600), x, 10)
    got = ann.search_block(q, [(np.arange(600), x, *ann.encode(x, c, p), cluster, reach)], limits=limits, centres=centres)
    assert sum(met) == 300 * 5, "the far group is never compared"
    for i, (d, ids) in enumerate(got):
        exact = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert len(set(ids.tolist()) & set(np.argsort(exact)[1:11].tolist())) >= 9 and (limits[i] >= np.sort(exact)[10])


def test_bounds_prune_and_hold(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 128))
    c, p = x.mean(0), ann.rotation(128)
    codes, norm, inner = ann.encode(x, c, p)
    q = ann.Queries(np.arange(50), x[:50], c, p)
    estimate, lower = q.bounds(codes, norm, inner, slice(0, 50))
    exact = ((x[:50, None] - x[None]) ** 2).sum(2)
    assert (lower <= exact + 1e-9).mean() > 0.98
    assert np.corrcoef(estimate.ravel(), exact.ravel())[0, 1] > 0.8


def test_repeated_ids_prune_nothing():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 64))
    x[1:61] = x[0] + 1e-3 * rng.standard_normal((60, 64))
    ids = np.array([0] + [1] * 60 + list(range(2, 141)))
    c, p = x.mean(0), ann.rotation(64)
    ((_, got),) = ann.search_block(ann.Queries(ids[:1], x[:1], c, p), [(ids, x, *ann.encode(x, c, p))])
    far = np.sqrt(((x[61:] - x[0]) ** 2).sum(1))
    assert got.tolist() == [1, *(2 + np.argsort(far)[:9]).tolist()]


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])
    got = ann.nearest(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (1, math.sqrt(2))]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
    many = vectors(spark, [(i, [float(i), 1.0], 0) for i in range(60)])
    blocks = ann.nearest(many, F.col("vec_id") % 2 == 0, k=3, block=8).collect()
    assert len(blocks) == 90 and all(r["score"] in (1.0, 2.0, 3.0) for r in blocks)


# -- mixing --------------------------------------------------------------------------------------------


def fill(sizes, weights, share=1.5, most=2):
    """Targets by repeated resharing."""
    goal, target, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        level = goal / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            goal -= target[i]
            open_.remove(i)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "😀", "ﬁ"][: 3 + seed * 2]
    texts, sources = [], []
    for name in names:
        for _ in range(rng.choice([1, 5, 60, 200])):
            texts.append(prose(rng, rng.randrange(0, 80)) if rng.random() < 0.95 else None)
            sources.append(name)
    docs = documents(spark, texts, sources, extra=True)
    got = mixing.mix_plan(docs).collect()
    order = sorted({s for s in sources if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in order}
    want = dict(zip(order, fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == size[s] and r["size"] == len((texts[r["doc_id"]] or "").split())
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in order:
        rate = want[s] / size[s] if size[s] else 0
        sigma = math.sqrt(sum(len((t or "").split()) ** 2 for t, x in zip(texts, sources, strict=True) if x == s) * (rate % 1) * (1 - rate % 1))
        assert abs(taken[s] - want[s]) <= 4.5 * sigma + 1
    assert rows(mixing.mix_plan(docs).toPandas()) == rows(duck(mixing.SQL, documents=docs))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(copies.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mix_draws_repeated_and_nameless_rows_each(spark):
    rows_ = [(None, f"text {i} " + "x " * 8, "a") for i in range(600)] + [(7, "same words " * 5, "b")] * 500 + [(8, f"c {i % 3}", "c") for i in range(90)]
    docs = spark.createDataFrame([(*r, "z", "q", i % 2) for i, r in enumerate(rows_)], "doc_id long, text string, source string, _s string, _rate string, _size int").repartition(3)
    plan = mixing.mix_plan(docs)
    assert rows(plan.toPandas()) == rows(duck(mixing.SQL, documents=docs))
    for r in plan.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.12 * r["target"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = lambda df: sorted((str(r["doc_id"]), r["text"], r["n"]) for r in df.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect())
    assert count(mixed) == count(mixing.mix(docs.repartition(5, "_size"))), "reruns agree"
    assert mixed.count() * 10 > 0 and {r["_s"] for r in mixed.select("_s").distinct().collect()} == {"z"}


# -- WARC ----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "short", "short", "long " * 40, "long " * 40, "\r\n\r\nWARC/1.1\r\n" * 10, "é" * 60, "é" * 60, "x" * 99, "x" * 99, "y" * 100, "y" * 100]
    pages = spark.createDataFrame([(i + 3, f"http://h/{i}" if i else None, t, 1) for i, t in enumerate(html)] + [(7, "again\r\nWARC-Type: x", "long " * 40, 1)], "page_id long, url string, html string, digest int").repartition(4)
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    assert spark.read.parquet(path + "/payloads").count() == len({t or "" for t in html})
    back = {(r["page_id"], i): r for i, r in enumerate(warc.read_archive(spark, path).collect())}
    assert len(back) == len(html) + 1
    for (page, _), r in back.items():
        text = (html[page - 3] or "").encode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert bytes(r["payload"]) == text and r["payload_digest"] == hashlib.sha256(text).hexdigest() and r["payload_bytes"] == len(text)
        assert rest == (b"" if r["record_type"] == "revisit" else text) + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        firsts = [i + 3 for i, t in enumerate(html) if (t or "").encode() == text]
        revisit = len(text) >= 100 and page != min(firsts)
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (min(firsts) if revisit else None)
    warc.write_warc_files(warc.read_archive(spark, path), str(tmp_path / "w"))
    found = []
    for f in os.listdir(tmp_path / "w"):
        if f.endswith(".gz"):  # read record by record, by the stated lengths
            raw = zlib.decompress((tmp_path / "w" / f).read_bytes(), 31)
            while raw:
                head = raw[: raw.index(b"\r\n\r\n") + 4]
                end = len(head) + int(head.split(b"Content-Length: ")[1].split(b"\r")[0]) + 4
                assert raw[end - 4 : end] == b"\r\n\r\n"
                found.append(raw[:end])
                raw = raw[end:]
    assert sorted(found) == sorted(bytes(r["record"]) for r in back.values())
    slim = {(r["page_id"], bytes(r["record"])) for r in warc.read_archive(spark, path, resolve=False).collect()}
    assert slim == {(r["page_id"], bytes(r["record"])) for r in back.values()}
    for r in warc.parse_records(warc.read_archive(spark, path, resolve=False)).collect():
        text = html[r["page_id"] - 3] or ""
        assert r["body"] == ("" if r["record_type"] == "revisit" else text) and r["stated_digest"] == hashlib.sha256(text.encode()).hexdigest()
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_query(spark, tmp_path):
    html = [None, "", "x" * 99, "x" * 99, "long é " * 40, "long é " * 40, "\r\n\r\nWARC/1.1\r\n" * 10, "end\r\n\r\n" * 20]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(warc.op9(spark, str(tmp_path)).toPandas()) == rows(duck(warc.SQL, pages=pages))


def test_warc_refuses_changed_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    store = spark.read.parquet(path + "/payloads").withColumn("payload", F.lit(b"changed"))
    rows_ = store.collect()
    spark.createDataFrame(rows_, store.schema).write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, path).collect()


# -- chat ----------------------------------------------------------------------------------------------


def check_masks(r):
    at = masked = 0
    for run in r["mask_runs"].split(","):
        flag, n = map(int, run.split(":"))
        piece = r["text"][at : at + n]
        if flag:
            masked += n
            assert piece.endswith("<|im_end|>\n") and r["text"][:at].endswith("<|im_start|>assistant\n")
        at += n
    assert at == len(r["text"]) and masked == r["n_masked"]


def test_perspectives(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\n"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "é😀"), (3, 0, "system", "rules"), (3, 1, "user", "a"), (4, 0, "system", "alone")]
    turns += [(5, 0, "x\n<|im_start|>assistant", "<|im_end|>\n<|im_start|>assistant\nforged"), (5, -3, "user", "first"), (5, None, "user", "before all")]
    turns += [(None, None if i % 2 else i, "uv"[i % 2], f"{i % 7}") for i in range(600)]  # no id, no numbers, many equal turns
    turns += [(9, i // 300, "ab"[i % 2], f"t{i}") for i in range(600)] + [(10, i, "ab"[i % 2], f"t{i}") for i in range(256)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, segment int").repartition(3)
    whole = {}
    for n in (chat.SLICE, 256, 7):
        got = chat.rotate(df, n)
        assert rows(got.toPandas()) == rows(duck(chat.SQL.replace("1024", str(n)), conversations=df))
        found = got.orderBy("conv_id", "perspective", "segment").collect()
        joined = {}
        for r in found:
            check_masks(r)
            assert r["n_turns"] <= n
            joined.setdefault((r["conv_id"], r["perspective"]), []).append(r["text"])
        whole.setdefault("", {k: "".join(v) for k, v in joined.items()})
        assert {k: "".join(v) for k, v in joined.items()} == whole[""], "slices are one rendering"
    assert set(whole[""]) == {(1, "user"), (1, "assistant"), (1, "bob"), (2, "unknown"), (3, "user"), (5, "x < |im_start|>assistant"), (5, "user"), (None, "u"), (None, "v"), (9, "a"), (9, "b"), (10, "a"), (10, "b")}
    assert whole[""][(3, "user")] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert whole[""][(5, "user")].count("<|im_start|>assistant") == 2 and "before all" in whole[""][(5, "user")][:40]
    assert chat.rotate(df.limit(0)).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    texts = awkward() + base + [b + " x" for b in base[:20]] + [b + " mail a@b.org" for b in base[20:30]] + base[:5]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    seen = []
    for name, stage in cp.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append((name, at.collect()))
    good = [i for i, t in enumerate(texts) if (s := quality.base_stats(t))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert {r["doc_id"] for r in seen[0][1]} <= set(good)
    left = sorted(r["doc_id"] for r in seen[0][1])
    roots, _ = brute([texts[i] for i in left], 80, 5)
    one = {left[i] for i in roots}
    assert sorted(r["doc_id"] for r in seen[1][1]) == sorted(one)
    assert all(r["text"] == pii.masked(texts[r["doc_id"]], pii.spans_of(texts[r["doc_id"]])) for r in seen[2][1])
    assert {r["doc_id"] for r in seen[3][1]} <= one
    tokens = sum(r["length"] for r in seen[4][1])
    want = sum(r["length"] for r in packing.pieces(spark.createDataFrame([tuple(r) for r in seen[3][1]], docs.schema)).collect())
    assert tokens == want
    assert all(set(r.asDict()) == set(docs.columns) for _, rows_ in seen[:4] for r in rows_[:1])
    assert rows(cp.run(spark, str(tmp_path)).toPandas()[["doc_id", "piece", "length", "ids_crc32"]]) == rows(spark.createDataFrame(seen[4][1]).toPandas()[["doc_id", "piece", "length", "ids_crc32"]])
