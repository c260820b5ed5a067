"""Line dedup: the filters against sets, the index against plain counts, insertions and deletions against fresh indexes."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import linededup
from millrace.llm.cuckoo import CuckooFilters

from ..support import connect, rows
from .helpers import DOCUMENTS, awkward, documents


def keys(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, n)


def test_filters_hold_delete_and_grow():
    f = CuckooFilters(1024)
    a = keys(9000)  # more than two filters hold
    f.insert(*a)
    assert f.contains(*a).all() and len(f) == 9000 and len(f.tables) >= 3
    assert f.contains(*keys(20_000, 1)).mean() < 0.01
    f = CuckooFilters(1024, f.to_bytes())
    f.delete(a[0][:5000], a[1][:5000])
    assert f.contains(a[0][5000:], a[1][5000:]).all() and len(f) == 4000
    f.delete(a[0][5000:], a[1][5000:])
    assert len(f) == 0 and f.to_bytes() == b"" and not f.contains(*a).any()
    with pytest.raises(KeyError):
        f.delete(a[0][:1], a[1][:1])
    with pytest.raises(ValueError):
        CuckooFilters(1000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=60))
def test_filters_with_colliding_fingerprints(steps):
    """Few buckets and fingerprints: copies of a fingerprint stay apart."""
    f, held = CuckooFilters(4), []
    for add, x in steps:
        k = (np.array([x % 8]), np.array([x % 3 + 1]))
        if add:
            f.insert(*k)
            held.append(x)
        elif x in held:
            f.delete(*k)
            held.remove(x)
        assert len(f) == len(held) and all(f.contains(np.array([y % 8]), np.array([y % 3 + 1]))[0] for y in held)


def test_suspects_are_what_came_twice():
    k1, k2 = keys(50_000)
    k1[100:200], k2[100:200] = k1[:100], k2[:100]
    n = np.ones(50_000, np.int64)
    n[300:310] = 2
    f = CuckooFilters(1 << 14)
    old = keys(50, 5)
    f.insert(*old)
    k1[400:450], k2[400:450] = old
    a, b, missing = linededup.pass_filter(f, k1, k2, n)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(int(k1[i]), int(k2[i])) for i in [*range(100), *range(300, 310)]} <= found and len(found) < 400
    never = {(x, y) for x, y, m in zip(a.tolist(), b.tolist(), missing, strict=True) if m}
    assert set(zip(*map(np.ndarray.tolist, old), strict=True)) <= never and not never & {(int(k1[i]), int(k2[i])) for i in range(100)}


def key_of(line):
    k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), k)


def plain(docs):
    """Per row (doc_id, n_lines, n_dropped, kept text)."""
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= 20:
                held.setdefault(key_of(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if i is None or len(held.get(key_of(x), ())) < 3 or max(held[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def corpus(rng, n, start=0):
    pool = [" ".join(rng.choice(["alpha", "Beta", "gämma", "δelta", "ε", "zz"]) for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    dress = lambda s: rng.choice(["", " ", "\t", "\x0b"]) + rng.choice([s, s.upper(), s.lower()]) + rng.choice(["", "  ", "\r"])
    return [(start + i, "\n".join(dress(rng.choice(pool)) if rng.random() < 0.7 else f"own line number {start + i} {j} of this text" for j in range(rng.randrange(0, 12)))) for i in range(n)]


def report(df, **rule):
    return sorted((tuple(r) for r in linededup.line_report(df, **rule).collect()), key=str)


def want(docs):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(docs)), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCUMENTS).repartition(3)


def test_equals_plain_counts(spark):
    rng = random.Random(3)
    docs = corpus(rng, 150) + list(enumerate(awkward(), 500)) + [(3, "a line that is repeated\n" * 4), (3, None), (None, "a line that is repeated"), (901, "a line that is repeated"), (902, "x\nA LINE that is repeated \n")]
    docs += [(1000 + i, "\n".join(f"shared line {j} in all of these" for j in range(400))) for i in range(4)]
    df = frame(spark, docs)
    assert report(df) == want(docs)
    clash = df.selectExpr("*", "1 as _doc", "2 as _keys", "3 as _kept", "4 as shard")
    got = linededup.drop_lines(clash)
    assert got.columns == clash.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == sorted(((i, t) for i, _, _, t in plain(docs)), key=str)
    assert report(documents(spark, [])) == []
    assert report(documents(spark, [None, "", "one"])) == want(list(enumerate([None, "", "one"])))


def test_insertions_and_deletions_are_reversible(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKETS", 64)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 100)
    rng = random.Random(4)
    parts = [corpus(rng, 60, 1000 * k) for k in range(3)]
    index = linededup.LineIndex(spark, str(tmp_path / "lines"))

    def state(*included):
        docs = [d for k in included for d in parts[k]]
        assert report(frame(spark, docs), index=index) == want(docs)
        live = index.pairs(index.refs()).select("k1", "k2").distinct().toPandas()
        assert len(live) == len({key_of(x) for _, t in docs for x in t.split("\n") if len(key_of(x)) >= 20})
        slots = 0
        for r in index.filters().collect():
            chain = linededup.CuckooFilters(64, bytes(r["tables"]))
            mine = live[(live["k1"].to_numpy() >> 32) % index.shards == r["shard"]]
            assert chain.contains(mine["k1"].to_numpy(), mine["k2"].to_numpy()).all()
            slots += len(chain)
        assert slots == len(live)  # one fingerprint for each key with references

    index.insert(frame(spark, parts[0]))
    state(0)
    index.insert(frame(spark, parts[1]))
    state(0, 1)
    index = linededup.LineIndex(spark, str(tmp_path / "lines"))  # goes on with the last version
    index.delete(frame(spark, parts[1] + [(77_777, "unknown")]))
    state(0)
    index.insert(frame(spark, parts[2]))
    index.insert(frame(spark, parts[1]))
    state(0, 1, 2)
    index.delete(frame(spark, [d for p in parts for d in p]))
    assert index.common()[0].count() == 0 and sum(len(r["tables"]) for r in index.filters().collect()) == 0


def test_a_hot_line_is_a_row_a_task(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same notice stands in every text' as text").repartition(6)
    refs = linededup.references(docs)
    assert linededup._gathered(refs).count() <= 6 and linededup.LineIndex.pairs(refs).count() == 3000
    got = linededup.line_report(docs)
    assert got.filter("n_dropped = 1").count() == 2999 and got.filter("n_dropped = 0").first()["doc_id"] == 2999


def test_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows(linededup.op11(spark, folder).toPandas()) == rows(connect(folder).execute(linededup.SQL).df())
