import random

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.graph import components
from millrace.llm.textkit import shingle_sets

from .helpers import awkward, documents, prose, words


def shingles(text, n=4):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, percent=85, n=4):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def mutated(rng, text, share):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed):
    rng = random.Random(seed)
    out = awkward()
    for n in (3, 5, 8, 12, 25, 60, 150, 400):
        base = prose(rng, n, 300)
        out += [base, base + " end", base.upper()] + [mutated(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(4)]
    passage = prose(rng, 60)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(30)]
    chain = prose(rng, 300).split()
    out += [" ".join(chain[k : k + 200]) for k in range(0, 80, 4)]  # neighbours are linked, the ends are not
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 4000])
def test_components_equal_all_pairs(spark, block_bytes):
    texts = corpus(11)
    want, sizes = brute(texts)
    docs = documents(spark, texts, extra=True)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs, block_bytes=block_bytes).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    left = jaccard.one_of_each(docs.union(docs.where("doc_id < 9")))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(want))


def test_other_sizes_and_thresholds(spark):
    texts = corpus(13)
    for n, percent in ((5, 80), (3, 70)):
        want, sizes = brute(texts, percent, n)
        got = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(spark, texts), n, percent).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == sizes


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 60, 100, 333, 1000, 4000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            add = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                x, y = jaccard.part_keys([a, b], percent)
                assert len(np.intersect1d(x, y)), (n, drop, add)


def test_trie_overlaps():
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 1 << 62, 300, np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(1, 120)), replace=False)) for _ in range(120)]
    sets = list({s.tobytes(): s for s in sets}.values())
    trie = jaccard.Trie(sets, list(range(len(sets))))
    for s in [*sets[:30], pool[:50], np.array([1], np.uint64)]:
        for percent in (20, 50, 85):
            hit = {int(trie.ids[j]) for j in trie.probe(s, percent, np.ones(len(sets), bool))}
            want = {i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
            assert hit == want


@pytest.mark.parametrize("copies", [150])
def test_large_groups_of_near_copies(spark, copies):
    """Blocks of many sub-blocks: near copies of one text, drifting versions, and both with strangers among them."""
    rng = random.Random(21)
    base, drift = prose(rng, 120, 10**5), prose(rng, 120, 10**5).split()
    texts = [mutated(rng, base, 0.012) for _ in range(copies)]
    for _ in range(copies):
        drift[rng.randrange(len(drift))] = f"d{rng.randrange(10**6)}"
        texts.append(" ".join(drift))
    rng.shuffle(texts)
    want, _ = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(spark, texts), block_bytes=6000).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < copies


def test_different_texts_of_one_id(spark):
    rng = random.Random(22)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (5, a + " x"), (0, b + " y"), (7, c), (7, c), (7, c.upper()), (7, None), (9, ""), (None, c), (3, b)]
    docs = spark.createDataFrame([(*r, "k", "k", i) for i, r in enumerate(rows)], "doc_id long, text string, _gone string, _hash string, row int")
    got = {r["row"]: r["component_id"] for r in jaccard.near_duplicates(docs).join(docs, "doc_id").select("row", "component_id").collect()}
    assert got[2] == 1 and got[3] == 0 and got[10] == 0
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    kept = {r["row"] for r in left.collect()}
    assert kept - {4, 5, 6} == {0, 3, 7, 8, 9} and len(kept & {4, 5, 6}) == 1


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, None), (7, "a b c d e")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 0, 3), (7, 2, 3)], key=str)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_copies_without_an_id_hide_no_link(spark):
    a = prose(random.Random(31), 90)
    docs = spark.createDataFrame([(None, a), (4, a), (2, a + " x"), (None, a + " x")], "doc_id long, text string").coalesce(1)
    assert sorted(str(r["component_id"]) for r in jaccard.near_duplicates(docs).collect()) == ["2", "2", "None", "None"]


def test_graph_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains_end(spark, shuffled):
    ids = list(range(5, 605))
    if shuffled:
        random.Random(3).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(10_000, 10_000 + i) for i in range(1, 200)] + [(20_200, 20_000 + i) for i in range(200)]  # hubs of the smallest and of the largest id
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: 5 if x < 1000 else 10_000 if x < 20_000 else 20_000 for e in edges for x in e}


def test_chain_of_shifted_windows(spark):
    w = prose(random.Random(12), 200 + 15 * 119, 10**6).split()
    texts = [" ".join(w[15 * i : 15 * i + 200]) for i in range(120)]
    assert {r["component_id"] for r in jaccard.near_duplicates(documents(spark, texts)).collect()} == {0}


def test_shingle_kernel():
    texts = corpus(2)
    sets = shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_keys_are_joined_in_their_task_first(spark):
    rng = np.random.default_rng(2)
    keys, nodes = rng.integers(0, 40, 500), rng.integers(-5, 60, 500)
    key, node, head = jaccard.local_heads(keys, nodes)

    def classes(edges):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in list(root) if find(y) == find(x)) for x in list(root)}

    first = dict(zip(key[: len(np.unique(keys))].tolist(), head.tolist(), strict=False))
    assert classes([(int(n), first[int(k)]) for k, n in zip(keys, nodes, strict=True)]) == classes([(n, h) for n, h in zip(node.tolist(), head.tolist(), strict=True)])
    assert all(first[k] == nodes[keys == k].min() for k in np.unique(keys).tolist())
    assert [len(x) for x in jaccard.local_heads(keys[:0], nodes[:0])] == [0, 0, 0]


def test_a_large_group_of_near_copies_costs_a_key_a_task(spark):
    """Thousands of different texts that share nearly all keys: what a key's task reads is a row per task."""
    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.range(6000).selectExpr("id as doc_id", f"concat('{base} tail', id) as text").repartition(5)
    sketch = jaccard.staged(jaccard.sketches(docs), "test-sketch")
    members = jaccard.block_members(sketch)
    assert members.select("block").distinct().count() == 1 and members.count() == 6000
    got = jaccard.near_duplicates(docs)
    assert got.filter("component_id <> 0").count() == 0 and got.count() == 6000
