"""Operator 8, exact n-gram Jaccard join with a prefix tree.

Documents are sets of distinct 4-word shingles (64-bit hashes).  The join has three steps.

1.  Equal sets are one class (128-bit digest), so copies never meet each other.
2.  Blocks.  For a pair at or above the threshold the symmetric difference is at most ``D`` elements; if the
    elements are dealt by hash into more than ``D`` parts, at least one part is equal in both sets.  Every
    class therefore emits a key per part, within one or two levels of similar size, and classes that share a key
    are connected into blocks of a level.  Every link lies in a block.  Almost all keys occur once, so blocks
    are near copies and little else; shared passages don't make them, nor do chains through other sizes.
3.  Prefix tree.  A block's sets are stored in a trie, ordered globally by how many of them hold an element;
    a probe adds up its partial overlaps along the trie's nodes, shared by all sets below a node, and leaves
    subtrees whose remaining length can't reach the needed overlap.  A tile returns the links of a spanning
    forest, not all pairs.  Blocks above ``BLOCK_BYTES`` are dealt into sub-blocks, each a tile of its own that
    also gets a few pivots, sets that all sub-blocks of the block share.  Near copies of one text all reach a
    pivot then, so the block is one component after a pass whose volume is that of the block.  Only sets
    outside their block's largest component meet the other sub-blocks, in a second pass: two sets in it are
    connected, so no link of it can matter, and every other pair is tested in one of the passes.

Connected components over the links give each document the smallest doc_id that it reaches.

Defined cases: null and empty texts have no shingles and are linked with nothing; fewer than 4 words are one
shingle; rows that repeat are one class; doc_id is read as a long; rows without one (or whose id is no number) have
no component; different texts that share a
doc_id are different classes; an empty table gives no rows; other columns, whatever their names, are ignored by
:func:`near_duplicates` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .runtime import fresh, map_batches, release_memory, sized, staged
from .textkit import shingle_sets, splitmix

#: Words of a shingle, and the threshold in percent.
N, PERCENT = 4, 85
#: Bytes of a block's (or sub-block's) sets that one task holds.
BLOCK_BYTES = 4 << 20
#: Sets of a block that all its sub-blocks share.
PIVOTS = 4
#: Digests that a task remembers to emit the keys of a text that it has met before only once.
SEEN = 500_000
#: Keys that a task joins among themselves at once.
TASK_KEYS = 1 << 21

#: Low bits of a key that hold its size class.
LEVEL_MASK = 127


def size_bounds(percent: int = PERCENT, top: int = 1 << 36) -> list[int]:
    """Lower bounds of the size classes; sets too small to differ and still be linked come before the first."""
    first = -(-percent // (100 - percent))  # below, one element of difference is too much
    out = [max(first, 1)]
    while out[-1] < top:
        out.append(out[-1] * 5 // 4 + 1)
    return out


def _parts(upper: int, percent: int) -> int:
    """Parts of a level of sets below ``upper`` elements: a third more than the largest difference of a linked pair."""
    differ = (100 - percent) * 2 * (upper - 1) // (100 + percent)
    return differ + differ * 3 // 10 + 4


def part_keys(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """The keys of each set.  Two sets at or above the threshold that are not equal share at least one.

    A set emits in its own size class, and in the next one if a partner there is possible.  Parts of one element
    or none are weak: unrelated texts share them.  An equal part is weak in both sets, so a set whose weak parts
    are fewer than the parts that any partner must share leaves them out; a set with more emits all its parts.
    """
    bounds = size_bounds(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    home = np.searchsorted(bounds, sizes, "right") - 1
    largest = sizes * 100 // percent
    for step in (0, 1):
        level = home + step
        chosen = np.flatnonzero((home >= 0) if step == 0 else (largest >= np.array(bounds)[np.clip(level, 0, len(bounds) - 1)]) & (level >= 0))
        if not len(chosen):
            continue
        rules = {int(c): _parts(bounds[int(c) + 1], percent) for c in np.unique(level[chosen])}
        parts = np.array([rules[int(level[i])] for i in chosen], np.int64)
        # The largest difference of each set to any partner that it may be linked with at this level.
        partner = np.minimum(np.array(bounds)[level[chosen] + 1] - 1, largest[chosen])
        differ = (100 - percent) * (sizes[chosen] + partner) // (100 + percent)
        start = np.concatenate([[0], np.cumsum(parts)])
        flat = np.concatenate([sets[i] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
        mixed = splitmix(flat ^ np.uint64(0x5851F42D4C957F2D))
        part = start[owner] + (mixed >> np.uint64(16)).astype(np.int64) % parts[owner]
        sums = np.zeros(start[-1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, part, splitmix(mixed + np.uint64(1)))
            index = np.arange(start[-1]) - np.repeat(start[:-1], parts)
            seed = (np.repeat(level[chosen], parts).astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64)
            keys = splitmix(sums + splitmix(seed + np.uint64(0xA0761D6478BD642F)))
            keys = (keys & ~np.uint64(LEVEL_MASK)) | np.repeat(level[chosen], parts).astype(np.uint64)
        strong = np.bincount(part, minlength=start[-1]) > 1
        for k, i in enumerate(chosen):
            mine = slice(start[k], start[k + 1])
            weak = parts[k] - int(strong[mine].sum())
            out[i].append(keys[mine] if weak >= parts[k] - differ[k] else keys[mine][strong[mine]])
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, hash of the text as it stands, n_shingles, digest (null for empty sets), the set's keys and
    their levels.  Of equal sets that a task meets, the first one has keys and levels, so a text that is copied
    any number of times costs its keys once a task."""

    def make():
        seen: set[bytes] = set()

        def run(cols):
            sets = shingle_sets(cols["text"], n)
            digests = [digest(s) if len(s) else None for s in sets]
            new = []
            for d in digests:
                new.append(d is not None and d not in seen)
                if new[-1]:
                    seen.add(d)
            if len(seen) > SEEN:
                seen.clear()
            keys = part_keys([s if fresh_ else s[:0] for s, fresh_ in zip(sets, new, strict=True)], percent)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            return {
                "doc_id": cols["doc_id"], "_hash": cols["_hash"], "n_shingles": [len(s) for s in sets], "digest": digests, "levels": [np.unique(k & np.uint64(LEVEL_MASK)).astype(np.int32).tolist() if ok else None for k, ok in zip(keys, new, strict=True)],
                "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64))),
            }

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_hash"), "text"), make, "doc_id long, _hash long, n_shingles long, digest binary, levels array<int>, keys array<long>")


class Trie:
    """Sets of 64-bit elements as a prefix tree over one global order, probed with vectorised partial overlaps.

    Sets are sorted by their ordered elements; a node (element, depth) covers the contiguous range of sets that
    begin with its path.  Nodes are kept in layers of depths that double in width, and a probe goes layer by
    layer: the overlap of every set still alive grows by the nodes above it, each counted once for its whole
    range, and ranges in which overlap plus remaining length stays below the needed overlap are pruned.
    """

    def __init__(self, sets: list[np.ndarray], ids: list[int]):
        everything, counts = np.unique(np.concatenate(sets), return_counts=True)
        # Most frequent first, so that near copies share long paths.
        rank = np.empty(len(everything), np.int64)
        rank[np.lexsort((everything, -counts))] = np.arange(len(everything))
        ranked = [np.sort(rank[np.searchsorted(everything, s)]) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i8").tobytes())
        self.elements, self.rank = everything, rank
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.sizes = np.array([len(sets[i]) for i in order], np.int64)
        rows = [ranked[i] for i in order]
        nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # depth, element, first set
        shared = 0
        for i, row in enumerate(rows):
            if i:
                before = rows[i - 1]
                m = min(len(before), len(row))
                differ = np.flatnonzero(before[:m] != row[:m])
                shared = int(differ[0]) if len(differ) else m
            depth = np.arange(shared, len(row))
            nodes.append((depth, row[shared:], np.full(len(depth), i)))
        depth, element, first = (np.concatenate(x) for x in zip(*nodes, strict=True))
        # A node's range ends at the next set that leaves its path: the next node at its depth or above.
        last = np.empty(len(depth), np.int64)
        turn = np.array([int(n[0][0]) if len(n[0]) else 1 << 40 for n in nodes])
        open_: list[tuple[int, int, int]] = []  # (depth from, depth to, nodes from) of the current path
        at = 0
        for i, (d, _, _) in enumerate(nodes):
            if i and len(d):
                while open_ and open_[-1][1] > turn[i]:
                    a, b, base = open_.pop()
                    cut = max(a, int(turn[i]))
                    last[base + cut - a : base + b - a] = i
                    if cut > a:
                        open_.append((a, cut, base))
                        break
            if len(d):
                open_.append((int(d[0]), int(d[-1]) + 1, at))
            at += len(d)
        for a, b, base in open_:
            last[base : base + b - a] = len(rows)
        by = np.argsort(depth, kind="stable")
        self.depth, self.element, self.first, self.last = depth[by], element[by], first[by], last[by]
        deepest = int(depth.max()) + 1
        self.cuts = [0]
        while self.cuts[-1] < deepest:
            self.cuts.append(min(deepest, max(16, self.cuts[-1] * 2)))
        self.layers = np.searchsorted(self.depth, self.cuts)

    def probe(self, shingles: np.ndarray, percent: int, alive: np.ndarray) -> np.ndarray:
        """Indices (in the trie's order) of the sets in ``alive`` that reach the threshold with this one."""
        size = len(shingles)
        alive = alive & (100 * np.minimum(self.sizes, size) >= percent * np.maximum(self.sizes, size))
        if not alive.any():
            return np.empty(0, np.int64)
        at = np.searchsorted(self.elements, shingles)
        at[at == len(self.elements)] = 0
        mine = np.zeros(len(self.elements), bool)
        mine[self.rank[at[self.elements[at] == shingles]]] = True
        needed = -(-percent * (self.sizes + size) // (100 + percent))
        overlap, left = np.zeros(len(self.ids), np.int64), int(mine.sum())
        for k in range(len(self.cuts) - 1):
            span = slice(self.layers[k], self.layers[k + 1])
            hit = np.flatnonzero(mine[self.element[span]]) + span.start
            steps = np.bincount(self.first[hit], minlength=len(overlap) + 1) - np.bincount(self.last[hit], minlength=len(overlap) + 1)
            overlap += np.cumsum(steps)[:-1]
            remaining = np.minimum(np.maximum(self.sizes - self.cuts[k + 1], 0), left)
            alive &= overlap + remaining >= needed
            if not alive.any():
                break
        return np.flatnonzero(alive & (overlap >= needed))


def forest(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int = PERCENT, labels: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links (id, id) of a spanning forest of all links within ``left``, or between ``left`` and ``right``.

    Pairs that are connected already, from the start if they have one label, are not tested again; all others are.
    """
    inner = right is None
    probes = left if inner else right
    if not left or not probes:
        return []
    trie = Trie([s for _, s in left], [i for i, _ in left])
    place = {i: k for k, i in enumerate(trie.ids.tolist())}
    names = [*trie.ids.tolist(), *([] if inner else [i for i, _ in probes])]
    # Component of the trie's sets, then of the other side's.
    root = np.arange(len(names)) if labels is None else np.unique([labels[i] for i in names], return_inverse=True)[1]
    out = []
    # Sets with the most frequent elements first: they link most others, which then are skipped.
    order = sorted(range(len(probes)), key=lambda k: place[probes[k][0]]) if inner else range(len(probes))
    for k in order:
        name, shingles = probes[k]
        me = place[name] if inner else len(trie.ids) + k
        alive = root[: len(trie.ids)] != root[me]
        for j in trie.probe(shingles, percent, alive):
            if root[j] != root[me]:
                root[root == root[j]] = root[me]
                out.append((name, int(trie.ids[j])))
    return out


def _node():
    """A class at a level: 64 bits of digest and level."""
    return F.xxhash64("digest", "level")


def local_heads(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, head) rows that connect the same nodes: a row per distinct key whose node and head are the smallest
    node with it, and a row per pair of another node and such a head, under a key of no meaning (the node)."""
    order = np.argsort(keys, kind="stable")
    k, n = keys[order], nodes[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    heads = np.minimum.reduceat(n, start) if len(k) else n
    of = np.repeat(heads, np.diff(np.append(start, len(k))))
    apart = np.unique(np.stack([n[n != of], of[n != of]], 1), axis=0)
    by = np.argsort(heads, kind="stable")  # equal heads in a row, so that the exchange compresses them
    return np.concatenate([k[start][by], apart[:, 0]]), np.concatenate([heads[by], apart[:, 0]]), np.concatenate([heads[by], apart[:, 1]])


def block_members(sketch: DataFrame) -> DataFrame:
    """(_at, block) of the classes, at their levels, that share a key with another class.

    A task joins the classes that share a key within it before anything is exchanged, so a key that near copies share
    costs a row a task; keys that occur once, nearly all, are exchanged once."""
    with_keys = sketch.filter("digest is not null and size(keys) > 0")
    rows = with_keys.select("keys", "levels", F.transform("levels", lambda level: F.xxhash64("digest", level)).alias("nodes"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            columns = local_heads(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(columns[0]), 1 << 18):
                key, node, head = (c[at : at + (1 << 18)] for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node ^ head), pa.array(head)], names=["key", "apart", "head"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            keys, levels, nodes = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "levels", "nodes"))
            row = lambda c: np.repeat(np.arange(batch.num_rows), batch.column(c).value_lengths().to_numpy(zero_copy_only=False))  # noqa: B023, E731
            place = np.searchsorted(row("levels") * (LEVEL_MASK + 1) + levels, row("keys") * (LEVEL_MASK + 1) + (keys & LEVEL_MASK))
            held.append((keys, nodes[place]))
            size += len(keys)
            if size >= TASK_KEYS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        release_memory()

    # A node differs from its head in few rows only: their difference is mostly zeros, which the exchange compresses.
    met = rows.mapInArrow(gather, "key long, apart long, head long")
    met = met.withColumn("first", F.min("head").over(Window.partitionBy("key"))).filter("first <> head or apart <> 0")
    node = F.col("head").bitwiseXOR(F.col("apart"))
    pairs = F.explode(F.array(F.struct(F.col("first").alias("u"), F.col("head").alias("v")), F.struct(F.col("head").alias("u"), node.alias("v"))))
    edges = met.select(pairs.alias("e")).select("e.u", "e.v").filter("u <> v")
    return components(edges).select(F.col("node").alias("_at"), F.col("root").alias("block"))


def _sets(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The shingles of the representatives in ``known`` (rep, digest and further columns), with those columns."""
    more = [c for c in known.columns if c not in ("rep", "digest")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(known), F.col("doc_id") == F.col("rep")).select("text", "digest", *more)

    def make():
        def run(cols):
            sets = shingle_sets(cols["text"], n)
            same = [len(s) > 0 and digest(s) == d for s, d in zip(sets, cols["digest"], strict=True)]  # a doc_id may stand for other texts too
            out = {c: [v for v, ok in zip(cols[c], same, strict=True) if ok] for c in more}
            return out | {"shingles": [s.tobytes() for s, ok in zip(sets, same, strict=True) if ok]}

        return run

    return map_batches(texts, make, ", ".join(f"`{c}` {t}" for c, t in known.dtypes if c in more) + ", shingles binary")


def _table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int = N, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v): links between classes' nodes that span every component."""
    leveled = classes.select("node", "rep", "digest", "n_shingles", F.explode("levels").alias("level"))
    known = leveled.join(members, _node() == F.col("_at")).select("node", "rep", "digest", "n_shingles", "block")
    # Only blocks of several tiles are joined back: few, so no key of a large block gathers rows.
    tiles = F.ceil(F.sum(F.col("n_shingles") * 8) / block_bytes).cast("int")
    several = staged(known.groupBy(F.col("block").alias("_b")).agg(tiles.alias("_t")).filter("_t > 1"), "large-blocks")
    known = known.join(sized(several), F.col("block") == F.col("_b"), "left").withColumn("_tiles", F.coalesce("_t", F.lit(1))).drop("_b", "_t")
    known = staged(known.withColumn("_sub", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_tiles")).cast("int")), "blocks")
    large = known.filter("_tiles > 1")
    if large.isEmpty():
        return _within(docs, known.withColumn("_pivot", F.lit(False)), n, percent)
    # The node of the smallest hash in each of a few parts of a large block; a row a pivot.
    order = F.struct(F.xxhash64("node", F.lit(2)).alias("h"), "node")
    pivots = staged(large.groupBy("block", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PIVOTS))).agg(F.min(order).alias("_p")).select(F.col("block").alias("_b"), F.col("_p")["node"].alias("_pn")), "pivots")
    marked = known.join(sized(pivots), (F.col("block") == F.col("_b")) & (F.col("node") == F.col("_pn")), "left").withColumn("_pivot", F.col("_pn").isNotNull()).drop("_b", "_pn")
    found = staged(_within(docs, marked, n, percent), "links")
    return found.unionByName(_across(docs, large, found, n, percent, block_bytes))


def _within(docs: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """First pass: links within each sub-block and its block's pivots."""
    sets = _sets(docs, known.select("node", "rep", "digest", "block", "_tiles", "_sub", "_pivot"), n)
    to = F.explode(F.when(F.col("_pivot"), F.sequence(F.lit(0), F.col("_tiles") - 1)).otherwise(F.array("_sub")))
    dealt = sets.select("block", to.alias("_sub"), "node", "shingles")

    def solve(rows: pa.Table) -> pa.Table:
        mine = {node: np.frombuffer(raw, np.uint64) for node, raw in zip(rows.column("node").to_pylist(), rows.column("shingles").to_pylist(), strict=True)}
        return _table(forest(list(mine.items()), None, percent))

    return dealt.groupBy("block", "_sub").applyInArrow(solve, "u long, v long")


def _across(docs: DataFrame, large: DataFrame, found: DataFrame, n: int, percent: int, block_bytes: int) -> DataFrame:
    """Second pass: sets outside their block's largest component against all other sub-blocks of the block."""
    roots = components(found).withColumnsRenamed({"node": "_n", "root": "_label"})
    state = staged(large.join(roots, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_label", "node")).drop("_n", "_label"), "labels")
    counts = state.groupBy("block", "label").agg(F.count("*").alias("_c"))
    top = counts.groupBy("block").agg(F.max_by("label", F.struct("_c", "label")).alias("_top"))
    state = state.join(top, "block").withColumn("_rest", F.col("label") != F.col("_top"))
    left = state.filter("_rest").groupBy("block").agg(F.sum(F.col("n_shingles") * 8).alias("_bytes"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_bytes") / block_bytes)).cast("int")
    state = state.join(left.select("block", chunks.alias("_chunks")), "block")  # blocks of one component are done
    state = staged(state.select("node", "rep", "digest", "block", "_tiles", "_sub", "label", "_rest", "_chunks"), "unlinked")
    if state.isEmpty():
        return found.limit(0)
    sets = _sets(docs, state, n)
    tile = lambda sub, chunk, probe: F.struct(sub.cast("int").alias("s"), chunk.cast("int").alias("c"), F.lit(probe).alias("probe"))
    stored = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: tile(F.col("_sub"), c, False))
    chunk = F.pmod(F.xxhash64("node", F.lit(4)), F.col("_chunks"))
    others = F.filter(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda s: s != F.col("_sub"))
    probes = F.when(F.col("_rest"), F.transform(others, lambda s: tile(s, chunk, True))).otherwise(F.array().cast("array<struct<s:int,c:int,probe:boolean>>"))
    dealt = sets.select("block", "node", "label", "shingles", F.inline(F.concat(stored, probes)))

    def solve(rows: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        labels = dict(zip(rows.column("node").to_pylist(), rows.column("label").to_pylist(), strict=True))
        for probe, node, raw in zip(*(rows.column(c).to_pylist() for c in ("probe", "node", "shingles")), strict=True):
            sides[probe][node] = np.frombuffer(raw, np.uint64)
        return _table(forest(list(sides[0].items()), list(sides[1].items()), percent, labels))

    return dealt.groupBy("block", "s", "c").applyInArrow(solve, "u long, v long")


def _components(docs: DataFrame, n: int, percent: int, block_bytes: int) -> DataFrame:
    """Per row: doc_id, _hash, n_shingles, component_id, and whether the row is of the class and doc_id that the component is named after."""
    slim = docs.select("doc_id", "text")
    sketch = staged(sketches(slim, n, percent), "sketches")
    # Rows without a doc_id may be those that bear a class's levels, so they leave afterwards.
    classes = sketch.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("levels", ignorenulls=True).alias("levels"))
    classes = staged(classes.filter("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers of the classes, fixed once they are written
    found = links(slim, classes, block_members(sketch), n, percent, block_bytes)
    roots = components(found).withColumnsRenamed({"node": "_n"})
    named = classes.join(roots, F.col("node") == F.col("_n"), "left").select("digest", "node", "rep", F.coalesce("root", "node").alias("root"))
    heads = named.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("_head"))
    named = named.join(heads, "root").select("digest", F.col("_head")["rep"].alias("_component"), (F.col("_head")["node"] == F.col("node")).alias("_first"))
    rows = sketch.select("doc_id", "_hash", "n_shingles", "digest").join(named, "digest", "left")
    # Texts without words are linked with nothing; each is its own first.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return rows.select("doc_id", "_hash", "n_shingles", component.alias("component_id"), (F.coalesce("_first", F.lit(True)) & (F.col("doc_id") == component)).alias("_named"))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    return _components(docs, n, percent, block_bytes).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with one of each component left (the smallest doc_id; of rows that repeat it, one).

    Rows without a doc_id have no component and stay, and so do texts without words, each once for its doc_id."""
    found = staged(_components(docs, n, percent, block_bytes), "near")
    doc_id, text = fresh(docs, "_id", "_hash")
    keyed = docs.withColumn(text, F.xxhash64("text")).withColumn(doc_id, F.col("doc_id").cast("long"))
    gone = staged(found.filter("not _named").select(F.col("doc_id").alias("_gone"), F.col("_hash").alias("_text_gone")).distinct(), "gone")
    gone_, text_ = fresh(keyed, "_gone", "_text_gone")
    gone = gone.withColumnsRenamed({"_gone": gone_, "_text_gone": text_})
    same = (F.col(doc_id) == F.col(gone_)) & (F.col(text) == F.col(text_))
    left = keyed.join(sized(gone), same, "left_anti")
    # A doc_id's rows of the first class are one document however they are written, and so are its equal texts without words.
    kept = found.filter("_named and doc_id is not null").withColumn("_class", F.when(F.col("n_shingles") == 0, F.col("_hash")))
    repeated = kept.groupBy(F.col("doc_id").alias("_d"), F.col("_class").alias("_c")).count().filter("count > 1")
    (class_,) = fresh(left, "_class")
    again = kept.join(repeated, (F.col("doc_id") == F.col("_d")) & F.col("_class").eqNullSafe(F.col("_c")), "left_semi")
    again = staged(again.select(F.col("doc_id").alias(gone_), F.col("_hash").alias(text_), F.col("_class").alias(class_)).distinct(), "again")
    if again.isEmpty():
        return left.drop(doc_id, text)
    once = left.join(sized(again), same, "left_anti").drop(doc_id, text)
    rest = left.join(sized(again), same).dropDuplicates([doc_id, class_])
    return once.unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op8(spark, sf_dir):
    from .runtime import table

    return near_duplicates(table(spark, sf_dir, "documents"))
