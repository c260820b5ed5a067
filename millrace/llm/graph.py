"""Connected components on DataFrames, for edge tables of any size."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import staged

#: Rounds that follow the ids' own order; later ones follow a hash of the ids, another one each round.
ID_ROUNDS = 2


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) edges -> (node, root) for every node that has an edge to another node; root is the smallest.

    Each round hooks the nodes to others of their component, contracts the graph along the hooks and composes
    the labels.  The first rounds hook a node to its smallest neighbour if that is smaller, so stars around their
    smallest node take one.  Where the ids ascend along a chain that rule takes one node a round; later rounds
    therefore hook a node to the first one within two steps in the order of a hash that changes every round,
    which leaves a constant share of the nodes whatever their ids are, and rounds are logarithmic.  The last
    node in a round's order disappears, so the rounds end by themselves.  A contracted node bears the smallest
    id in it.  The minimum per node is a partial aggregation; joins on a hub are plain equi-joins that adaptive
    execution may split.  Every round is staged, so its lineage is one round long.
    """
    pairs = staged(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    for step in count():
        both = pairs.union(pairs.select("v", "u"))
        if step < ID_ROUNDS:
            hooks = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("r")), "cc-hooks")
        else:
            hooks = _hashed_hooks(both, step)
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            labels = labels.join(hooks, labels["root"] == hooks["u"], "left").select("node", F.coalesce("r", "root").alias("root"))
        labels = staged(labels, "cc-labels")
        moved = pairs.join(hooks.withColumnsRenamed({"u": "u_", "r": "ru"}), F.col("u") == F.col("u_")).select("ru", "v")
        moved = moved.join(hooks.withColumnsRenamed({"u": "v_", "r": "rv"}), F.col("v") == F.col("v_")).select("ru", "rv")
        pairs = staged(moved.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
        if pairs.isEmpty():
            return labels


def _hashed_hooks(both: DataFrame, step: int) -> DataFrame:
    """(u, r): nodes that share the first node within two steps, in the order of this round's hash, get the smallest id among them."""

    def first(near: DataFrame) -> DataFrame:
        # The hash first, then the id: a strict order even where hashes collide.
        least = near.groupBy("u").agg(F.min(F.struct(F.xxhash64("m", F.lit(step)).alias("h"), "m")).alias("_least"))
        return least.select("u", F.col("_least")["m"].alias("m"))

    own = both.select("u", F.col("u").alias("m")).distinct()
    one = staged(first(both.select("u", F.col("v").alias("m")).union(own)), "cc-first")
    through = both.join(one.withColumnsRenamed({"u": "v_"}), F.col("v") == F.col("v_")).select("u", "m")
    two = staged(first(through.union(one)), "cc-second")
    names = two.groupBy("m").agg(F.min("u").alias("r"))
    return staged(two.join(names, "m").select("u", "r"), "cc-hooks")
