"""Batch layout: positions, repeats, chunks, padding, permutations, pairs of columns.

Rows have no order of their own; every layout operator takes an explicit ``pos`` (dense, from 0) or makes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_names, staged


def _field(name: str):
    return lambda t: t[name]


def _order_columns(order: tuple[str, ...]) -> list[Column]:
    """A leading minus means descending; nulls come first, in descending order last."""
    return [F.col(o.removeprefix("-")).desc() if o.startswith("-") else F.col(o).asc() for o in order]


#: Bits of a row's number in its partition, in Spark's increasing ids.
ROW_BITS = 33


def _sorted_rows(df: DataFrame, order: tuple[str, ...], partitions: int | None) -> tuple[DataFrame, str, str, list[str]]:
    """The rows in one range-partitioned order, staged, with the columns of partition number and place in the partition
    (and free names for what callers add).

    Sorting happens once and its result is written, so all later uses agree, whatever is pruned, recomputed or lost;
    two range exchanges of one table would not, as each samples for itself.  Rows that are equal in the order are told
    apart by their place in the input, so that a value that most rows share is spread over partitions too.
    """
    tie, part, row, *more = free_names(df, "_tie", "_part", "_row", "_before", "_n", "_of")
    keys = [*_order_columns(order), F.col(tie).asc()]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    number = F.monotonically_increasing_id()
    numbered = ranged.sortWithinPartitions(*keys).drop(tie).withColumns({part: F.shiftright(number, ROW_BITS), row: number.bitwiseAND((1 << ROW_BITS) - 1)})
    return staged(numbered, "sorted"), part, row, more


def with_positions(df: DataFrame, *order: str, partitions: int | None = None, out: str = "pos") -> DataFrame:
    """Dense positions from 0 by an order (``-name``: descending; nulls first, in descending order last), without
    sorting all rows in one task: a range-partitioned sort is staged, and a position is the row's place in its
    partition plus the sizes of the partitions before, one small row each.  Rows that are equal in the order get
    positions in any order, fixed once they are staged.  All columns, whatever their names, are kept."""
    rows, part, row, (before, n, of) = _sorted_rows(df, order, partitions)
    sizes = rows.groupBy(F.col(part).alias(of)).agg((F.max(row) + 1).alias(n))
    earlier = Window.partitionBy(F.lit(0)).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(of, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    placed = rows.join(F.broadcast(offsets), F.col(part) == F.col(of))  # a row a partition
    return placed.withColumn(out, (F.col(before) + F.col(row)).cast("long")).drop(part, row, before, of)


def with_running(df: DataFrame, sums: dict[str, str], *order: str, partitions: int | None = None) -> DataFrame:
    """Running sums by an order, the row itself included (``sums``: column -> name of its sum), without one task that
    sorts all rows: sums within the partitions of a staged range sort, shifted by the totals of those before."""
    rows, part, row, (before, _, of) = _sorted_rows(df, order, partitions)
    inside = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: F.sum(c).over(inside) for c, name in sums.items()})
    shift = [f"{before}_{k}" for k in range(len(sums))]
    totals = rows.groupBy(F.col(part).alias(of)).agg(*(F.sum(c).alias(b) for c, b in zip(sums, shift, strict=True)))
    earlier = Window.partitionBy(F.lit(0)).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(of, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in shift))
    joined = local.join(F.broadcast(offsets), F.col(part) == F.col(of))  # a row a partition
    return joined.withColumns({name: F.col(b) + F.coalesce(name, F.lit(0)) for name, b in zip(sums.values(), shift, strict=True)}).drop(part, row, of, *shift)


def repeat(df: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """Every row n times: aabb (interleaved) or abab; pos is the new position."""
    copies = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    if interleave:
        new = F.col("pos") * n + F.col("_k")
        return copies.withColumn("pos", new).drop("_k")
    size = df.agg(F.count("*").alias("_size"))
    return copies.join(F.broadcast(size)).withColumn("pos", F.col("_k") * F.col("_size") + F.col("pos")).drop("_k", "_size")  # one row


def repeat_each(df: DataFrame, times: Column | str) -> DataFrame:
    """Each row as often as its own count says (0 drops it)."""
    t = F.col(times) if isinstance(times, str) else times
    return df.select("*", F.posexplode(F.array_repeat(F.lit(0), t.cast("int"))).alias("copy", "_x")).drop("_x")


def unfold_columns(df: DataFrame, width: int, *arrays: str) -> DataFrame:
    """Cuts array columns into pieces of a width, a row each; other columns repeat."""
    size = F.size(F.col(arrays[0]))
    pieces = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = df.select("*", F.explode(pieces).alias("piece"))
    return rows.withColumns({a: F.slice(F.col(a), F.col("piece") * width + 1, F.lit(width)) for a in arrays})


def fold(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """n consecutive rows become one with an array per column, in order of pos."""
    rows = df.groupBy(F.floor(F.col("pos") / n).cast("long").alias("pos_")).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_t"))
    return rows.select(F.col("pos_").alias("pos"), *(F.transform("_t", _field(c)).alias(c) for c in columns))


def unfold(df: DataFrame, n: int, *columns: str) -> DataFrame:
    rows = df.select("pos", F.posexplode(F.arrays_zip(*columns)).alias("_k", "_t"))
    return rows.select((F.col("pos") * n + F.col("_k")).alias("pos"), *(F.col("_t")[c].alias(c) for c in columns))


def chunk(df: DataFrame, n: int, total: int, strict: bool = True) -> DataFrame:
    """Label of the chunk of ceil(total / n) rows; strict needs a total that n divides."""
    if strict and total % n:
        raise ValueError(f"{total} rows don't divide into {n} chunks")
    return df.withColumn("chunk", F.floor(F.col("pos") / max(1, -(-total // n))).cast("int"))


def batches(df: DataFrame, size: int, total: int | None = None, drop_last: bool = False) -> DataFrame:
    out = df.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
    return out.filter(F.col("batch") < total // size) if drop_last and total is not None else out


def pad_to_divisor(df: DataFrame, divisor: int, total: int) -> DataFrame:
    """Adds rows from the head, cycling, until the divisor divides the total; is_pad marks them."""
    missing = -total % divisor if total else 0
    rows = df.withColumn("is_pad", F.lit(False))
    if not missing:
        return rows
    rounds = -(-missing // total)
    extra = df.filter(F.col("pos") < missing).select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_r"))
    extra = extra.withColumn("pos", F.col("pos") + F.lit(total) + F.col("_r") * total).filter(F.col("pos") < total + missing).drop("_r")
    return rows.unionByName(extra.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def take_positions(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index table (new_pos, pos), repeats and any order allowed."""
    return df.join(index, "pos").drop("pos").withColumnRenamed("new_pos", "pos")


def take_slice(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    cond = (F.col("pos") >= start) & (F.pmod(F.col("pos") - start, F.lit(step)) == 0)
    return df.filter(cond if stop is None else cond & (F.col("pos") < stop))


def inverse_permutation(index: DataFrame) -> DataFrame:
    return index.select(F.col("pos").alias("new_pos"), F.col("new_pos").alias("pos"))


def column_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables with the same rows; shared columns must agree (null-safe), else the row fails."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    both = left.join(other, key, "full_outer")
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        both = both.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(left.dtypes)[c]))).drop(f"_r_{c}")
    return both


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def concat(*frames: DataFrame) -> DataFrame:
    """UNION ALL of frames with the same columns."""
    first, *rest = frames
    for other in rest:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(first.columns) ^ set(other.columns))}")
        first = first.unionByName(other)
    return first


def transpose(df: DataFrame, key: str = "uid", order: str = "k", value: str = "response") -> DataFrame:
    """One row a key with its values as an array in order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_t"))
    return rows.select(key, F.transform("_t", lambda t: t[value]).alias(f"{value}s"))


def run_merge(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Numbers the runs of equal labels in a sequence (gaps and islands): column run."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    return df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def tool_mask(tokens: DataFrame, roles: DataFrame) -> DataFrame:
    """loss_mask 0 inside the turns of tools: tokens (uid, pos, is_end) meet the response's turns (uid, turn, role).

    A turn ends with an end token; adjacent tool turns are one.  Tokens after the last turn keep their mask.
    """
    order = Window.partitionBy("uid").orderBy("turn")
    tool = F.col("role") == "tool"
    merged = roles.withColumn("_again", tool & F.coalesce(F.lag("role").over(order) == "tool", F.lit(False))).filter(~F.col("_again"))
    turns = merged.withColumn("_turn", F.row_number().over(order) - 1).filter(tool).select("uid", "_turn", F.lit(True).alias("_tool"))
    ends = F.sum(F.col("is_end").cast("int")).over(Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    both = tokens.withColumn("_turn", F.coalesce(ends, F.lit(0)).cast("int")).join(turns, ["uid", "_turn"], "left")
    return both.withColumn("loss_mask", F.when(F.col("_tool"), 0).otherwise(1)).drop("_turn", "_tool")


def mini_batches(df: DataFrame, size: int, total: int, epochs: int = 1, key: str | None = None, seed: int | None = None) -> DataFrame:
    """Rows of every epoch with epoch, step (counted through all epochs) and place: rows in order of ``pos``, or, with a
    seed, in the order of a hash of ``key`` that changes every epoch.  A size that doesn't divide the total is an error."""
    if total % size:
        raise ValueError(f"{total} rows don't divide into mini-batches of {size}")
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs else df.withColumn("epoch", F.lit(0)).limit(0)
    if seed is not None:
        h = F.md5(F.concat_ws(":", F.col(key or "pos").cast("string"), F.lit(seed).cast("string"), F.col("epoch").cast("string")))
        rows = with_positions(rows.withColumn("_h", h), "epoch", "_h", key or "pos", out="_all").withColumn("place", F.col("_all") - F.col("epoch") * total).drop("_h", "_all")
    else:
        rows = rows.withColumn("place", F.col("pos"))
    return rows.withColumn("step", (F.col("epoch") * (total // size) + F.floor(F.col("place") / size)).cast("long"))


def shard(df: DataFrame, rank: int, world: int, total: int, drop_last: bool = True) -> DataFrame:
    """The rows of one worker, every ``world``-th by ``pos``.  Without dropping, rows from the head (again and again if
    they are few) fill the shorter shards, so that all are of one length."""
    if drop_last:
        return df.filter((F.col("pos") < total // world * world) & (F.pmod("pos", F.lit(world)) == rank))
    mine = df.filter(F.pmod("pos", F.lit(world)) == rank)
    last = -(-total // world) * world - world + rank  # the place of this worker's last row
    if last < total:
        return mine
    return mine.unionByName(df.filter(F.col("pos") == (last - total) % total).withColumn("pos", F.lit(last).cast("long")))


def collated(df: DataFrame, batch: str, *columns: str) -> DataFrame:
    """Per batch one array per column, in order of ``pos``: rows of fields become fields of rows."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_t"))
    return rows.select(batch, *(F.transform("_t", _field(c)).alias(c) for c in columns))


def accumulated(df: DataFrame, name: str = "name", value: str = "value", order: str = "step") -> DataFrame:
    """Per name its values in order, from a long table of metrics."""
    rows = df.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_t"))
    return rows.select(name, F.transform("_t", _field(value)).alias("values"))


def prompt_uid(index: Column | str, salt: str = "uid") -> Column:
    """An id of a prompt that is the same in every run, in the form of a UUID."""
    h = F.md5(F.concat(F.lit(salt + ":"), (F.col(index) if isinstance(index, str) else index).cast("string")))
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def random_mask(key: Column | str, width: int, most_valid: float, most_left: float, least_valid: float = 0.0, seed: int = 0) -> Column:
    """array<int>: zeros, ones, zeros; the numbers of zeros on the left and of ones are hashed from the key, within
    shares of the width."""
    if not (0 < most_valid <= 1 and 0 <= most_left < 1 and least_valid <= most_valid):
        raise ValueError("shares out of range")
    least, most, left = max(1, int(width * least_valid)), int(width * most_valid), int(width * most_left)
    if most + left > width:
        raise ValueError("padding and valid tokens exceed the width")
    k = F.col(key) if isinstance(key, str) else key
    pick = lambda n, what: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed)), F.lit(what))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    zeros, ones = pick(left + 1, "left"), F.lit(least) + pick(most - least + 1, "valid")
    return F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(width) - zeros - ones))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
