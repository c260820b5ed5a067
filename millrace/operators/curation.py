"""Offline curation of reasoning rows: canonical schema, filters, prompt and target rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import with_positions

MESSAGES = "array<struct<role:string,content:string>>"
# Columns that the explanation template makes obsolete.
OBSOLETE = (
    "responses", "test_score", "gemini_thinking_trajectory", "gemini_attempt", "deepseek_thinking_trajectory", "deepseek_attempt", "gemini_grade", "gemini_grade_reason", "deepseek_grade_reason",
)


def messages(*turns: tuple[str, Column | str]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), (F.col(c) if isinstance(c, str) else c).alias("content")) for role, c in turns])


def pick_candidate(key: Column | str, *candidates: str, seed: int = 42) -> Column:
    """One of the non-empty candidates, chosen by a hash of the key (not by a row-order random stream); else the first, or ''."""
    k = F.col(key) if isinstance(key, str) else key
    full = F.filter(F.array(*candidates), lambda c: c.isNotNull() & (T.strip(c) != ""))
    chosen = F.try_element_at(full, (F.floor(T.hashed_unit(k, str(seed)) * F.size(full)) + 1).cast("int"))
    return F.coalesce(chosen, F.col(candidates[0]), F.lit(""))


def rl_rows(df: DataFrame, source: str, system: str, question: str = "question", answer: str = "final_answer", solution: str = "solution", topic: str = "topic", difficulty: str = "difficulty", index: str = "index", split: str = "train") -> DataFrame:
    """The canonical row: data_source, prompt, target, ability, reward_model, extra_info."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(
        F.lit(source).alias("data_source"), messages(("system", F.lit(system)), ("user", text(question))).alias("prompt"),
        messages(("assistant", T.normalize_think(solution))).alias("target"), F.lit("").alias("ability"),
        F.struct(F.lit("rule").alias("style"), text(answer).alias("ground_truth")).alias("reward_model"),
        F.struct(F.col(index).cast("bigint").alias("index"), F.lit(split).alias("split"), text(topic).alias("topic"), F.col(difficulty).cast("double").alias("difficulty")).alias("extra_info"),
    )


def coerce_target(df: DataFrame, column: str = "target") -> Column:
    """Message list from any of: message list, list of texts, one message, text; decided by the schema, not by rows."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind.startswith("array<struct"):
        return c
    if kind == "array<string>":
        return F.transform(c, lambda x: F.struct(F.lit("assistant").alias("role"), x.alias("content")))
    if kind.startswith("struct"):
        return F.array(F.struct(c["role"].alias("role"), c["content"].alias("content")))
    if kind == "string":
        return messages(("assistant", c))
    raise TypeError(f"{column} is {kind}")


def difficulty_filter(df: DataFrame, threshold: float, inclusive: bool = False, field: str = "extra_info.difficulty") -> DataFrame:
    """Strictly above (or at least) the threshold; null never passes.  A nested field is pushed to the scan."""
    return df.where(F.col(field) >= threshold if inclusive else F.col(field) > threshold)


def sample_exactly(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows (all if fewer) without replacement: the smallest hashes, as one top-n if they are few, else by position."""
    if n <= TOP_ROWS:
        return df.orderBy(_hash_order(key, seed), key).limit(n)
    return _by_hash(df, key, seed).where(F.col("_place") < n).drop("_place")


#: Rows up to which a sample is a top-n, which meets in one task.
TOP_ROWS = 100_000


def _hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _by_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Dense positions _place in hash order, by ranges."""
    return with_positions(df.withColumn("_h", _hash_order(key, seed)), "_h", key, out="_place").drop("_h")


def hard_set(df: DataFrame, threshold: float = 0.5, metric: Column | str = "test_score.mean_score") -> DataFrame:
    """Rows whose metric is at most the threshold; a missing metric counts as 0 and stays."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return df.where(F.coalesce(m, F.lit(0.0)) <= threshold)


def filter_stats(df: DataFrame, passes: Column, metric: Column) -> DataFrame:
    """One row: total, kept, dropped, percentage kept, and min / mean / max of the kept metric."""
    kept = F.when(passes, metric)
    return df.agg(F.count("*").alias("n_total"), F.count_if(passes).alias("n_kept"), F.count_if(~passes).alias("n_dropped"), (F.count_if(passes) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("pct_kept"), F.min(kept).alias("kept_min"), F.avg(kept).alias("kept_mean"), F.max(kept).alias("kept_max"))


def rewrite_prompts(df: DataFrame, system: str, user_template: str, mode: str = "full") -> DataFrame:
    """Rows with a problem get a new two-turn prompt and a rewritten target; the old ones are kept beside them."""
    out = df.withColumn("_problem", T.problem_of("prompt")).where(F.col("_problem").isNotNull())
    out = out.withColumns({"old_prompt": F.col("prompt"), "old_target": F.col("target")})
    prompt = messages(("system", F.lit(system)), ("user", T.template(user_template, problem="_problem")))
    return out.withColumns({"prompt": prompt, "target": T.rewrite_messages("old_target", mode)}).drop("_problem")


def explanation_prompts(df: DataFrame, system: str, user_template: str) -> DataFrame:
    """se_prompt from problem, thinking and answer; rows without both prompt turns or a closing tag go."""
    content = F.get("target", F.lit(0))["content"]
    out = df.where((F.size("prompt") >= 2) & F.contains(content, F.lit(T.CLOSE)))
    think, answer = T.between_closings(content)
    out = out.withColumns({"_p": T.problem_of("prompt"), "_t": think, "_a": answer})
    role = F.get("prompt", F.lit(0))["role"]
    first = F.struct(role.alias("role"), F.lit(system).alias("content"))
    second = F.struct(F.lit("user").alias("role"), T.template(user_template, problem="_p", think="_t", answer="_a").alias("content"))
    return out.withColumn("se_prompt", F.array(first, second)).drop("_p", "_t", "_a", *OBSOLETE)


def target_length_filter(df: DataFrame, tokens: Column, limit: int, target: str = "target") -> DataFrame:
    """Rows whose target has at most ``limit`` tokens (an array column over the target's first message); a missing or
    empty target has none and stays."""
    missing = F.col(target).isNull() | (F.size(target) <= 0)
    return df.where(F.when(missing, 0).otherwise(F.coalesce(F.size(tokens), F.lit(0))) <= limit)


def source_rows(source: DataFrame, failed: DataFrame, index: str = "original_index") -> DataFrame:
    """The source rows of failed prompts, each once, by the index that their samples carry."""
    return source.join(failed.select(index).distinct(), index, "left_semi")


def head_share(df: DataFrame, share: float, order: str, tail: bool = False) -> DataFrame:
    """The first (last) round(share * rows) rows by an order.  A negative share counts from the end."""
    keep = round(abs(share) * df.count())
    placed = with_positions(df, f"-{order}" if tail or share < 0 else order, out="_place")
    return placed.where(F.col("_place") < keep).drop("_place")


def hash_split(df: DataFrame, share: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly int(rows * share) training rows, by hash order."""
    placed, n = _by_hash(df, key, seed), int(df.count() * share)
    return placed.where(F.col("_place") < n).drop("_place"), placed.where(F.col("_place") >= n).drop("_place")


def drop_targets(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Target dropout: a hash-chosen share of rows loses its target."""
    return df.withColumn("target", F.when(T.hashed_unit(key, str(seed)) >= share, F.col("target")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def outlier_mean_exp(df: DataFrame, value: str, bound: float = 20.0) -> DataFrame:
    """Mean of exp(v) over -bound < v < bound, in one row."""
    ok = (F.col(value) > -bound) & (F.col(value) < bound)
    return df.agg(F.avg(F.when(ok, F.exp(value))).alias("mean_exp"), F.count_if(ok).alias("n_used"))


def last_user_turn(df: DataFrame) -> DataFrame:
    """Per conversation the content of its last user turn; null without one."""
    return df.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("last_user"))


def tool_rewards(df: DataFrame, key: str = "uid", order: str = "k", score: str = "score", penalty: float = -0.05) -> DataFrame:
    """0 when the score beats the best of the attempts before (0 before the first), else the penalty."""
    before = F.coalesce(F.max(score).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("tool_reward", F.when(F.col(score) > before, 0.0).otherwise(penalty))
