"""Scoring responses: a registry of scorers as column builders, dispatched by data source."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from .registry import Registry

#: Scorer: (response column, truth column) -> a double column.
SCORERS: Registry = Registry("scorer")
SCORERS.register("gsm8k")(lambda r, t: A.gsm_score(r, t))
SCORERS.register("gsm8k_flexible")(lambda r, t: A.gsm_score(r, t, "flexible"))
SCORERS.register("math")(lambda r, t: A.math_score(r, t))
SCORERS.register("dapo")(lambda r, t: A.dapo_score(r, t)["score"])
SCORERS.register("qa_em")(lambda r, t: A.search_score(r, F.array(t)))
SCORERS.register("qa_subem")(lambda r, t: A.search_score(r, F.array(t), contained=True))
SCORERS.register("letter")(lambda r, t: (A.choice_letter(r) == t).cast("double"))
SCORERS.register("grade")(lambda r, t: A.grade_udf(A.last_boxed_content(r), t).cast("double"))
SCORERS.register("geo")(lambda r, t: 0.9 * A.grade_udf(A.last_boxed_content(r), t).cast("double") + 0.1 * A.geo_format(r).cast("double"))
SCORERS.register("math_boxed")(lambda r, t: G.boxed_udf(r, t).cast("double"))
SCORERS.register("math_marked", "entropy_math")(lambda r, t: G.marked_udf(r, t).cast("double"))
SCORERS.register("math_verify")(lambda r, t: G.verify_udf(r, t).cast("double"))
SCORERS.register("math_verify_think")(lambda r, t: G.verify_after_thinking_udf(r, t).cast("double"))
SCORERS.register("think_gated")(lambda r, t: G.think_gated_udf(r, F.array(t)))
SCORERS.register("strict_box")(lambda r, t: G.strict_box(r, t)["score"])
SCORERS.register("char_count")(lambda r, t: F.coalesce(A.last_boxed_content(r) == t, F.lit(False)).cast("double"))

#: Scorers by the number of a reward implementation; earlier numbers have none any more.
BY_VERSION = {3: "math_verify_think", 4: "math_verify"}
#: Scorers of sources that keep their own whatever the version.
OF_SOURCE = {"openai/gsm8k": "gsm8k", "lighteval/MATH": "math"}
#: Sources of the reasoning suite and their scorers.
REASONING_SUITE = {"Maxwell-Jia/AIME_2024": "math_verify", "opencompass/cnmo2024_en": "math_verify", "opencompass/cnmo2024_zh": "math_verify", "Idavidrein/gpqa": "letter"}


def scorer_of(source: str, version: int) -> str:
    """The scorer's name for a source under a version of the reward; a version without one is an error."""
    if source in OF_SOURCE:
        return OF_SOURCE[source]
    if version not in BY_VERSION:
        raise NotImplementedError(f"reward version {version} has no scorer")
    return BY_VERSION[version]


def score(df: DataFrame, dispatch: Mapping[str, str], source: str = "data_source", response: str = "response", truth: str = "truth", unknown: str = "error") -> DataFrame:
    """Adds ``score`` by the scorer that ``dispatch`` names for the row's source.

    A source without a scorer is an error, or with ``unknown="null"`` a null score.  The dispatch is a chain of
    conditions in the plan, not a join.
    """
    out: Column | None = None
    for name, scorer in dispatch.items():
        value = F.coalesce(SCORERS.lookup(scorer)(F.col(response), F.col(truth)), F.lit(0.0))
        out = F.when(F.col(source) == name, value) if out is None else out.when(F.col(source) == name, value)
    rest = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(F.col(source), F.lit("null")))).cast("double") if unknown == "error" else F.lit(None).cast("double")
    return df.withColumn("score", rest if out is None else out.otherwise(rest))


def load_scorer(path: str, name: str, **kwargs) -> Callable:
    """A user's scorer from a file; a missing file or attribute is an error."""
    spec = importlib.util.spec_from_file_location("user_scorer", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    fn = getattr(module, name)
    return lambda r, t: fn(r, t, **kwargs)


def response_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """test_score struct<scores_per_response, mean_score, max_score> from an array of scores; null for none."""
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(scores))
    return df.withColumn("test_score", F.struct(F.col(scores).alias("scores_per_response"), mean.alias("mean_score"), F.array_max(scores).cast("double").alias("max_score")))


def source_means(df: DataFrame, source: str = "data_source", prompt: str = "uid", value: str = "score") -> DataFrame:
    """Mean over prompts of the mean over responses, per source."""
    per = df.groupBy(source, prompt).agg(F.avg(value).alias("m"))
    return per.groupBy(source).agg(F.avg("m").alias("mean_score"), F.count("*").alias("n_prompts"))


def batch_means(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Unweighted mean over batches of the batches' mean mean_score and max_score, in one row."""
    per = df.groupBy(batch).agg(F.avg("mean_score").alias("m"), F.avg("max_score").alias("x"))
    return per.agg(F.avg("m").alias("mean_score"), F.avg("x").alias("max_score"), F.count("*").alias("n_batches"))


#: Reward manager: (rows, dispatch, options) -> rows with score, and what else the manager adds.
MANAGERS: Registry = Registry("reward manager")


@MANAGERS.register("naive", "batch")
def _plain(df: DataFrame, dispatch: Mapping[str, str], **options) -> DataFrame:
    """A score by source; a source without a scorer is an error."""
    return score(df, dispatch, **options)


@MANAGERS.register("prime")
def _forgiving(df: DataFrame, dispatch: Mapping[str, str], **options) -> DataFrame:
    """A row that can't be scored has 0, whatever the reason."""
    return score(df, dispatch, unknown="null", **options).withColumn("score", F.coalesce("score", F.lit(0.0)))


@MANAGERS.register("dapo")
def _length_aware(df: DataFrame, dispatch: Mapping[str, str], limit: int, buffer: int, factor: float = 1.0, length: str = "length", **options) -> DataFrame:
    """acc is the plain score; an overlong response's score is lowered by its penalty (overlong_reward)."""
    plain = score(df, dispatch, **options).withColumn("acc", F.col("score"))
    penalty = A.overlong_penalty(length, limit, buffer, factor)
    return plain.withColumns({"overlong_reward": penalty, "overlong": penalty < 0, "score": F.col("acc") + penalty})


@MANAGERS.register("math")
def _versioned(df: DataFrame, dispatch: Mapping[str, str], version: int, source: str = "data_source", **options) -> DataFrame:
    """Scorers by the version of the reward; ``dispatch`` names the sources, its values are not used."""
    return score(df, {name: scorer_of(name, version) for name in dispatch}, source, **options)


def managed(df: DataFrame, manager: str, dispatch: Mapping[str, str], **options) -> DataFrame:
    return MANAGERS.lookup(manager)(df, dispatch, **options)
