"""Physical plans: exchanges, pushed filters, pruned columns, absence of Python where built-ins do."""

import re

import pytest

from millrace.operators import curation as C
from millrace.plans.base import rollouts, table
from millrace.plans.catalog import QUERIES

from .support import DATA


def plan(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.mark.parametrize("name", ["grpo_adv", "grpo_split", "rloo_adv", "opo_adv", "dapo_filter", "accuracy_band", "valid_groups"])
def test_group_statistics_take_one_exchange(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert exchanges(text) == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["ppo_clip_loss", "loss_luffy_sft", "agg_loss_modes", "kl_penalties", "normalize_think", "gsm8k_score", "minerva_normalize", "qa_em", "gae_adv", "truncate_sides"])
def test_no_python_on_built_in_paths(spark, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(QUERIES[name](spark, DATA)))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(C.difficulty_filter(table(spark, DATA, "part").select("p_partkey", "p_size"), 25, field="p_size"))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,25)]" in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_size:int>", text)
    narrow = plan(rollouts(spark, DATA).select("uid", "score"))
    assert "props" not in narrow


def test_exact_sample_is_a_top_n(spark):
    text = plan(QUERIES["exact_sample"](spark, DATA))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_retrieval_moves_only_the_best(spark):
    """Neither search shuffles documents, vectors, words or pairs with queries: a task's best rows are all that moves."""
    for name in ("bm25_topk", "dense_topk"):
        text = plan(QUERIES[name](spark, DATA))
        assert len(re.findall(r"Exchange (?!SinglePartition)", text)) == 1 and "Join" not in text, name
        below = text[text.index("Exchange hashpartitioning") :]
        assert "MapInArrow" in below and "WindowGroupLimit" in below and "HashAggregate" not in below


@pytest.mark.parametrize("name", ["grade_symbolic", "grade_marked", "think_gated_score", "limited_scores", "verify_answer", "grade_boxed"])
def test_graders_are_not_left_to_the_scan_task(spark, name):
    """part is one file of few bytes, but a grader takes much time a row: its rows are dealt over all cores."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
