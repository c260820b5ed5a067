"""Declared schemas of the canonical tables, as DDL that readers take."""

from __future__ import annotations

_MESSAGES = "array<struct<role:string,content:string>>"

SCHEMAS: dict[str, str] = {
    "rl_row": f"data_source string, prompt {_MESSAGES}, target {_MESSAGES}, ability string, reward_model struct<style:string,ground_truth:string>, extra_info struct<index:bigint,split:string,topic:string,difficulty:double>",
    "raw_problem": "question string, final_answer string, topic string, difficulty double, solution_1 string, solution_2 string, solution_3 string",
    "rollout": "uid string, k int, responses array<int>, attention_mask array<int>, prefix_mask array<boolean>, se_mask array<boolean>, token_level_scores array<double>, old_log_probs array<double>, ref_log_prob array<double>, values array<double>",
    "token": "uid string, k int, pos int, reward double, value double, logp double, old double, ref double, adv double, mask boolean, prefix boolean, se boolean, reward_mask boolean",
    "sft": "prompt string, response string",
    "preference": "prompt string, chosen string, rejected string",
    "corpus": "id string, contents string",
    "metrics": "step int, name string, value double",
}
