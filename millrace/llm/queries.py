"""The queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, importance, jaccard, lengths, linededup, mixing, packing, pii, quality, sortmeans, toxicity, warc

QUERIES = {
    "op1_personal_data": pii.op1,
    "op2_toxicity": toxicity.op2,
    "op3_token_counts": lengths.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_chat_formatting": chat.op5,
    "op6_nearest_neighbours": ann.op6,
    "op7_mix_sources": mixing.op7,
    "op8_ngram_jaccard": jaccard.op8,
    "op9_warc_archive": warc.op9,
    "op10_quality_rules": quality.op10,
    "op11_line_dedup": linededup.op11,
    "op12_importance_resampling": importance.op12,
    "op13_centroid_clustering": sortmeans.op13,
}
SQL = {"op5_chat_formatting": chat.SQL, "op7_mix_sources": mixing.SQL, "op9_warc_archive": warc.SQL, "op11_line_dedup": linededup.SQL, "op12_importance_resampling": importance.SQL, "op13_centroid_clustering": sortmeans.SQL}
