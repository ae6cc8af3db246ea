"""The queries and the SQL of this subpackage."""

from __future__ import annotations

from . import ann, chat_format, jaccard_join, language_model, merkle, mixing, packing, quality_model, quality_rules, suffix_dedup, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_prefix_forest": ann.op4_prefix_forest,
        "op5_mix": mixing.op5_mix,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_language_model": language_model.op7_language_model,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_whitening": whitening.op12_whitening,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.oracle(),
        "op3_quality_rules": quality_rules.oracle(),
        "op8_jaccard_join": jaccard_join.oracle(),
        "op10_suffix_dedup": suffix_dedup.oracle(),
        "op13_merkle_manifest": merkle.oracle(),
    }
