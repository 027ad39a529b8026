"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from . import chat_format, fill_in_middle, language_id, language_model, mixing, nearest, packing, periodic_runs, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_nearest_neighbours": nearest.op1_nearest_neighbours,
        "op2_simhash": simhash.op2_simhash,
        "op3_language_model": language_model.op3_language_model,
        "op4_language_id": language_id.op4_language_id,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_packing": packing.op6_packing,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "quality_ablations": quality_rules.quality_ablations,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict:
    return {
        "op7_substring_dedup": substring_dedup.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op9_chat_format": chat_format.ORACLE_SQL,
        "op10_quality_rules": quality_rules.ORACLE_SQL,
        "quality_ablations": quality_rules.ABLATIONS_SQL,
        "op11_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    }
