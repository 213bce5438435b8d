"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from graphweave.llm import ann, bpe, chat, language, lines, lm, middle, near_dup, packing, quality, rules, spelling, substrings

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_near_duplicates": near_dup.op2_near_duplicates,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_suffix_array_dedup": substrings.op5_suffix_array_dedup,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_chat_format": chat.op8_chat_format,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_fill_in_middle": middle.op11_fill_in_middle,
    "op12_language_id": language.op12_language_id,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op3_line_dedup": lines.OP3_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op10_quality_rules": rules.OP10_SQL,
    "op11_fill_in_middle": middle.OP11_SQL,
}
