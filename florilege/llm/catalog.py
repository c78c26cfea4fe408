"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from florilege.llm import op1_packing, op2_extraction, op3_line_dedup, op4_suffix_dedup, op5_substring_dedup, op6_pii, op7_quality, op8_decontamination, op9_toxicity, op10_jaccard_join, op11_licences, op12_fill_in_middle, op13_conversation_repair

QUERIES = {
    "op1_packing": op1_packing.query,
    "op2_extraction": op2_extraction.query,
    "op3_line_dedup": op3_line_dedup.query,
    "op4_suffix_dedup": op4_suffix_dedup.query,
    "op5_substring_dedup": op5_substring_dedup.query,
    "op6_pii": op6_pii.query,
    "op7_quality": op7_quality.query,
    "op8_decontamination": op8_decontamination.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_jaccard_join": op10_jaccard_join.query,
    "op11_licences": op11_licences.query,
    "op12_fill_in_middle": op12_fill_in_middle.query,
    "op13_conversation_repair": op13_conversation_repair.query,
}
ORACLE = {
    "op5_substring_dedup": op5_substring_dedup.ORACLE,
    "op8_decontamination": op8_decontamination.ORACLE,
    "op10_jaccard_join": op10_jaccard_join.ORACLE,
    "op12_fill_in_middle": op12_fill_in_middle.ORACLE,
}
