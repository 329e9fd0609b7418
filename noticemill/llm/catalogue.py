"""Registered queries of the training-data operators, and SQL where it can express them."""

from . import (
    fill_middle,
    language_id,
    line_dedup,
    lm_scoring,
    near_dedup,
    packing,
    phrases,
    pieces,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    top_k,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_packing": packing.op5_packing,
    "op6_pieces": pieces.op6_pieces,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_top_k": top_k.op10_top_k,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_language_id": language_id.op12_language_id,
    "op13_collocations": phrases.op13_collocations,
}
ORACLE = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op10_top_k": top_k.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
