"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fim, html_crf, lm, near_dedup, piece_bpe, quality, resample, suffix_dedup, toxicity, urls

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_html_extraction": html_crf.op3_html_extraction,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": urls.op6_url_filter,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_piece_bpe": piece_bpe.op12_piece_bpe,
    "op13_importance_resampling": resample.op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op13_importance_resampling": resample.ORACLE}
