"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, collocations, exact_dedup, html_text, language_id, mixing, ngram_join, packing, pii, quality, resampling, substring_dedup, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1,
    "op2_html_text": html_text.op2,
    "op3_source_mixing": mixing.op3,
    "op4_suffix_array_dedup": substring_dedup.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_ann": ann.op6,
    "op7_language_id": language_id.op7,
    "op8_toxicity": toxicity.op8,
    "op9_quality": quality.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_collocations": collocations.op11,
    "op12_personal_data": pii.op12,
    "op13_importance_resampling": resampling.op13,
}

SQL = {
    "op1_ngram_jaccard": ngram_join.OP1_SQL,
    "op3_source_mixing": mixing.OP3_SQL,
    "op4_suffix_array_dedup": substring_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
