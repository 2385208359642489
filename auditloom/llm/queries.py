"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import compression_quality, decontamination, embedding_dedup, fill_middle, filter_audit, html_extraction, language_model, mixing, near_dedup, quality_rules, surrogates, token_counts, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_language_model": language_model.op6_language_model,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_compression_quality": compression_quality.op8_compression_quality,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_mixing": mixing.op10_mixing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

ORACLES = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
