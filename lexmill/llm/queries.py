"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lexmill.llm import decontamination, html_extraction, language_id, line_dedup, media, merkle, mixing, quality, resampling, simhash, suffix_dedup, token_output, url_filter

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_decontaminate": decontamination.op5_decontaminate,
    "op6_token_output": token_output.op6_token_output,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_decontaminate": decontamination.OP5_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_url_filter": url_filter.OP12_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
