"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import alignment, bpe_bytes, html_wrappers, language_id, line_dedup, media, packing, periodic_runs, pii, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_media_columns": media.query,
    "op3_html_wrappers": html_wrappers.query,
    "op4_simhash": simhash.query,
    "op6_top_k": topk.query,
    "op7_line_dedup": line_dedup.query,
    "op8_kd_sharding": sharding.query,
    "op9_language_id": language_id.query,
    "op10_pii": pii.query,
    "op5_byte_bpe": bpe_bytes.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_alignment": alignment.query,
    "op13_toxicity": toxicity.query,
}

ORACLES: dict[str, str] = {
    "op6_top_k": topk.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
