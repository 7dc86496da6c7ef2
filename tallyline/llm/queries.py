"""Registered queries of this package and, where SQL can express the result, their SQL."""

from __future__ import annotations

from tallyline.llm import (
    divergence,
    fill_middle,
    license_scan,
    line_chunks,
    ngram_join,
    packing,
    pii_crf,
    piece_rounds,
    pivot_search,
    secret_ledger,
    token_cache,
    turn_repair,
    url_models,
)

QUERIES = {
    "op1_url_model_ratio": url_models.query,
    "op2_harmonic_packing": packing.query,
    "op3_piece_rounds": piece_rounds.query,
    "op4_line_chunks": line_chunks.query,
    "op5_personal_data": pii_crf.query,
    "op6_pivot_search": pivot_search.query,
    "op7_divergence_rules": divergence.query,
    "op8_license_scan": license_scan.query,
    "op9_ngram_join": ngram_join.query,
    "op10_token_counts": token_cache.query,
    "op11_secret_ledger": secret_ledger.query,
    "op12_fill_in_middle": fill_middle.query,
    "op13_turn_repair": turn_repair.query,
}
ORACLES: dict[str, str] = {
    "op4_line_chunks": line_chunks.ORACLE,
    "op6_pivot_search": pivot_search.ORACLE,
    "op7_divergence_rules": divergence.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op11_secret_ledger": secret_ledger.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
}
