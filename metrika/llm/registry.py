"""Queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from . import decontaminate, event_patterns, jaccard_join, language, packing, quality, secret_scan, sentence_pieces, substrings, token_files, toxicity, warc, whitening

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_quality_rules": quality.query,
    "op4_substring_dedup": substrings.query,
    "op5_token_files": token_files.query,
    "op6_warc": warc.query,
    "op7_decontamination": decontaminate.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_language_id": language.query,
    "op10_secret_scans": secret_scan.query,
    "op11_sentence_pieces": sentence_pieces.query,
    "op12_event_patterns": event_patterns.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": warc.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op12_event_patterns": event_patterns.ORACLE,
}
