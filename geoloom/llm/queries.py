"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from geoloom.llm import decontaminate, line_dedup, lm_score, mixing, ngram_join, secret_scan, suffix_dedup, toxicity, url_filter, winnow

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_decontaminate": decontaminate.query,
    "op3_secret_scan": secret_scan.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_winnow_fingerprints": winnow.query,
    "op7_line_dedup": line_dedup.query,
    "op8_ngram_join": ngram_join.query,
    "op9_mixing": mixing.query,
    "op10_url_filter": url_filter.query,
}

ORACLE_SQL = {
    "op3_secret_scan": secret_scan.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_winnow_fingerprints": winnow.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
