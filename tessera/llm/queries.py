"""Queries and SQL of this subpackage, for the entry file."""

from __future__ import annotations

from . import op1_url, op10_licenses, op2_decontaminate, op3_simhash, op4_langid, op5_linededup, op6_mix, op7_lm, op8_spotsigs, op9_substrings

QUERIES = {
    "op1_url_filter": op1_url.query,
    "op2_benchmark_decontamination": op2_decontaminate.query,
    "op3_simhash_near_dedup": op3_simhash.query,
    "op4_language_id": op4_langid.query,
    "op5_line_dedup": op5_linededup.query,
    "op6_mix_sources": op6_mix.query,
    "op7_lm_scoring": op7_lm.query,
    "op8_document_fingerprints": op8_spotsigs.query,
    "op9_substring_dedup": op9_substrings.query,
    "op10_license_scan": op10_licenses.query,
    "similar_fingerprints": op8_spotsigs.similar_query,
}

ORACLES = {
    "op1_url_filter": op1_url.ORACLE,
    "op2_benchmark_decontamination": op2_decontaminate.ORACLE,
    "op5_line_dedup": op5_linededup.ORACLE,
    "op6_mix_sources": op6_mix.ORACLE,
    "op8_document_fingerprints": op8_spotsigs.ORACLE,
    "op9_substring_dedup": op9_substrings.ORACLE,
    "similar_fingerprints": op8_spotsigs.SIMILAR_ORACLE,
}
