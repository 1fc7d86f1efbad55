"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, dedup_exact, html_text, jaccard_join, licenses, merkle, near_vectors, substrings, token_files, toxicity, url_filter

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_exact_dedup": dedup_exact.op6_exact_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_near_vectors": near_vectors.op12_near_vectors,
    "op13_alignment": alignment.op13_alignment,
}

SQL = {
    "op2_url_filter": url_filter.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_exact_dedup": dedup_exact.SQL,
    "op11_merkle": merkle.SQL,
    "op12_near_vectors": near_vectors.SQL,
}
