"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, chat, collocations, context_mixing, exact_dedup, language_id, line_dedup, mixing, ngram_join, periodic_runs, quality, substring_dedup, token_counts

QUERIES = {
    "op1_bpe_encode_decode": bpe.query,
    "op2_quality": quality.query,
    "op3_line_dedup": line_dedup.query,
    "op4_mixing": mixing.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_lm_score": context_mixing.query,
    "op7_token_counts": token_counts.query,
    "op8_chat_windows": chat.query,
    "op9_ngram_join": ngram_join.query,
    "op10_language_id": language_id.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_collocations": collocations.query,
    "language_id_pages": language_id.page_query,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_chat_windows": chat.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
    "op12_substring_dedup": substring_dedup.SQL,
    "op13_collocations": collocations.SQL,
}
