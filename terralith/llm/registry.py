"""Queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, html_text, jaccard_join, line_dedup, mixing, ngram_lm, substring_dedup, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_html_text": html_text.op6_html_text,
    "op7_ngram_lm": ngram_lm.op7_ngram_lm,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
