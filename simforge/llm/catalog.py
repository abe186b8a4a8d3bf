"""Queries of the training-data operators, with DuckDB SQL where it can express them.

Without SQL are those that need a tokenizer, iterate (Newton steps, links over several
documents, expectation-maximisation) or test binomial tails; tests/llm compares them with
brute force, round trips or bounds.
"""

from __future__ import annotations

import corpus_pipeline
from simforge.llm import chat_windows, line_dedup, mixing, ngram_join, packing, pii, quality_rules, revisits, spelling, substring_dedup, token_files, topk, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_revisits": revisits.op6_revisits,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_token_files": token_files.op9_token_files,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_chat_windows": chat_windows.op12_chat_windows,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op6_revisits": revisits.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
