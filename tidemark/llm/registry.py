"""Registered queries of this package, by name, and the SQL that DuckDB checks them with."""

from tidemark.llm import bpe, html_extract, line_dedup, mixing, multi_index, near_vectors, ngram_join, passage_dedup, phrases, quality, quality_rules, token_counts, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_passage_dedup": passage_dedup.op3_passage_dedup,
    "op4_html": html_extract.op4_html,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_vectors": near_vectors.op6_near_vectors,
    "op7_mixing": mixing.op7_mixing,
    "op8_multi_index": multi_index.op8_multi_index,
    "op9_bpe": bpe.op9_bpe,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_whitening": whitening.op12_whitening,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
