"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import embeddings, mixing, ngrams, pieces, quality, simhash, suffixes, token_counts, token_files, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_token_counts": token_counts.op2_token_counts,
    "op7_quality_rules": quality.op7_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op10_warc": warc.op10_warc,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op6_token_files": token_files.op6_token_files,
    "op5_lm_scores": ngrams.op5_lm_scores,
    "quality_base_figures": quality.quality_base_figures,
}
ORACLE_SQL: dict[str, str] = {"op3_embedding_near_dedup": embeddings.ORACLE, "op10_warc": warc.ORACLE, "op4_mixing": mixing.ORACLE, "op8_suffix_dedup": suffixes.ORACLE, "quality_base_figures": quality.BASE_ORACLE}
