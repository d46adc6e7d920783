"""Queries of the corpus operators and their SQL twins."""

from . import decontaminate, fill_in_middle, language, lm_scoring, mixing, near_duplicates, quality_knn, quality_rules, resampling, secrets, simhash, substrings, token_counts

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_ngram_jaccard_join": near_duplicates.op4_ngram_jaccard_join,
    "op5_quality_classifier": quality_knn.op5_quality_classifier,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language.op8_language_id,
    "language_id_pages": language.language_id_pages,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
}
ORACLE = {
    "op1_secret_scans": secrets.OP1_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op4_ngram_jaccard_join": near_duplicates.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
}
