"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from fibra.llm import collocations, decontamination, language_id, line_dedup, lm_scoring, mixing, ngram_join, periodic_runs, quality_rules, sharding, simhash, token_file, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_file": token_file.op3_token_file,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_language_id": language_id.op8_language_id,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_simhash": simhash.op13_simhash,
}

ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op6_ngram_jaccard": ngram_join.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
}
