"""The registered queries of this subpackage, each with its SQL or None."""

from __future__ import annotations

from corpusgate.llm import (
    chat,
    codes,
    decontaminate,
    exact,
    licenses,
    metric,
    packing,
    quality,
    recompression,
    resampling,
    simhash,
    suffixdedup,
    toxicity,
)

QUERIES = {
    "op1_benchmark_decontamination": (decontaminate.op1_benchmark_decontamination, decontaminate.OP1_SQL),
    "op2_best_fit_packing": (packing.op2_best_fit_packing, None),
    "op3_suffix_array_dedup": (suffixdedup.op3_suffix_array_dedup, None),
    "op4_exact_dedup": (exact.op4_exact_dedup, exact.OP4_SQL),
    "op5_license_scan": (licenses.op5_license_scan, licenses.OP5_SQL),
    "op6_toxicity": (toxicity.op6_toxicity, None),
    "op7_simhash_dedup": (simhash.op7_simhash_dedup, None),
    "op8_substring_dedup": (recompression.op8_substring_dedup, recompression.OP8_SQL),
    "op9_quality_classifier": (quality.op9_quality_classifier, None),
    "op10_chat_formatting": (chat.op10_chat_formatting, chat.OP10_SQL),
    "op11_jaccard_join": (metric.op11_jaccard_join, metric.OP11_SQL),
    "op12_vector_codes": (codes.op12_vector_codes, codes.OP12_SQL),
    "op13_importance_resampling": (resampling.op13_importance_resampling, None),
}
