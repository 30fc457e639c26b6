"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import contracts as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": C.near_dedup,
    "op2_quality_classifier": C.quality_classifier,
    "op3_language_id": C.language_id,
    "op4_best_fit_packing": C.best_fit_packing,
    "op5_benchmark_decontamination": C.benchmark_decontamination,
    "op6_lm_scoring": C.lm_scoring,
    "op7_substring_dedup": C.substring_dedup,
    "op8_line_dedup": C.line_dedup,
    "op9_token_counts": C.token_counts,
    "op10_quality_rules": C.quality_rules,
    "op11_toxicity": C.toxicity_scores,
    "op12_ranked_search": C.ranked_search,
    "op13_conversation_repair": C.conversation_repair,
}

ORACLES: dict[str, str] = C.ORACLES
