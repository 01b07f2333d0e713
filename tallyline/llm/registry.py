"""The queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyline.llm import exact_dedup, language_id, license_scan, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_exact_top_k": topk_search.op9_exact_top_k,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.sql(), "op2_substring_dedup": substring_dedup.SQL, "op3_ngram_jaccard_join": ngram_join.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_mix_sources": mixing.SQL, "op9_exact_top_k": topk_search.SQL}
