"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselar.llm import conversation_repair, divergence, jaccard_join, jpeg_media, packing, poisson_mix, quality, simhash, substring_dedup, suffix_dedup, suffix_tree, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_suffix_tree": suffix_tree.op1_lm_suffix_tree,
        "op2_toxicity_fm": toxicity.op2_toxicity_fm,
        "op3_compression_quality": quality.op3_compression_quality,
        "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
        "op5_simhash_fingerprints": simhash.op5_simhash_fingerprints,
        "op6_bin_completion_packing": packing.op6_bin_completion_packing,
        "op7_url_filters": url_filter.op7_url_filters,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_poisson_mix": poisson_mix.op9_poisson_mix,
        "op10_jpeg_media": jpeg_media.op10_jpeg_media,
        "op11_suffix_array_dedup": suffix_dedup.op11_suffix_array_dedup,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": jaccard_join.SQL,
        "op7_url_filters": url_filter.SQL,
        "op8_substring_dedup": substring_dedup.SQL,
        "op9_poisson_mix": poisson_mix.SQL,
        "op12_conversation_repair": conversation_repair.SQL,
        "op13_source_divergence": divergence.SQL,
    }
