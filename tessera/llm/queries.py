"""The operators' queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, html_extract, line_dedup, mixing, ngram_join, sharding, suffix_dedup, tiff, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": byte_bpe.query,
        "op2_tiff_media": tiff.query,
        "op3_kmeans_tree": ann.query,
        "op4_label_propagation": sharding.query,
        "op5_source_mixing": mixing.query,
        "op6_ngram_join": ngram_join.query,
        "op7_toxicity": toxicity.query,
        "op8_html_extract": html_extract.query,
        "op9_line_winnowing": line_dedup.query,
        "op10_suffix_dedup": suffix_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
