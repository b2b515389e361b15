"""Queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm import decontaminate, divergence, exact_dedup, html_text, language, line_dedup, near_dedup, packing, pii, quality, resampling, secrets, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_language": language.query,
        "op3_near_dedup": near_dedup.query,
        "op4_html_text": html_text.query,
        "op5_sharding": sharding.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_decontamination": decontaminate.query,
        "op8_secrets": secrets.query,
        "op9_packing": packing.query,
        "op10_pii": pii.query,
        "op11_source_divergence": divergence.query,
        "op12_line_dedup": line_dedup.query,
        "op13_importance_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": sharding.oracle(),
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
