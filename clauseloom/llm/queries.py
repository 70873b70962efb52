"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.llm import decontam, licenses, line_templates, oracles, packing, quality, simhash, suffix_tree, surrogates, tokencount, wrapper
from clauseloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality.op1_quality_rules(table(s, d, "documents")),
        "op2_license_scan": lambda s, d: licenses.op2_license_scan(table(s, d, "documents")),
        "op3_line_templates": lambda s, d: line_templates.op3_line_templates(table(s, d, "documents")),
        "op4_wrapper_induction": lambda s, d: wrapper.op4_wrapper_induction(table(s, d, "pages")),
        "op5_decontamination": lambda s, d: decontam.op5_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_pii_surrogates": lambda s, d: surrogates.op6_pii_surrogates(table(s, d, "documents")),
        "op7_suffix_tree": lambda s, d: suffix_tree.op7_suffix_tree(table(s, d, "documents")),
        "op8_token_counts": lambda s, d: tokencount.op8_token_counts(table(s, d, "documents")),
        "op9_simhash": lambda s, d: simhash.op9_simhash(table(s, d, "documents")),
        "op10_packing": lambda s, d: packing.op10_packing(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.quality_sql(),
        "op2_license_scan": oracles.licenses_sql(),
        "op3_line_templates": oracles.line_templates_sql(),
        "op5_decontamination": oracles.decontamination_sql(),
    }
