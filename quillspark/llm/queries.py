"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, html_extraction, language_id, license_scan, minhash_dedup, mixing, pii, quality_rules, substring_dedup, url_filter
from quillspark.llm.common import finished

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": finished(substring_dedup.query),
    "op2_minhash_dedup": finished(minhash_dedup.query),
    "op3_language_id": language_id.query,
    "op4_mixing": finished(mixing.query),
    "op5_pii": pii.query,
    "op6_html_extraction": html_extraction.query,
    "op7_url_filter": finished(url_filter.query),
    "op8_license_scan": license_scan.query,
    "op9_quality_rules": finished(quality_rules.query),
    "op10_decontamination": decontamination.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_minhash_dedup": minhash_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
}
