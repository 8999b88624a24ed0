"""Queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, html_extract, license_scan, mixing, near_dedup, packing, periodic_runs, records, token_counts, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_records": records.op11_token_records,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op3_mix_sources": mixing.SQL,
    "op5_url_filter": url_filter.SQL,
    "op9_license_scan": license_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
