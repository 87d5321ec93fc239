"""Queries of this folder and their SQL."""

from panelforge.llm import decontamination, exact_dedup, html_extract, language_id, line_strip, near_dedup, packing, periodic_runs, secret_scan, substring_dedup, token_store, toxicity, url_filter

MODULES = (language_id, packing, html_extract, exact_dedup, url_filter, secret_scan, toxicity, decontamination, token_store, near_dedup, substring_dedup, line_strip, periodic_runs)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
