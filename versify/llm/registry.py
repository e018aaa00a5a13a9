"""Queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("packing", "url_filter", "mixing", "ann_forest", "quality", "secret_scan", "hmm_lm", "site_style", "jaccard_join", "cdc_fingerprint", "periodic_runs", "hard_negatives", "piece_bpe")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"versify.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
