"""Queries of the library over the bound tables."""

import importlib

MODULES = ("cohort_queries", "lab_queries", "outcome_queries", "feature_queries", "metric_queries", "region_queries", "shift_queries", "summary_queries", "source_queries", "model_queries")


def load_all() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")
