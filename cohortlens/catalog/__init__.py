"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Query

MODULES = ("q_cohort", "q_sources", "q_features", "q_models", "q_metrics", "q_results", "q_curves", "q_summaries")


def load_all() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
