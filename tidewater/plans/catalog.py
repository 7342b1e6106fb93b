"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

import importlib

from tidewater.plans.registry import QUERIES, SQL

_MODULES = ["q_curation", "q_features", "q_kpi", "q_quality", "q_io", "q_docs", "q_ml", "q_stream"]


def load() -> tuple[dict, dict]:
    for m in _MODULES:
        importlib.import_module(f"tidewater.plans.{m}")
    return QUERIES, SQL
