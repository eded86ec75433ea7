"""Registered queries: each module registers one family of the inventory on import."""

from __future__ import annotations

import importlib

MODULES = [
    "sources_q", "filters_q", "joins_q", "series_q", "candles_q", "stats_q", "sessions_q", "features_q", "rules_q", "scans_q", "backtest_q", "models_q",
]


def load_entries():
    from .registry import ENTRIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return ENTRIES
