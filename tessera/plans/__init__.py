"""The catalogue of queries: operators applied to the projected tables."""

from __future__ import annotations

import importlib

MODULES = ("graph_queries", "ledger_queries", "git_queries", "text_queries", "stream_queries", "misc_queries", "extract_queries", "answer_queries", "build_queries")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
