"""Imports every module of queries, so that the registry is full."""

from __future__ import annotations

import importlib

MODULES = ("profile_queries", "window_queries", "text_queries", "join_queries", "stat_queries", "decision_queries", "scan_queries", "layout_queries", "document_queries", "source_queries", "tex_queries", "frame_queries", "trace_queries", "dim_queries", "index_queries", "template_queries", "page_rule_queries", "record_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"foliometry.plans.{name}")
