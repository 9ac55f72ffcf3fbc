"""All registered queries, by theme."""

from __future__ import annotations

import importlib

THEMES = ["catalog_queries", "track_queries", "series_queries", "frame_queries", "region_queries", "source_queries", "job_queries"]


def load():
    for theme in THEMES:
        importlib.import_module(f"twinline.suite.{theme}")
    from twinline.suite.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
