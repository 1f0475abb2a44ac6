"""Imports every module that registers queries."""

from attestry.plans import assess_queries, coverage_queries, detail_queries, impact_queries, runs_queries, source_queries, streaming_queries, timing_queries  # noqa: F401
