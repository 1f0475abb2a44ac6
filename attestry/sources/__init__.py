"""Scans and sinks: evidence JSON, LCOV, diffs, assessment snapshots, report formats."""
