"""Test-evidence analytics as Spark DataFrame jobs."""
