"""Registered queries: each pairs a Spark plan with an independently written oracle."""
