"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry_points
from attestry.plans.catalog import load


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_an_oracle_or_a_brute_force_test():
    assert set(load()) - set(entry_points.oracle_sql()) == {"minimised_tests"}


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_points.__file__.rsplit("/", 1)[0], timeout=120)
