"""What is left open is told of every metric."""

from attestry.operators import gaps
from attestry.plans.catalog import load
from tests.conftest import SMALL


def test_open_obligations_are_of_every_metric(spark):
    metrics = {row["metric"] for row in load()["open_obligations"](spark, SMALL).select("metric").distinct().collect()}
    assert metrics == set(gaps.WEIGHTS)


def test_group_gaps_are_of_every_metric(spark):
    metrics = {row["metric"] for row in load()["group_gaps"](spark, SMALL).select("metric").distinct().collect()}
    assert metrics == set(gaps.WEIGHTS)
