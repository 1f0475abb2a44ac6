"""Hand rows for attempts: expected failures, flakiness, unstarted tests."""

import pytest

from attestry.operators import attempts, selection
from attestry.operators.selection import TestFilter as Criteria

SCHEMA = "run_id string, test_id string, retry int, status string, expected_status string, flaky boolean, attribution string, role string, seq long"


def records(spark, rows):
    return spark.createDataFrame([("r", *row[:4], row[4] if len(row) > 4 else False, "exact", "test", seq) for seq, row in enumerate(rows)], SCHEMA)


ROWS = [
    ("passes", 0, "passed", None), ("retried", 0, "failed", None), ("retried", 1, "passed", None), ("told", 0, "passed", None, True),
    ("inverted", 0, "failed", "failed"), ("broken", 0, "passed", "failed"), ("sticky", 0, "failed", None), ("sticky", 0, "passed", None),
    ("unknown", 0, "passed", None), ("unknown", 0, "unknown", None), ("never", None, "unstarted", None), ("silent", None, None, None),
    ("late", 0, "passed", None), ("late", 1, "failed", None),
]


def test_outcomes(spark):
    got = {r.test_id: r.outcome for r in attempts.outcomes(records(spark, ROWS)).collect()}
    assert got == {
        "passes": "passed", "retried": "flaky", "told": "flaky", "inverted": "passed", "broken": "failed", "sticky": "failed",
        "unknown": "passed", "never": "unstarted", "silent": "unknown", "late": "failed",
    }


def test_views(spark):
    frame = records(spark, ROWS)
    passed = {(r.test_id, r.retry) for r in attempts.view(frame, "passed").collect()}
    failed = {(r.test_id, r.retry) for r in attempts.view(frame, "failed").collect()}
    assert passed == {("passes", 0), ("retried", 1), ("told", 0), ("sticky", 0), ("unknown", 0)}
    assert failed == {("retried", 0), ("broken", 0), ("sticky", 0), ("late", 1)}
    with pytest.raises(ValueError):
        attempts.view(frame, "some")


def test_companion_records_do_not_decide(spark):
    frame = records(spark, [("t", 0, "failed", "failed"), ("t", 0, "failed", None)])
    assert attempts.view(frame, "failed").count() == 0


def test_empty_filters_are_errors(spark):
    tests = spark.createDataFrame([("r", "t", "adds", "Adds", "tests/a.ts", "unit", "vitest", "test", ["@Api"])],
                                  "run_id string, test_id string, name string, title string, test_file string, kind string, runner string, role string, tags array<string>")
    assert selection.picked_tests(tests, Criteria(tags=["api"], files=["./tests/"])).count() == 1
    with pytest.raises(selection.NoMatch):
        selection.require_rows(selection.picked_tests(tests, Criteria(tags=["!api"])), "--tag !api")
    files = spark.createDataFrame([("src/a.ts",), ("src/a.tsx",), ("lib/b.ts",)], "file string")
    assert selection.select_source_file(files, "src/a.ts") == "src/a.ts"
    assert selection.select_source_file(files, "b.ts") == "lib/b.ts"
    with pytest.raises(selection.Ambiguous):
        selection.select_source_file(files, "/a.")
    with pytest.raises(selection.NoMatch):
        selection.select_source_file(files, "zzz")
