"""What is told of a line."""

from attestry.operators import detail


def test_line_detail_counts_what_no_kind_names(spark):
    points = spark.createDataFrame(
        [("r", "p1", "a.ts", 1, False), ("r", "p2", "a.ts", 1, True), ("r", "p3", "a.ts", 2, True)], "run_id string, id string, file string, line int, declined boolean")
    hits = spark.createDataFrame([("r", "t1", "p1"), ("r", "t1", "p1"), ("r", "t2", "p1"), ("r", "t2", "p3")], "run_id string, test_id string, hit_id string")
    tests = spark.createDataFrame([("r", "t1", "n", "unit", "x"), ("r", "t2", "n", "unit", "x")], "run_id string, test_id string, name string, kind string, runner string")
    noted = spark.createDataFrame(
        [("r", "l1", None, "a.ts", 1, None), ("r", "l2", "source-scope", "a.ts", 1, None), ("r", "l3", "macro", "a.ts", 9, None)],
        "run_id string, id string, kind string, file string, line int, source string")
    states = spark.createDataFrame(
        [("r", "statements", "p1", "a.ts", 1, False), ("r", "lines", "a.ts:1", "a.ts", 1, False), ("r", "branches", "b", "a.ts", 7, False)],
        "run_id string, metric string, id string, file string, line int, covered boolean")
    told = detail.line_detail(points, hits, tests, noted, states).select("line", "measured", "tests", "kinds", "limitations", "open")
    assert sorted(tuple(row) for row in told.collect()) == [(1, True, 2, 1, 2, 1), (2, False, 0, 0, 1, 0)]
