"""A directory's coverage of one metric takes what that metric counts and no more."""

from attestry.operators import gaps

HIT = "run_id string, test_id string, hit_id string, seq long"


def test_lines_by_kind_leave_branches_and_vectors_alone(spark):
    points = spark.createDataFrame(
        [("r", f"p{i}", "statement", "a/b/f" if i < 3 else "a/c/g", i, i == 2) for i in range(6)], "run_id string, id string, kind string, file string, line int, declined boolean")
    branches = spark.createDataFrame([("r", "b", "if", "b:t", "a/b/f", 77, False)], "run_id string, branch_id string, kind string, id string, file string, line int, declined boolean")
    decisions = spark.createDataFrame([("r", "d", 1, "a/b/f", 1, 1, False)], "run_id string, id string, conditions int, file string, line int, col int, declined boolean")
    hits = spark.createDataFrame([("r", "u", "p0", 1), ("r", "e", "p0", 2), ("r", "e", "p3", 3), ("r", "w", "p4", 4), ("r", "u", "b:t", 5)], HIT)
    vectors = spark.createDataFrame([("r", "u", "d", 1, True, [True])], "run_id string, test_id string, decision_id string, seq long, outcome boolean, vals array<boolean>")
    tests = spark.createDataFrame([("r", "u", "unit", "test", "exact"), ("r", "e", "e2e", "test", "exact"), ("r", "w", "unit", "test", "run-wide")],
                                  "run_id string, test_id string, kind string, role string, attribution string")
    got = gaps.areas_by_kind(points, branches, decisions, hits, vectors, tests, 2)
    rows = {(r.directory, r.group): (r.files, r.total, r.covered) for r in got.collect()}
    assert rows == {
        ("a/b", "any"): (1, 2, 1), ("a/b", "unit"): (1, 2, 1), ("a/b", "e2e"): (1, 2, 1), ("a/b", "(all tests)"): (1, 2, 1),
        ("a/c", "any"): (1, 3, 2), ("a/c", "e2e"): (1, 3, 1), ("a/c", "(all tests)"): (1, 3, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "vals" not in plan and "logical-value" not in plan.replace("= logical-value", "")
    conditions = gaps.areas_by_kind(points, branches, decisions, hits, vectors, tests, 2, "conditions")
    assert {(r.directory, r.group): (r.total, r.covered) for r in conditions.collect()}["a/b", "any"] == (1, 0)
