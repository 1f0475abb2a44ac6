"""Facts of decisions, packed or not, against the pairs themselves; what a summary reads and folds."""

import random
from itertools import combinations, product

from pyspark.sql import functions as F

from attestry.operators import coverage, gaps, mcdc

SCHEMA = "run_id string, test_id string, decision_id string, seq long, vals array<boolean>, outcome boolean"


def expected(seen):
    width = max(len(v) for v, _ in seen)
    shown = set()
    for (a, x), (b, y) in combinations(seen, 2):
        apart = [i for i, (p, q) in enumerate(zip(a, b)) if p is not None and q is not None and p != q]
        if x != y and len(apart) == 1:
            shown.add(apart[0])
    values = {(i, v) for vals, _ in seen for i, v in enumerate(vals) if v is not None}
    return len({o for _, o in seen}), len(values), sorted(shown), width


def test_facts_of_narrow_and_wide_decisions(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(120):
        width = [0, 1, 2, 3, 4, 70][d % 6]
        every = list(product((None, False, True), repeat=width)) if width < 5 else [tuple(rng.choice((None, False, True)) for _ in range(width)) for _ in range(3)]
        seen = {(rng.choice(every), rng.random() < 0.5) for _ in range(rng.randint(1, 9))}
        if width == 70:
            one = list(next(iter(seen))[0])
            one[69] = True
            seen |= {(tuple(one), True), (tuple([*one[:69], False]), False)}
        want[f"d{d}"] = expected(sorted(seen, key=repr))[:3]
        rows += [("r", "t", f"d{d}", i, list(v), o) for i, (v, o) in enumerate([*seen, *seen])]
    got = {r["decision_id"]: (r["outcomes_seen"], r["condition_values_seen"], list(r["shown"])) for r in mcdc.decision_facts(spark.createDataFrame(rows, SCHEMA), ["run_id"]).collect()}
    assert got == want


def test_a_wide_vector_meets_the_narrow_ones_of_its_decision(spark):
    rows = [("r", "t", "d", 1, [True, False], True), ("r", "t", "d", 2, [False, None, None, True], False), ("r", "t", "e", 1, [True], True)]
    got = {r["decision_id"]: (r["outcomes_seen"], r["condition_values_seen"], list(r["shown"])) for r in mcdc.decision_facts(spark.createDataFrame(rows, SCHEMA), ["run_id"]).collect()}
    assert got == {"d": (2, 4, [0]), "e": (1, 1, [])}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def frames(spark):
    points = spark.createDataFrame(
        [("r", "p1", "statement", "a", 1, False), ("r", "p2", "function", "a", 1, False), ("r", "p3", "statement", "b", None, False), ("r", "p4", "statement", "b", 2, True)],
        "run_id string, id string, kind string, file string, line int, declined boolean")
    branches = spark.createDataFrame([("r", "b1", "if", "a", 9, False), ("r", "b2", "logical-value", "b", 9, False)], "run_id string, id string, kind string, file string, line int, declined boolean")
    decisions = spark.createDataFrame([("r", "d", "a", 1, 0, 2, False), ("r", "e", "b", 1, 0, 1, False)], "run_id string, id string, file string, line int, col int, conditions int, declined boolean")
    hits = spark.createDataFrame([("r", "t", "p1"), ("r", "t", "p1"), ("r", "t", "b2"), ("r", "t", "x9"), ("r", "u", "p3")], "run_id string, test_id string, hit_id string")
    vectors = spark.createDataFrame([("r", "t", "d", 1, [True, True], True), ("r", "t", "d", 2, [False, None], False), ("r", "t", "z", 3, [True], True)], SCHEMA)
    return points, branches, decisions, hits, vectors


def test_a_runs_summary_counts_covered_and_total_in_one_pass(spark):
    points, branches, decisions, hits, vectors = frames(spark)
    rows = coverage.summary(points, branches, decisions, hits, vectors, ["run_id"])
    assert {r["metric"]: (r["covered"], r["total"]) for r in rows.collect()} == {
        "lines": (2, 2), "statements": (2, 2), "functions": (0, 1), "branches": (1, 2), "value_selections": (1, 1),
        "decision_outcomes": (2, 4), "condition_outcomes": (3, 6), "conditions": (1, 3)}
    by_file = coverage.summary(points, branches, decisions, hits, vectors, ["run_id"], by_file=True)
    assert {(r["file"], r["metric"]): (r["covered"], r["total"]) for r in by_file.filter("metric in ('lines', 'branches', 'conditions')").collect()} == {
        ("a", "lines"): (1, 1), ("b", "lines"): (1, 1), ("a", "branches"): (0, 1), ("b", "branches"): (1, 1), ("a", "conditions"): (1, 2), ("b", "conditions"): (0, 1)}
    # The manifest is read once, and no vector is ranked.
    assert len([line for line in plan(coverage.summary(points, branches, decisions, hits, vectors, ["run_id"], metrics=["lines"])).splitlines() if "LogicalRDD" in line]) == 2
    assert "row_number" not in plan(mcdc.decision_facts(vectors, ["run_id"]).select("outcomes_seen"))


def test_gaps_of_points_ask_for_nothing_else(spark):
    points, _, _, hits, _ = frames(spark)
    tests = spark.createDataFrame([("r", "t", "unit"), ("r", "u", "e2e")], "run_id string, test_id string, kind string")
    rows = gaps.group_gaps(points, None, None, hits, None, tests, "kind", metrics=["statements", "functions"])
    got = {(r["kind"], r["file"], r["metric"]): (r["uncovered"], r["total"], r["covered_by_other_tests"], r["uncovered_everywhere"]) for r in rows.collect()}
    assert got == {
        ("unit", "a", "statements"): (0, 1, 0, 0), ("unit", "a", "functions"): (1, 1, 0, 1), ("unit", "b", "statements"): (1, 1, 1, 0),
        ("e2e", "a", "statements"): (1, 1, 1, 0), ("e2e", "a", "functions"): (1, 1, 0, 1), ("e2e", "b", "statements"): (0, 1, 0, 0)}
