"""Thinning in rounds against going through the lines by strength."""

import random

from pyspark.sql import functions as F

from attestry.operators import assess, scope


def greedy(lines):
    kept = []
    for value, line in sorted(lines, key=lambda x: (-x[0], x[1])):
        if all(abs(line - k) > assess.NEAR_LINES for _, k in kept):
            kept.append((value, line))
    return {(line, value) for value, line in kept}


def test_rounds_equal_the_greedy_order(spark):
    rng = random.Random(3)
    files = {f"f{n}": {(rng.choice([0.6, 0.7, 0.8, 0.9, 0.95]), line) for line in rng.sample(range(1, 400), 120)} for n in range(4)}
    files["steps"] = {(0.99 - line / 1000, line) for line in range(1, 120, 3)}
    files["seam"] = {(0.6 + (line % 7) / 100, line) for line in range(4060, 4140)}
    rows = [("a", f, "c", line, value, 0.0) for f, lines in files.items() for value, line in lines] + [("a", "f0", "c", 50, 0.99, 0.9), ("a", "f0", "c", 60, 0.1, 0.0)]
    got = assess.thin_lines(spark.createDataFrame(rows, "snapshot string, path string, check_id string, line int, value double, dismissed double"))
    found = {}
    for r in got.collect():
        found.setdefault(r.path, set()).add((r.line, r.value))
    one = {f: {(v, line) for v, line in {line: max(v for v, x in lines if x == line) for _, line in lines}.items()} for f, lines in files.items()}
    assert found == {f: greedy({(v, line) for line, v in pairs}) for f, pairs in one.items()}
    assert assess.thin_lines(got.withColumn("dismissed", F.lit(0.0)).limit(0)).collect() == []


def test_nearest_folder_by_equality(spark):
    files = spark.createDataFrame([("x", "src/a/b.ts"), ("x", "src/ab.ts"), ("y", "src/a/b.ts"), ("x", "/src/c.ts")], "checkout string, file string")
    folders = spark.createDataFrame([("x", "src"), ("x", "src/a/"), ("x", "src/a/b.ts"), ("x", "src/a/b"), ("y", "other"), ("x", "")], "checkout string, root string")
    got = {(r.checkout, r.file, r.root) for r in scope.holders(files, folders, "root").collect()}
    assert got == {("x", "src/a/b.ts", "src"), ("x", "src/a/b.ts", "src/a/"), ("x", "src/a/b.ts", "src/a/b.ts"), ("x", "src/ab.ts", "src"), ("x", "/src/c.ts", "")}


def test_rounds_join_nothing(spark, monkeypatch):
    """Rounds written out compress well; joined with their neighbours they were sent whole to the driver."""
    landed = []
    monkeypatch.setattr(assess, "landed", lambda df, land=assess.landed: landed.append(df._jdf.queryExecution().executedPlan().toString()) or land(df))
    rows = [("a", None if line % 2 else "f", "c", line, 0.99 - line / 1000, 0.0) for line in range(1, 240)]
    got = assess.thin_lines(spark.createDataFrame(rows, "snapshot string, path string, check_id string, line int, value double, dismissed double"))
    expected = [(path, line) for path, start in ((None, 1), ("f", 2)) for line in sorted(line for line, _ in greedy({(0.99 - line / 1000, line) for line in range(start, 240, 2)}))]
    assert sorted(((r.path, r.line) for r in got.collect()), key=lambda x: (x[0] or "", x[1])) == expected
    assert len(landed) > 1 and not any("Join" in plan for plan in landed)
