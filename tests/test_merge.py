"""Merging whole runs: fingerprints of tables, exact differences, united evidence."""

from attestry.operators import runs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fingerprints_see_order_free_rows_with_copies_and_nulls(spark):
    shape = "run_id string, id string, note string, n int"
    first = [("a", "x", None, 1), ("a", "y", "q", None), ("a", "y", "q", None)]
    same = [("b", *r[1:]) for r in reversed(first)]
    fewer = [("c", *r[1:]) for r in first[:2]]
    moved = [("d", "x", None, 1), ("d", "y", None, 2), ("d", "y", None, 2)]
    points = spark.createDataFrame(first + same + fewer + moved, shape).repartition(4)
    limits = spark.createDataFrame([("a", "l"), ("b", "l"), ("c", "l")], "run_id string, id string")
    tables = {"points": points, "limits": limits}
    conflicts = runs.denominator_conflicts(tables, ["a", "b", "c", "d"])
    assert rows(conflicts) == [("c", "points"), ("d", "limits"), ("d", "points")]
    assert rows(runs.denominator_difference(tables, conflicts, "a")) == [
        ("c", "points", "y", 1), ("d", "limits", "l", 1), ("d", "points", "y", -2), ("d", "points", "y", 2)]
    assert rows(runs.denominator_difference(tables, conflicts.limit(0), "a")) == []


def test_evidence_is_united_by_key(spark):
    hits = spark.createDataFrame([("a", "t", "h", 5), ("a", "t", "h", 3), ("b", "t", "h", 1), ("b", "t", "k", 2), ("b", "u", "h", 9), ("z", "t", "h", 0)], "run_id string, test_id string, hit_id string, seq long")
    phases = spark.createDataFrame([("a", "t", "p", 1), ("b", "t", "p", 1), ("b", "t", "q", 2), ("b", "u", "r", 3)], "run_id string, test_id string, id string, seq long")
    out = runs.merge_evidence({"hits": hits, "phases": phases}, ["b", "a"], "m", spark.createDataFrame([("b", "u")], "run_id string, test_id string"))
    assert rows(out["hits"].select("run_id", "test_id", "hit_id", "shard", "seq")) == [("m", "t", "h", 0, 1), ("m", "t", "k", 0, 2)]
    assert rows(out["phases"].select("shard", "id", "fresh_id")) == [(0, "p", "p"), (0, "q", "q"), (1, "p", "p~2")]
