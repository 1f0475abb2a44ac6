"""Witnesses against a compiler's count and against the nested scan."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import mcdc

SCHEMA = "run_id string, test_id string, decision_id string, seq long, vals array<boolean>, outcome boolean"


def pair(left, right, condition):
    (a, x), (b, y) = left, right
    if a[condition] is None or b[condition] is None or a[condition] == b[condition] or x == y:
        return False
    return all(i == condition or p is None or q is None or p == q for i, (p, q) in enumerate(zip(a, b)))


def nested(vectors):
    distinct = list(dict.fromkeys(vectors))
    width = len(distinct[0][0])
    out = {}
    for c in range(width):
        for i, left in enumerate(distinct):
            second = next((j for j in range(i + 1, len(distinct)) if pair(left, distinct[j], c)), None)
            if second is not None:
                out[c] = (vectors.index(left), vectors.index(distinct[second]))
                break
    return out


def found(spark, decisions):
    rows = [("r", "t", name, seq, list(vals), outcome) for name, vectors in decisions.items() for seq, (vals, outcome) in enumerate(vectors)]
    seen = mcdc.observations(spark.createDataFrame(rows, SCHEMA), ["run_id"])
    out = {name: {} for name in decisions}
    for row in mcdc.witnesses(seen, ["run_id"]).collect():
        out[row.decision_id][row.condition] = (row.first_seq, row.second_seq)
    return out


def test_compiler_counts(spark):
    """``(a && b) || c`` as a compiler's MC/DC report counts it: five runs show
    three conditions, the first four of them one."""
    N = None
    runs = [((False, N, False), False), ((False, N, True), True), ((True, False, False), False), ((True, False, True), True), ((True, True, N), True)]
    got = found(spark, {"complete": runs, "missing": runs[:4]})
    assert len(got["complete"]) == 3 and len(got["missing"]) == 1


@pytest.mark.parametrize("width", [1, 4, 6, 63, 130])
def test_equals_nested_scan(spark, width):
    rng = random.Random(width)
    decisions = {}
    for d in range(25):
        base = [rng.choice([True, False]) for _ in range(width)]
        vectors = []
        for _ in range(rng.randint(1, 9)):
            vals = list(base)
            for _ in range(rng.randint(0, 2)):
                vals[rng.randrange(width)] = rng.choice([True, False, None])
            vectors.append((tuple(vals), rng.choice([True, False])))
        decisions[f"d{d}"] = vectors
    assert found(spark, decisions) == {name: nested(vectors) for name, vectors in decisions.items()}


def test_vector_words(spark):
    row = spark.range(1).select(F.array(F.lit(True), F.lit(None).cast("boolean"), F.lit(False)).alias("v")).select(
        mcdc.vector_key(F.col("v"), F.lit(True)).alias("key"), mcdc.vector_text(F.col("v")).alias("text")).first()
    assert (row.key, row.text) == ("T-F:T", "T - F")
