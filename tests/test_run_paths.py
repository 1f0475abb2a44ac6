"""Pairs of functions one test ran, and how they are held."""

import random

from attestry.operators import assess

FUNCTIONS = "file string, name string, start int, end int, takes_outside double, reaches_sink double, sanitises double, sink_kind string"
KNOWN = "caller_file string, caller_name string, callee_file string, callee_name string"


def test_pairs_are_ranked_by_number_as_by_name(spark):
    rng = random.Random(5)
    functions = [(f"f{i % 5}", f"n{i % 11}", 1 + i * 3 % 90, 3 + i * 3 % 90, rng.random() + 0.2, rng.random() + 0.3, rng.random() / 2, "none" if i % 7 == 0 else f"k{i % 2}") for i in range(40)]
    runs = sorted({(f"t{rng.randrange(8)}", f"f{rng.randrange(5)}", rng.randrange(1, 95)) for _ in range(160)})
    ran = {(f, t) for f in functions for t, file, line in runs if file == f[0] and f[2] <= line <= f[3]}
    found = {}
    for k, t in ran:
        for c, other in ran:
            if other == t and c[0] != k[0] and c[4] >= 0.6 and k[5] >= 0.6 and k[6] < 0.6 and k[7] != "none":
                pair = (k[0], k[1], k[2], k[7], c[0], c[2], c[1])
                found[pair] = min(found.get(pair, t), t)
    gone = sorted(found)[0]
    left = {p: t for p, t in found.items() if (p[4], p[6], p[0], p[1]) != (gone[4], gone[6], gone[0], gone[1])}
    want = []
    for sink in {p[:2] for p in left}:
        order = sorted((t, p[4], p[5], p[6], p) for p, t in left.items() if p[:2] == sink)
        want += [(p[4], p[6], p[0], p[1], p[3], t, i < 3) for i, (t, *_, p) in enumerate(order)]
    frame = spark.createDataFrame(functions, FUNCTIONS)
    known = spark.createDataFrame([(gone[4], gone[6], gone[0], gone[1])], KNOWN)
    got = assess.run_paths(frame, spark.createDataFrame(runs, "test_id string, file string, line int"), known)
    assert len(left) > 20 and sorted((*r[:6],) for r in got.collect()) == sorted(w[:6] for w in want)
    # Of rows whose order is told apart, the first three of a sink are asked.
    assert sum(r.asked for r in got.collect()) == sum(w[6] for w in want)
    # What is shuffled test by test holds numbers, not the texts of both functions.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate [_of" in line)
    assert "caller_file" not in grouped
