"""Repeated executions against the rule taken record by record."""

import random

from attestry.operators import timing


def one_by_one(records):
    declared, out = set(), []
    for seq, ids in sorted(records.items()):
        fresh = {i: i for i in ids}
        if declared & set(ids):
            for i in ids:
                n = 2
                while f"{i}~{n}" in declared:
                    n += 1
                fresh[i] = f"{i}~{n}"
        declared |= set(fresh.values())
        out += [(seq, i, f) for i, f in fresh.items()]
    return out


def test_chained_repeats_and_taken_names(spark):
    rng = random.Random(2)
    runs = {"chain": {1: ["a"], 2: ["a", "b"], 3: ["b"], 4: ["b", "c"], 5: ["c"]}, "taken": {1: ["a", "a~2"], 2: ["a"], 3: ["a~3"], 4: ["a"], 5: ["a~2"], 6: ["a~2~2", "z"]}}
    for n in range(5):
        names = [x + s for x in "abcd" for s in ("", "~2", "~3", "~2~2", "~5")]
        runs[f"r{n}"] = {k: sorted(set(rng.choices(names, k=rng.randint(1, 3)))) for k in range(1, 9)}
    rows = [(r, seq, i) for r, records in runs.items() for seq, ids in records.items() for i in ids]
    got = timing.separate_repeats(spark.createDataFrame(rows, "run_id string, record_seq int, id string"))
    want = {(r, *row) for r, records in runs.items() for row in one_by_one(records)}
    assert {(x.run_id, x.record_seq, x.id, x.fresh_id) for x in got.collect()} == want
    assert {x[2] != x[3] for x in want} == {True, False}
