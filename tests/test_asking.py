"""The tests asked about a statement, against a plain reading of the order."""

import random

from attestry.operators import asserts


def by_hand(statements, running, tests, sources, keep):
    said, files = {s[:2]: s[3] for s in statements}, {s[:2]: s[2] for s in statements}
    out = set()
    for key in said:
        fragment, stem = said[key].strip('"'), files[key].rsplit("/", 1)[-1].split(".")[0].lower()
        rows = []
        for run, test, name, file in tests:
            if (*key, test) in running and run == key[0]:
                away = 0 if file is None else 1 if stem in file.rsplit("/", 1)[-1].lower() else 2
                rows.append(((away, file or "", name, test), test, file, name.rsplit(" > ", 1)[0], fragment in sources[run, test]))
        rows.sort()
        blocks, seen, quoted = {}, {}, set()
        for order, _, file, block, _ in rows:
            if (file, block) not in seen:
                blocks[file] = seen[file, block] = blocks.get(file, 0) + 1
        placed, led = [], set()
        for order, test, file, block, quotes in rows:
            lead = (file, block) not in led
            led.add((file, block))
            tier, depth = (1 if file not in quoted else 2, 0) if quotes else (3, seen[file, block]) if lead else (4, 0)
            quoted |= {file} if quotes else set()
            placed.append(((0, 0, order) if len(rows) <= keep else (tier, depth, order), test))
        out |= {(*key, test, place) for place, (_, test) in enumerate(sorted(placed)[:keep], 1)}
    return out


def test_asking_order(spark):
    rng = random.Random(3)
    tests, sources = [], {}
    for run in ("r", "q"):
        for i in range(60):
            file = rng.choice([None, "t/cart_test.ts", "t/other.ts", "u/more.ts"])
            tests.append((run, f"t{i}", f"suite {rng.randrange(9)} > case {rng.randrange(40)}", file))
            sources[run, f"t{i}"] = rng.choice(["expect red widget", "nothing", "nothing", "nothing"])
    statements = [(run, f"p{i}", "src/Cart.ts", '"red widget"' if i % 2 else '"blue widget"') for run in ("r", "q") for i in range(40)]
    running = {(run, id_, f"t{j}") for run, id_, _, _ in statements for j in rng.sample(range(60), rng.choice([1, 2, 3, 5, 6, 20, 60]))}
    s = spark.createDataFrame(statements, "run_id string, id string, file string, source string")
    r = spark.createDataFrame(sorted(running), "run_id string, id string, test_id string")
    t = spark.createDataFrame(tests, "run_id string, test_id string, name string, test_file string")
    x = spark.createDataFrame([(*k, v) for k, v in sources.items()], "run_id string, test_id string, test_source string")
    for keep in (1, 2, 5):
        expected = by_hand(statements, running, tests, sources, keep)
        told = asserts.asking_order(s, r, t, asserts.quoting(s, r, x), keep=keep)
        assert {tuple(row) for row in told.collect()} == expected
        assert {tuple(row) for row in asserts.asking_order(s, r, t, None, keep=keep, test_sources=x).collect()} == expected


def test_last_order_leaves_out_who_was_asked(spark):
    s = spark.createDataFrame([("r", "p1", "a.ts", "red widget")], "run_id string, id string, file string, source string")
    r = spark.createDataFrame([("r", "p1", "t1"), ("r", "p1", "t2")], "run_id string, id string, test_id string")
    t = spark.createDataFrame([("r", "t1", "red"), ("r", "t2", "blue")], "run_id string, test_id string, name string")
    a = spark.createDataFrame([("r", "p1", "t2", 1)], "run_id string, id string, test_id string, place int")
    b = spark.createDataFrame([("r", "t1", 4)], "run_id string, test_id string, breadth int")
    assert [tuple(x) for x in asserts.last_order(s, r, t, a, a, b).collect()] == [("r", "p1", "t1", 1, 1)]


def test_last_tests_follow_the_spread_where_they_run_as_much(spark):
    """Every test runs one statement and shares no word with it, so only the spread puts them in order."""
    import pandas as pd

    from attestry.plans import impact_queries

    class M:
        points = spark.createDataFrame([("r", "p1", "src/cart.ts", None, "left")], "run_id string, id string, file string, label string, source string")
        hits = spark.createDataFrame([("r", "p1", f"t{i}") for i in range(6)], "run_id string, hit_id string, test_id string")
        tests = spark.createDataFrame(pd.DataFrame([("r", f"t{i}", f"n{9 - i}", "t/a_test.ts", "e2e") for i in range(6)], columns=["run_id", "test_id", "name", "test_file", "kind"]))
        sf_dir = "spread"

    M.spark = spark
    rows = impact_queries.last_tests_to_ask(M).orderBy("last_place").collect()
    # By name t5 and t4 are asked first; the spread goes on with t3, where ids alone would give t0.
    assert [row["test_id"] for row in rows] == ["t3", "t2", "t1"]
