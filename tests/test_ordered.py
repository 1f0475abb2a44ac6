"""Bucketed patterns against plain Python, with buckets small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice("ab"), at, rng.choice([None, None, at % 17]), rng.randint(0, 5)) for at in rng.sample(range(400), 150)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at int, v int, n int")


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_row_numbers(frame, rows):
    got = {(r.k, r.at): r.i for r in ordered.row_numbers(frame, ["k"], "at", [F.col("at")], "i", 16).collect()}
    assert got == {(k, r[1]): i + 1 for k, group in by_key(rows).items() for i, r in enumerate(group)}


def test_previous(frame, rows):
    got = {(r.k, r.at): r.prev_at for r in ordered.previous(frame, ["k"], "at", ["at"], ["at"], 16).collect()}
    assert got == {(k, r[1]): (group[i - 1][1] if i else None) for k, group in by_key(rows).items() for i, r in enumerate(group)}


def test_fill_forward_and_running_total(frame, rows):
    filled = {(r.k, r.at): r.v for r in ordered.fill_forward(frame, ["k"], "at", ["v"], 16).collect()}
    total = {(r.k, r.at): r.s for r in ordered.running_total(frame, ["k"], "at", "n", "s", 16).collect()}
    for k, group in by_key(rows).items():
        last, s = None, 0
        for row in group:
            last, s = row[2] if row[2] is not None else last, s + row[3]
            assert filled[k, row[1]] == last and total[k, row[1]] == s


def test_ranges(spark):
    rng = random.Random(3)
    lines = {("f" if rng.random() < 0.5 else "g", rng.randint(0, 120)) for _ in range(150)}
    got = {(r.file, r.start, r.end) for r in ordered.ranges(spark.createDataFrame(list(lines), "file string, line int"), ["file"], "line", 8).collect()}
    want = set()
    for file in "fg":
        run = []
        for line in sorted(n for f, n in lines if f == file) + [10**6]:
            if run and line != run[-1] + 1:
                want.add((file, run[0], run[-1]))
                run = []
            run.append(line)
    assert got == want


def test_sole_container(spark):
    rng = random.Random(11)
    spans = [("r", f"o{i}", s := rng.randint(0, 300), s + rng.randint(0, 30)) for i in range(25)]
    points = [("r", i, rng.randint(0, 330)) for i in range(200)]
    got = {r.id: (r.owner_count, r.owner) for r in ordered.sole_container(
        spark.createDataFrame(points, "run string, id int, at long"), spark.createDataFrame(spans, "run string, name string, start long, stop long"),
        ["run"], "at", "start", "stop", "name", 16).collect()}
    for _, i, at in points:
        holding = [name for _, name, start, stop in spans if start <= at <= stop]
        assert got[i] == (len(holding), holding[0] if len(holding) == 1 else None)


def test_last_two_at(spark):
    rng = random.Random(5)
    marks = [("r", f"m{i:02}", rng.randint(0, 200)) for i in range(40)]
    events = [("r", i, rng.randint(0, 210)) for i in range(120)]
    got = {r.e: (r.last.id if r["last"] else None, r.before_last.id if r.before_last else None) for r in ordered.last_two_at(
        spark.createDataFrame(events, "run string, e int, t long"), spark.createDataFrame(marks, "run string, id string, at long"),
        ["run"], "t", "at", ["at", "id"], ["id"], 16).withColumnRenamed("last", "last").collect()}
    inorder = sorted((at, name) for _, name, at in marks)
    for _, e, t in events:
        seen = [name for at, name in inorder if at <= t]
        assert got[e] == (seen[-1] if seen else None, seen[-2] if len(seen) > 1 else None)


def test_a_busy_minute_is_cut_by_rows(spark):
    """One key's rows within a minute: no bucket holds more than twice its share."""
    rows = spark.range(200_000).select(F.lit("run").alias("k"), (F.xxhash64("id") % 30_000).alias("at"))
    sizes = [r["count"] for r in ordered.bucketed(rows, ["k"], "at", None).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2 * 200_000 / len(sizes)


def test_buckets_by_rows_change_no_answer(frame, rows, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 8)
    got = {(r.k, r.at): r.prev_at for r in ordered.previous(frame, ["k"], "at", ["at"], ["at"]).collect()}
    assert got == {(k, r[1]): (group[i - 1][1] if i else None) for k, group in by_key(rows).items() for i, r in enumerate(group)}
