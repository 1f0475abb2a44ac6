"""Periodic runs against a search over every period."""

import hashlib
import random
import re

import numpy as np
import pytest

from attestry.llm import periodic
from helpers import crc


def brute_runs(words, shortest=6, exponent=4):
    """For every period the maximal stretches that keep it, less those with a smaller one."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            stretch = words[start : start + length]
            smaller = any(stretch[r:] == stretch[:-r] for r in range(1, q))
            if length >= max(shortest, exponent * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), crc(doc_id)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(list(words))]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
    shape = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shape, *digests)


def near_periodic(rng):
    out = []
    while len(out) < rng.randint(1, 90):
        root = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        out += (root * rng.randint(1, 7))[: rng.randint(1, 40)]
    return out


def test_runs_of_random_sequences():
    rng = random.Random(5)
    several = 0
    for _ in range(400):
        s = near_periodic(rng)
        want = brute_runs(s)
        several += len(want) > 1
        assert periodic.runs_of(np.array(s)) == want
        assert periodic.batch_runs([[b"%d" % x for x in s], [], [b"%d" % x for x in s[::-1]]]) == [want, [], brute_runs(s[::-1])]
    assert several > 80


@pytest.mark.parametrize("exponent", [4, 5, 7])
def test_other_exponents(exponent):
    rng = random.Random(exponent)
    for _ in range(80):
        s = near_periodic(rng)
        assert periodic.batch_runs([[b"%d" % x for x in s]], 6, exponent) == [brute_runs(s, 6, exponent)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, exponent=2)


def test_extremes_of_trees():
    fibonacci = [0, 1]
    while len(fibonacci) < 400:
        fibonacci = [y for x in fibonacci for y in ((0, 1) if x == 0 else (0,))]
    assert periodic.runs_of(np.array(fibonacci[:400])) == brute_runs(fibonacci[:400])
    assert periodic.runs_of(np.zeros(5000, int)) == [(0, 5000, 1)]
    assert periodic.runs_of(np.arange(5000)) == []
    thue = [bin(i).count("1") % 2 for i in range(512)]
    assert periodic.runs_of(np.array(thue[:128] * 5)) == brute_runs(thue[:128] * 5)


def test_query_equals_brute_force(spark):
    echo = " ".join(["tick tock"] * 40)
    odd = [(None, "a a a a a a a"), (3, None), (4, ""), (5, " \n\t "), (6, echo), (6, echo), (7, "a b " * 9), (8, f"x {echo}\x0b{echo} y"), (9, "w " * 900)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 2500][:80] + odd
    frame = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, start int, runs string, best int").repartition(3)
    got = [tuple(r) for r in periodic.op13_runs(frame).collect()]
    assert sorted(got, key=str) == sorted((brute(i, t) for i, t in rows), key=str)
    assert sum(r[1] for r in got) > 8
    assert periodic.op13_runs(frame.limit(0)).collect() == []
