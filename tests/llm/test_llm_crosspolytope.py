"""Nearest neighbours by cross-polytope tables against all distances."""

import math
from collections import Counter

import numpy as np
import pytest

from attestry.llm import crosspolytope as cp


def brute(rows, k, every):
    """(query, rank, vec_id, score) of every query row, by plain loops."""
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(q, v))), j) for n, (j, v) in enumerate(good) if n != at and len(v) == len(q))
            out.update((i, r, j, round(d, 9)) for r, (d, j) in enumerate(near[:k], 1))
    return out


def answers(rows):
    return Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in rows)


def test_hadamard_turns_keep_lengths_and_probes_start_at_the_code():
    rng = np.random.default_rng(1)
    for dimension, bits in [(1, 1), (3, 4), (64, 5), (64, 7), (60, 11), (64, 14)]:
        hashes, x = cp.Hashes(dimension, bits), rng.normal(size=(50, dimension))
        assert math.prod(2 * a for a in hashes.axes) == 1 << bits
        for table in range(cp.TABLES):
            for values, axes in zip(hashes.turned(x, table), hashes.axes):
                if axes == hashes.width:
                    assert np.allclose((values[:, :axes] ** 2).sum(1), 1, atol=1e-5)
            codes, probes = hashes.codes(x, table), hashes.probes(x, table, 40)
            assert (probes[:, 0] == codes).all() and all(len(set(p)) == min(40, 1 << bits) for p in probes.tolist())
    few, many = cp.Hashes(16, 12).probes(x := rng.normal(size=(9, 16)), 0, 25), cp.Hashes(16, 12).probes(x, 0, 4000)
    assert (few == many[:, :25]).all()


@pytest.mark.parametrize("kind", ["clustered", "scaled", "copies", "few"])
def test_neighbours_of_small_tables(spark, monkeypatch, kind):
    monkeypatch.setattr(cp, "CELL", 50)
    monkeypatch.setattr(cp, "QUERY_CELL", 3)
    rng = np.random.default_rng(len(kind))
    n = 6 if kind == "few" else 700
    v = rng.normal(size=(n, 20))
    if kind == "clustered":
        v = rng.normal(size=(20, 20))[rng.integers(20, size=n)] + 0.2 * v
    if kind == "scaled":
        v *= 10.0 ** rng.integers(-3, 4, (n, 1))
    if kind == "copies":
        v[::3] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))] + [(700, None), (800, [1.0, None]), (900, [math.nan] * 20), (1000, [math.inf] * 20), (None, [1.0] * 20), (1100, [0.0] * 20), (1200, [])]
    rows += [(1300, [1.0, -0.0]), (1301, [1.0, 0.0]), (1302, [2.0, 2.0])] + [rows[0], (100, rows[1][1]), (0, rows[2][1])]
    frame = spark.createDataFrame([(i, x, 0, 1.0, 2) for i, x in rows], "vec_id long, embedding array<float>, rank int, score double, a int").repartition(3)
    got, want = answers(cp.op11_neighbours(frame).collect()), brute(rows, 10, 100)
    assert Counter((g[0], g[1]) for g in got.elements()) == Counter((w[0], w[1]) for w in want.elements())
    common = sum(min(n, got[key]) for key, n in want.items()) if kind in ("copies", "few") else len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert common >= (0.9 if kind != "scaled" else 0.85) * len({(q, i) for q, _, i, _ in want})
    assert {g[0]: g[3] for g in got}.keys() == {w[0]: w[3] for w in want}.keys()
    assert cp.op11_neighbours(frame.limit(0)).collect() == []


def test_queries_that_find_too_few_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(cp, "fitted", lambda vectors, sample, dimension, count, k: (cp.Hashes(dimension, 15), 1))
    monkeypatch.setattr(cp, "BLOCK", 2)
    rng = np.random.default_rng(0)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 16)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = answers(cp.op11_neighbours(frame).collect())
    assert Counter(g[0] for g in got) == {i: 10 for i in (0, 100, 200, 300)} and got == brute(rows, 10, 100)


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = cp.op11_neighbours(frame).collect()
    hits = 0
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {r.vec_id for r in got if r.query_id == ids[at]})
        assert all(abs(r.score - d[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in got if r.query_id == ids[at])
    assert len(got) == 10 * (ids % 100 == 0).sum() and hits >= 0.9 * len(got)
    print("recall", hits / len(got))
