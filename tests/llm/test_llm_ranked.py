"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from attestry.llm import ranked


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    bags = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    total, df = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc_id, bag in bags:
            m = 50 + 50 * sum(bag.values()) * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in asked if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_nra_equals_full_scores(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(300):
        monkeypatch.setattr(ranked, "FIRST_READ", int(rng.integers(1, 9)))
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 20))
        total, lists = np.zeros(n, np.int64), []
        for _ in range(rng.integers(1, 9)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            gains = np.sort(rng.integers(1, rng.choice([3, 1000]), len(docs)))[::-1]
            total[docs] += gains
            lists.append((docs, gains))
        tie = rng.permutation(n)
        best, scores = ranked.best_documents(lists, n, tie, k)
        want = [d for d in np.lexsort((tie, -total)).tolist() if total[d]][:k]
        assert best.tolist() == want and scores.tolist() == total[want].tolist()


def test_reading_stops_where_the_rest_cannot_matter():
    class Counted(np.ndarray):
        def __getitem__(self, key):
            part = super().__getitem__(key)
            if isinstance(key, slice):
                reads.append(len(part))
            return part

    reads = []
    gains = np.arange(100_000, 0, -1)
    best, _ = ranked.best_documents([(np.arange(100_000).view(Counted), gains)] * 2, 100_000, np.arange(100_000), 10)
    assert best.tolist() == list(range(10)) and sum(reads) <= 2 * ranked.FIRST_READ


@pytest.mark.parametrize("segment", [32 << 20, 20_000])
def test_query_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 3000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, "The the THE Ärger"), (None, "lonely ärger"), (7, None), (8, ""), (9, "--- \n"), (3, docs[3][1]), (3, docs[3][1]), (4, "The ärger 7"), (10_000, "rare " * 5000)]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(500, None), (501, ""), (502, "!!"), (None, "the Ärger"), (503, "rare, ärger-7"), (503, "lonely"), (503, "lonely"), (504, "nowhereatall")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score long").repartition(4)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    got = ranked.ranked(d, b)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 50)
    assert ranked.ranked(d.limit(0), b).collect() == [] and ranked.ranked(d, b.limit(0)).collect() == []


def test_sql_says_the_same(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(ranked.ORACLE).fetchall()
    assert sorted(map(tuple, ranked.op12_ranked(spark, sf).collect())) == sorted(want) and want
