"""Near copies of documents against Jaccard brute force."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from helpers import word_list  # noqa: E402

import corpus_pipeline  # noqa: E402
from attestry.llm import nearcopies  # noqa: E402


def five_words(text):
    words = word_list(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    x, y = five_words(a), five_words(b)
    return len(x & y) / len(x | y)


def test_changed_sentences_are_found_and_no_stranger_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LEAF", 64)
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{i}" for i in rng.integers(5000, size=n)]
    docs, near, close_but_apart = [], [], []
    for d in range(300):
        words = text(int(rng.integers(60, 400)))
        copy = list(words)
        at, n = int(rng.integers(len(words) // 2)), int(len(words) * rng.uniform(0.02, 0.2))
        copy[at : at + n] = text(n)
        a, b = " ".join(words), " ".join(copy)
        docs += [(2 * d, a), (2 * d + 1, b)]
        (near if likeness(a, b) >= 0.8 else close_but_apart).append(2 * d + 1)
    assert min(len(near), len(close_but_apart)) > 50
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    left = {r.doc_id for r in stage.collect()}
    assert set(range(0, 600, 2)) | set(close_but_apart) <= left
    assert sum(d not in left for d in near) >= 0.97 * len(near)


def test_a_group_of_near_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LEAF", 16)
    monkeypatch.setattr(nearcopies, "CELL", 32)
    base = [f"v{i}" for i in range(120)]
    docs = [(i, " ".join([*base[: i % 100 + 5], f"x{i}", *base[i % 100 + 6 :]])) for i in range(200)] + [(500, None), (501, " "), (None, "alone")]
    got = nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 500} == {0}
    assert {r.component_id for r in got if r.doc_id in (500, 501)} == {500} and len(got) == len(docs)


def test_a_cell_names_all_that_are_near_on_its_stretch(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, mask = 600, (1 << 13) - 1
    points = [rng.integers(1 << 63, size=n).astype(np.uint64) for _ in nearcopies.POINTS]
    for i in range(0, n, 2):  # every other one is a copy of the one before with some bits turned
        for p in points:
            p[i + 1] = p[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, size=rng.integers(14), replace=False)))
    home, zero = rng.random(n) < 0.7, np.zeros(n, np.int32)
    columns = {"leaf": zero, "home": home, "sid": np.arange(n), "label": np.arange(n) // 4 * rng.integers(2, size=n) - np.arange(n) - 1, **{k: p.view(np.int64) for k, p in zip(nearcopies.POINTS, points)}}
    near = lambda x, y, bits: int(x ^ y).bit_count() <= bits

    def expected(one, other):
        far = lambda i, j: sum(int(p[i] ^ p[j]).bit_count() for p in points)
        return {
            (i, j, far(i, j)) for i in one for j in other
            if i != j and (home[i] or home[j]) and columns["label"][i] != columns["label"][j] and far(i, j) <= nearcopies.BITS
            and near(points[0][i] & np.uint64(mask), points[0][j] & np.uint64(mask), nearcopies.REACH)}

    name = nearcopies.naming(n, [(0, 0, mask), (9, 1, mask)])
    for chunk, low, high in ((zero, 0, 0), (np.arange(n, dtype=np.int32) % 2, 0, 1)):
        table = pa.table({**columns, "chunk": chunk, "low": np.full(n, low, np.int32), "high": np.full(n, high, np.int32)})
        told = [tuple(x.values()) for x in name(table).to_pylist()]
        every = range(n)
        parts = (every, every) if low == high else ([i for i in every if chunk[i] == 0], [i for i in every if chunk[i] == 1])
        wanted = expected(*parts) | expected(*reversed(parts))
        assert len(told) == len(set(told)) and set(told) == wanted and wanted


def test_what_a_set_is_filed_under_does_not_grow_with_the_table(spark):
    def filed_of(n):
        sets = spark.range(n).select("id", *[F.xxhash64("id", F.lit(p)).alias(p) for p in nearcopies.POINTS])
        points = {p: np.array([r[p] for r in sets.collect()], np.int64).view(np.uint64) for p in nearcopies.POINTS}
        out = []
        for word, tree in nearcopies.trees(sets):
            nearcopies.visits(tree, points[nearcopies.POINTS[word]], np.arange(n), True, out)
        return sum(len(rows) for _, _, rows in out) / n

    assert filed_of(60_000) < 1.1 * filed_of(6_000)
