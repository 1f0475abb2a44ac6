"""Null, empty, repeated and oddly named input for every operator, and the vector and label ones."""

import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import crc  # noqa: E402

from attestry.llm import common, convnet, decontaminate, interleave, licences, linededup, pieces, pitmanyor, simhash, suffixes, topk  # noqa: E402
from attestry.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, fp long, shard int, slot long, score double, label string, n_lines int, rank int, licence string, digest string, component_id long, sample int, pieces string, _key long"
LONG = "A long sentence about nothing in particular, again and again. " * 400


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, *[None] * 15) for i, t, s in rows], SCHEMA)


ODD = [
    (1, "One two three four five six.\nSeven eight nine ten.", "a"), (1, "One two three four five six.\nSeven eight nine ten.", "a"), (2, None, None), (3, "", "a"), (None, "text without id", "b"),
    (None, None, None), (4, " \n\t\n ", "a"), (5, LONG, "a"), (6, LONG + "tail", None), (7, "x", "c"),
]

OPERATORS = {
    "language model": lambda d: pitmanyor.score_texts(d),
    "lines": lambda d: linededup.dedup_lines(d),
    "decontamination": lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, "three four five six. seven"), (2, None), (None, "x"), (3, "")], "item_id long, text string")),
    "interleave": lambda d: interleave.interleave(d, 3),
    "licences": lambda d: licences.scan_licences(d, licences.builtin(d.sparkSession)),
    "simhash": lambda d: simhash.near_duplicates(d),
    "pieces": lambda d: pieces.encode_samples(d),
    "repeats": lambda d: suffixes.drop_repeats(d),
    "quality": lambda d: convnet.score_documents(d, convnet.Net()),
}
PER_ROW = {"language model", "lines", "interleave", "licences", "simhash", "repeats", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](frame(spark, ODD).repartition(2)).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in ODD)
    if name == "simhash":
        by = {str(r.doc_id): r for r in got}
        assert by["2"].fp == by["3"].fp == 0 and by["3"].component_id == 2
        assert by["1"].component_id == 1
    if name == "decontamination":
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(1, 1, 0)}
    if name == "lines":
        by = {str(r.doc_id): r for r in got}
        # Equal id and text: answered alike; blank lines stay; null stays null.
        assert [r.n_removed for r in got if r.doc_id == 1] == [0, 0]
        assert by["4"].text == " \n\t\n " and by["2"].text is None and by["2"].n_lines == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_stage_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(1, "some item of a benchmark text here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = frame(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{sf}/documents.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == docs.columns, name
            stage(spark, rows, sf).collect()
    assert all(r.round_trip for r in corpus_pipeline.run(spark, sf).collect())


CLASHING = [
    (1, "It was a plain sentence about gardens and the people who keep them through the year.", 9, "k"), (1, "Quite another matter is told here: rivers rise in spring and carry the ice down to the sea.", 8, "l"),
    (None, "seven green bottles stood on the old stone wall behind the house", 7, "m"), (None, "Every evening the ferry crossed the sound with post, milk and a few late travellers on board.", 6, "n"),
    (2, "seven green bottles stood on the old stone wall behind the house", 5, "o"), (2, "Nobody had counted the swallows since the barn burned down, but there were fewer of them.", 4, "p"),
]


def test_stages_keep_clean_rows_of_shared_ids_and_columns_of_any_name(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    sf, names = str(tmp_path), ["_leak", "score", "n_lines", "n_removed", "row", "key", "id", "text_of", "gone_id", "component", "item_id", "a", "sid"]
    spark.createDataFrame([(1, "seven green bottles stood on the old stone wall behind the house")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(i, t, n, *[c] * len(names)) for i, t, n, c in CLASHING], ", ".join(["doc_id long, text string, n_chars long", *[f"{n} string" for n in names]]))
    docs.select("doc_id", "text").write.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    everything = {(r.doc_id, r.text, r.score, r.row) for r in docs.collect()}
    for name in ("quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination"):
        got = stages[name](spark, docs, sf)
        assert got.columns == docs.columns, name
        rows = {(r.doc_id, r.text, r.score, r.row) for r in got.collect()}
        leaking = {r for r in everything if r[1].startswith("seven")}
        if name == "benchmark_decontamination":
            assert rows == everything - leaking
        if name in ("line_dedup", "simhash_near_dedup"):
            # One of the two equal rows stays, and all others.
            assert rows - leaking == everything - leaking and len(rows & leaking) == 1


def test_words_of_thue_and_morse_have_hashes_of_their_own():
    thue = "".join(str(i.bit_count() % 2) for i in range(1024)).encode()
    other = thue.translate(bytes.maketrans(b"01", b"10"))
    texts = [thue, other, b"", b"a", b"a\0", thue * 9, other * 9, thue[:8], thue[:9]]
    offsets = np.cumsum([0, *map(len, texts)])
    hashes = common.bytes_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets[:-1], offsets[1:])
    assert len(set(hashes.tolist())) == len(texts)
    both = np.frombuffer(thue + b" " + other, np.uint8)
    assert len(set(pitmanyor.tokens_of(both, np.array([0, len(both)]))[0].tolist())) == 3


def test_a_text_of_thue_and_morse_words_comes_back(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    text = f"{thue} {thue.translate(str.maketrans('ab', 'ba'))}"
    assert all(r.round_trip for r in pieces.op9_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())


def test_components_of_paths_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_top(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, own) in enumerate(good):
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(own, w)), i) for n, (i, w) in enumerate(good) if n != at and len(w) == len(own))
            out.update((q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1))
    return out


@pytest.mark.parametrize("kind", ["unit", "mixed", "clustered", "few"])
def test_top_k_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "LONGEST", 8)
    monkeypatch.setattr(topk, "HASHED", 16)
    rng = np.random.default_rng(len(kind))
    n = 3 if kind == "few" else 500
    v = rng.normal(size=(n, 12))
    if kind == "clustered":
        v = np.repeat(rng.normal(size=(5, 12)), n // 5, axis=0) + 0.05 * rng.normal(size=(n, 12))
    if kind in ("unit", "clustered"):
        v /= np.linalg.norm(v, axis=1)[:, None]
    else:
        v *= rng.exponential(1, n)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    rows += [(600, None), (650, [1.0, None]), (700, [math.nan] * 12), (750, [math.inf] * 12), (None, [1.0] * 12), (800, []), (850, [1.0, 2.0]), (851, [2.0, 2.0]), (100, [0.0] * 12), (50, [-9.0] * 12)]
    rows += [(7, [2.0] + [0.0] * 11), (7, [5.0] + [0.0] * 11), *[(150, [3.0] * 12)] * 3, *[(9, [4.0] * 12)] * 8]
    frame = spark.createDataFrame([(i, x, 0, 1) for i, x in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    assert Counter(tuple(r) for r in topk.op4_topk(frame).collect()) == brute_top(rows, 5)
    assert topk.op4_topk(frame.limit(0)).collect() == []


def test_classifier_generalises_and_keeps_to_its_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in convnet.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if crc(r.doc_id) % 5 == 0]
    good = [p for p, q in held if q == 1]
    assert sum(p == q for p, q in held) >= 0.93 * len(held) and sum(good) >= 0.97 * len(good)
    texts, wanted = convnet.sample(docs, labels, rows=40)
    assert len(texts) == len(wanted) <= 40


def test_scores_do_not_depend_on_neighbours():
    net, rng = convnet.Net(3), np.random.default_rng(0)
    net.last = rng.normal(size=net.last.shape).astype(np.float32)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 3, 60, 61, 64, 65, 300, 5000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = convnet.scores(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [convnet.scores(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_op9_gives_the_pieces_themselves(spark):
    import zlib

    for r in pieces.op9_pieces(spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")).collect():
        assert len(r.pieces) == r.n_pieces and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.pieces)) == r.ids_crc32
