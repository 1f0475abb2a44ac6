"""The pipeline against a brute-force version of its stages."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import Union, every_shingle, near_lines, word_list  # noqa: E402
from test_llm_nearcopies import five_words  # noqa: E402

import corpus_pipeline  # noqa: E402
from attestry.llm import convnet, decontaminate, linededup, pieces  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_pipeline_equals_brute_force(spark, result):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = convnet.quality_net(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {}
    for r in docs.orderBy("doc_id").collect():
        data = r.text.encode()
        if convnet.scores(net, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] >= 0.3:
            kept[r.doc_id] = r.text
    lines = list(dict.fromkeys(x for t in kept.values() for x in t.split("\n") if x.strip()))
    label = dict(zip(lines, near_lines(lines, every_shingle, 0.8)))
    seen, left = set(), {}
    for i, t in kept.items():
        mine = []
        for line in t.split("\n"):
            if not line.strip() or label[line] not in seen:
                mine.append(line)
            if line.strip():
                seen.add(label[line])
        if mine:
            left[i] = "\n".join(mine)
    ids = sorted(left)
    sets, union = [five_words(left[i]) for i in ids], Union(len(ids))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                union.join(i, j)
    left = {d: left[d] for i, d in enumerate(ids) if union.find(i) == i}
    items = [np.array([hash(w) for w in word_list(r.text)]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {}
    for d, t in left.items():
        words = np.array([hash(w) for w in word_list(t)])
        if not any(decontaminate.nearest_stretch(i, words)[0] <= decontaminate.edits_allowed(len(i), 0.8) for i in items):
            clean[d] = t
    assert {r.doc_id for r in result} == set(clean)
    known = pieces.load_vocabulary()
    for r in result:
        assert r.round_trip and pieces.decode(r.pieces, known.pieces).decode() == clean[r.doc_id]


def test_every_dealt_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
