"""Operators on documents against brute force."""

import collections
import hashlib
import math
import re
import textwrap
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

from helpers import Union, crc, every_shingle, near_lines, repeats, small_docs, word_list  # noqa: E402

from attestry.llm import decontaminate, interleave, licences, linededup, pieces, pitmanyor, simhash, suffixes  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return small_docs(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_language_model_counts_and_held_out_gain(docs, rows):
    got = {r.doc_id: r for r in pitmanyor.op1_language_model(docs).collect()}
    tokens = {i: [*word_list(t), None] for i, t in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if crc(i) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pair_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    words = np.arange(40, dtype=np.uint64)
    frequent = pitmanyor.Frequent(words[:30], rng.integers(5, 90, 30).astype(float), np.full(pitmanyor.SHARED, 2.0), 9, 2000)
    frequent.classes = 1
    frequent.own[:] = False
    context = np.repeat(np.arange(5), 40)
    word = np.tile(np.repeat(words, 1), 5)
    order = np.lexsort((context, word))
    context, word = context[order], word[order]
    count = np.where(word < 39, rng.integers(0, 4, len(word)), 0)
    frequent.tokens = int(count.sum())
    frequent.context_counts[:5] = np.bincount(context, count, 5)
    p = pitmanyor.class_probabilities(frequent, 0, context, word, np.full(len(word), -1), count)
    # Word 39 is the one that training lacks.
    assert np.allclose(np.bincount(context, p, 5), 1.0)


def test_seating_keeps_within_bounds():
    rng = np.random.default_rng(1)
    counts = np.array([100_000, 500, 70, 5, 2, 1, 1], float)
    tables = pitmanyor.seated(counts, np.full(7, 20.0), np.full(7, 0.1), 0.8, 1.0, rng)
    assert (tables >= 1).all() and (tables <= counts).all() and tables[-1] == 1


def test_line_dedup_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in linededup.op2_lines(docs).collect()}
    lines = list(dict.fromkeys(x for _, t in sorted(rows) for x in t.split("\n") if x.strip()))
    label = dict(zip(lines, near_lines(lines, every_shingle, 0.8)))
    seen = set()
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            if line.strip():
                if label[line] in seen:
                    continue
                seen.add(label[line])
            kept.append(line)
        assert got[i].n_removed == len(t.split("\n")) - len(kept)
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_a_bucket_of_likes_and_strangers_keeps_every_link(spark):
    base = " ".join(f"word{i:02d}" for i in range(40))
    lines = [base.replace("word07", f"other{i}") for i in range(30)] + [base] + ["altogether different words stand here in this line of text"]
    got = linededup.dedup_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == [0, 31]


def test_line_dedup_is_native(docs):
    plan = linededup.op2_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = f"new{rng.integers(9999)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"new{rng.integers(9999)}")
    return out


def test_decontamination_recall_and_verification(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    pick = lambda n: [vocabulary[i] for i in rng.integers(500, size=n)]
    items = [pick(int(rng.integers(12, 60))) for _ in range(30)]
    docs, truth = [], {}
    for d in range(240):
        n = d % 30
        hit = edited(items[n], int(0.15 * len(items[n])), rng) if d < 120 else pick(len(items[n]))
        docs.append((d, " ".join(pick(int(rng.integers(90))) + hit + pick(int(rng.integers(90))))))
        if d < 120:
            truth[d] = n
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = decontaminate.leaks(frame(docs, "doc_id long, text string"), frame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert sum((d, n) in found for d, n in truth.items()) >= 0.95 * len(truth)
    assert all(truth.get(d) == n for d, n in found)
    for r in got:
        # The stretch named is within the distance named, by the textbook recurrence.
        a, b = [w.encode() for w in items[r.item_id]], word_list(docs[r.doc_id][1])[r.start_word : r.end_word]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        assert row[-1] == r.distance <= 0.2 * len(a)


def test_interleaving_keeps_the_mixture(docs, rows):
    got = interleave.interleave(docs, shards=7).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    per = collections.Counter((r.stratum, r.shard) for r in got)
    of = collections.Counter(r.stratum for r in got)
    assert all(abs(per[s, k] - of[s] / 7) <= 2 for s in of for k in range(7))
    texts = dict(rows)
    import zlib

    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert got == interleave.interleave(docs.repartition(5), shards=7).collect() or {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in interleave.interleave(docs.repartition(5), shards=7).collect()}


def test_licences_by_canonical_digest(spark):
    from attestry.llm.licence_texts import MIT

    shouted = "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace('"', "``") + "\n(C) Others"
    texts = [shouted, MIT + " and more", "Some prose.\nRELEASED under the MIT licence.\nMore.", "", None, "copyright 2001"]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licences.builtin(spark)).collect()}
    assert [got[i].licence for i in range(6)] == ["MIT", None, None, None, None, None]
    assert got[2].stated == ["MIT"] and got[2].stated_lines == 1 and got[1].stated == []


def brute_fingerprint(text, width):
    w = word_list(text)
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "CELL", 16)
    got = {r.doc_id: r for r in simhash.op7_simhash(docs).collect()}
    rows = sorted(rows)
    prints, union = [brute_fingerprint(t, 4) for _, t in rows], Union(len(rows))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                union.join(i, j)
    for i, (doc_id, _) in enumerate(rows):
        assert got[doc_id].fingerprint == f"{prints[i]:016x}"
        assert got[doc_id].component_id == rows[union.find(i)][0]


@pytest.mark.parametrize("bits", [1, 3, 4, 5])
def test_vantage_point_trees_lose_no_link(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = np.random.default_rng(bits)
    points = list({int(x) for x in rng.integers(0, 2**63, 150)})
    for p in points[:60]:
        flips = rng.choice(64, bits, replace=False)
        points.append(p ^ sum(1 << int(f) for f in flips if f < 63))
    points = sorted(set(points))
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), bits).collect()
    union, at = Union(len(points)), {p: i for i, p in enumerate(points)}
    for r in found:
        union.join(at[r.a], at[r.b])
    brute = Union(len(points))
    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= bits:
                brute.join(i, j)
    assert [union.find(i) for i in range(len(points))] == [brute.find(i) for i in range(len(points))]


def test_repeats_equal_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "12")
    try:
        got = {r.doc_id: r for r in suffixes.op10_repeats(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for doc_id, (gone, runs, kept) in repeats(rows).items():
        r = got[doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (gone, runs, hashlib.sha256(kept).hexdigest())


def test_repeats_of_periodic_and_edge_texts(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(160))
    texts = ["ab" * 400, "x" * 99, "x" * 100, "x" * 101, "", None, passage, "left " + passage[:100], passage[20:] + " right", "ab" * 60, "é" * 80]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in suffixes.op10_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, (gone, runs, kept) in repeats(rows).items():
        assert (got[doc_id].n_removed, got[doc_id].n_spans, got[doc_id].kept_sha256) == (gone, runs, hashlib.sha256(kept).hexdigest()), doc_id


TOY = [b"", b" ", b"a", b"b", b" a", b"ab", b" ab", b"ba", b"aba"]


def toy_vocabulary():
    return pieces.build_vocabulary([(p, -float(i)) for i, p in enumerate(TOY)] + [(b"", 0.0)] * 256, list(range(len(TOY), len(TOY) + 256)))


def segmentations(text):
    if not text:
        yield ()
    for i, p in enumerate(TOY):
        if p and text.startswith(p):
            for rest in segmentations(text[len(p) :]):
                yield (i, *rest)


def test_samples_are_gumbel_top_k():
    vocabulary = toy_vocabulary()
    every = list(segmentations(b" aba"))
    p = np.exp([vocabulary.weights[list(s)].sum() for s in every])
    p /= p.sum()
    n, first, pairs, weight = 20_000, collections.Counter(), collections.Counter(), 0.0
    data, offsets = np.frombuffer(b"aba" * n, np.uint8), np.arange(n + 1) * 3
    for samples in pieces.sample_pass(vocabulary, data, offsets, pieces.row_keys(pa.array(range(n)), 1), 3):
        found = [tuple(s[0].tolist()) for s in samples]
        assert len(set(found)) == 3 and [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        first[found[0]] += 1
        pairs[tuple(found[:2])] += 1
        weight += sum(math.exp(s[1] - s[3]) for s in samples)
    assert max(abs(first[s] / n - q) for s, q in zip(every, p)) < 0.015
    assert max(abs(pairs[a, b] / n - x * y / (1 - x)) for a, x in zip(every, p) for b, y in zip(every, p) if a != b) < 0.015
    assert abs(weight / n - 1) < 0.03  # the importance weights p / q are unbiased for the whole mass
    (all_of_them,) = pieces.sample_pass(vocabulary, data[:3], offsets[:2], pieces.row_keys(pa.array([1]), 1), 50)
    assert sorted(tuple(s[0].tolist()) for s in all_of_them) == sorted(every) and all(s[3] == 0 for s in all_of_them)


def test_encoding_is_exact_and_independent_of_batches(spark, docs, rows):
    odd = [(1000, "  two  blanks and ▁ mark\n\ttab é 漢字 🙂\x00"), (1001, ""), (1002, None), (1003, "a" * 3000), (None, "no id")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = pieces.encode_samples(frame, k=3).collect()
    assert all(r.round_trip for r in got)
    known = pieces.load_vocabulary()
    texts = dict(odd) | dict(rows)
    assert all(pieces.decode(r.pieces, known.pieces) == (texts[r.doc_id] or "").encode() for r in got)
    distinct = collections.Counter((r.doc_id, tuple(r.pieces)) for r in got)
    assert max(distinct.values()) == 1
    again = pieces.encode_samples(frame.repartition(7), k=3, pieces=False).collect()
    assert sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in again)
    assert sorted(r.sample for r in got if r.doc_id == 1001) == [1]


def test_licence_texts_are_found_however_they_are_wrapped(spark):
    from attestry.llm.licence_texts import KNOWN

    def wrapped(text, width):
        return "\n".join(textwrap.wrap(re.sub(r"\s+", " ", text), width, break_long_words=False))

    rows = []
    for n, (name, text) in enumerate(KNOWN):
        first, *rest = text.split("\n\n") if re.match(r"(?i)\s*(copyright|all rights)", text) else ["", text]
        for m, width in enumerate((40, 77, 100_000)):
            body = wrapped("\n\n".join(rest), width)
            rows.append((10 * n + m, "Copyright (c) 2011 Some Body\nAll rights reserved.\n\n" + body.replace(",", " ,").upper(), name))
    got = {r.doc_id: r.licence for r in licences.scan_licences(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), licences.builtin(spark)).collect()}
    names = {}
    for r in licences.known_digests(licences.builtin(spark)).collect():
        names.setdefault(r.licence, r.known)
    missing = {name for i, _, name in rows if got[i] != name and name in names}
    assert not missing
