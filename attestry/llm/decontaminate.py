"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and benchmark items are sequences of words; a document leaks an item if some stretch of it is within
``1 - similarity`` of the item's length in word edits. The CGK embedding walks over a sequence and
puts out the current word at every step, going on by a random bit of (step, word): sequences at a small
edit distance fall into step again, so their embeddings differ in few places. One repetition samples a
few places of the embedding as a key; windows and items with equal keys are candidates. Items are
embedded from each of their first ``STRIDE`` words, windows start at each ``STRIDE``-th word, so some window
starts exactly at a word of the item. Items of like length form a class, whose keys sample the steps
that an item of that length fills.

How many repetitions reach the target recall is measured: items are edited at random up to the threshold
and the share that one repetition finds is taken over all of them. Candidates are verified exactly,
by bit-parallel edit distance of the item to every stretch around the window.

Items are few and go to every task in blocks of at most ``BLOCK_ITEMS``, one pass over the documents for
each block; documents are read where they lie and never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bytes_hashes, flat, lowered, mixed, parts_for, passes, ship_package, table, text_of, words

SIMILARITY = 0.8
TARGET_RECALL = 0.97
STRIDE = 4
SAMPLED = 3
#: Text of a block of items, which the driver holds and whose index it builds.
BLOCK_BYTES = 8 << 20
#: Edited items on which the recall of one repetition is measured.
TRIALS = 240
MOST_REPETITIONS = 1000
_MAP = 1 << 16


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one zero after each text's last, and where texts begin."""
    low = lowered(data)
    starts, ends, rows = words(low, offsets)
    hashes = bytes_hashes(low, starts, ends) | np.uint64(1)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.zeros(begin[-1], np.uint64)
    out[np.arange(len(hashes)) + rows] = hashes
    return out, begin


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = flat(pa.array([t or "" for t in texts], pa.string()))
    hashes, begin = word_hashes(data, offsets)
    return [hashes[a : b - 1] for a, b in zip(begin[:-1], begin[1:])]


def edits_allowed(n_words: int, similarity: float) -> int:
    return int(math.floor((1 - similarity) * n_words + 1e-9))


def class_of(n_words: int) -> int:
    return int(2 * math.log2(n_words) + 1e-9)


def class_steps(number: int) -> int:
    """Steps that even the shortest item of a class fills, shifts taken off."""
    shortest = math.ceil(2 ** (number / 2) - 1e-9)
    return max(1, int(1.4 * max(1, shortest - STRIDE)))


@dataclass
class Keys:
    """Which steps each class samples in each repetition."""

    seed: int
    steps: dict[int, list[tuple[int, ...]]]

    def walk(self, tokens: np.ndarray, starts: np.ndarray, turn: int) -> dict[int, np.ndarray]:
        """Every class's key of this repetition for the windows at ``starts``."""
        wanted = defaultdict(list)
        for number, turns in self.steps.items():
            for step in turns[turn]:
                wanted[step].append(number)
        keys = {number: np.zeros(len(starts), np.uint64) for number in self.steps}
        place, bits = starts.copy(), None
        for step in range(max(wanted) + 1):
            for number in wanted.get(step, ()):
                keys[number] = (keys[number] + tokens[place]) * np.uint64(0x9E3779B97F4A7C15)
            if step % 64 == 0:
                bits = mixed(tokens ^ mixed(np.array([self.seed + 1009 * turn + step + 1], np.uint64)))
                bits[tokens == 0] = 0  # a text's end is never passed
            place += ((bits[place] >> np.uint64(step % 64)) & np.uint64(1)).astype(place.dtype)
        return {number: key ^ (key >> np.uint64(29)) for number, key in keys.items()}


def sampled_steps(classes: set[int], repetitions: int, seed: int) -> Keys:
    rng = np.random.default_rng(seed)
    return Keys(seed, {n: [tuple(sorted(int(s) for s in rng.choice(class_steps(n), min(SAMPLED, class_steps(n)), replace=False))) for _ in range(repetitions)] for n in sorted(classes)})


def edited(item: np.ndarray, edits: int, rng: np.random.Generator, pool: np.ndarray) -> np.ndarray:
    """The item after random substitutions, insertions and deletions of words."""
    out = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = pool[rng.integers(len(pool))]
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, pool[rng.integers(len(pool))])
    return np.array(out, np.uint64)


def repetitions_for(items: list[np.ndarray], similarity: float, target: float, seed: int) -> int:
    """Repetitions at which items edited as much as is allowed are found with the target
    probability, by the measured share of repetitions that find each."""
    rng, probe = np.random.default_rng(seed), 24
    keys = sampled_steps({class_of(len(i)) for i in items}, probe, seed)
    pool = np.concatenate(items)
    missed = []
    for trial in range(min(TRIALS, max(60, 3 * len(items)))):
        item = items[int(rng.integers(len(items)))]
        number = class_of(len(item))
        other = edited(item, edits_allowed(len(item), similarity), rng, pool)
        lead = int(rng.integers(STRIDE))
        text = np.concatenate([pool[rng.integers(len(pool), size=lead)], other, pool[rng.integers(len(pool), size=len(item))], [np.uint64(0)]])
        own = np.concatenate([item, [np.uint64(0)]])
        hits = 0
        only = Keys(keys.seed, {number: keys.steps[number]})
        for turn in range(probe):
            mine = only.walk(own, np.arange(min(STRIDE, len(item))), turn)[number]
            hits += bool(np.isin(only.walk(text, np.arange(0, len(text) - 1, STRIDE), turn)[number], mine).any())
        missed.append(1 - hits / probe)
    missed = np.array(missed)
    turns = next((r for r in range(1, MOST_REPETITIONS + 1) if (missed**r).mean() <= 1 - target), None)
    if turns is None:
        raise ValueError(f"{MOST_REPETITIONS} repetitions do not find {target:.2f} of the edited items; ask for a lower recall or a higher similarity")
    return turns


def nearest_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first
    such stretch ends: Myers' bit-vector recurrence on whole numbers."""
    m = len(item)
    peq: dict[int, int] = {}
    for j, word in enumerate(item.tolist()):
        peq[word] = peq.get(word, 0) | 1 << j
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text.tolist(), 1):
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | (~(xv | ph) & full)), ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Index:
    """Items of one block with their keys in every repetition."""

    def __init__(self, ids: list[int], items: list[np.ndarray], similarity: float, target: float, seed: int):
        self.ids, self.items, self.similarity = ids, items, similarity
        self.stride = STRIDE if min(len(i) for i in items) >= 2 * STRIDE else 1
        self.repetitions = repetitions_for(items, similarity, target, seed)
        self.keys = sampled_steps({class_of(len(i)) for i in items}, self.repetitions, seed)
        # Which 10-bit parts of hashes each item's words have: a word outside is in no item.
        self.present = np.zeros((len(items), 1024), bool)
        self.present[np.repeat(np.arange(len(items)), [len(i) for i in items]), (np.concatenate(items) >> np.uint64(20) & np.uint64(1023)).astype(np.int64)] = True
        self.tables: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        tokens = np.concatenate([np.append(i, np.uint64(0)) for i in items])
        begin = np.cumsum([0] + [len(i) + 1 for i in items])
        shifts = [min(STRIDE, len(i)) for i in items]
        starts = np.concatenate([begin[n] + np.arange(s) for n, s in enumerate(shifts)])
        owner = np.repeat(np.arange(len(items)), shifts)
        shift = starts - begin[owner]
        kind = np.array([class_of(len(i)) for i in items])[owner]
        for turn in range(self.repetitions):
            walked, tables = self.keys.walk(tokens, starts, turn), {}
            for number, key in walked.items():
                own = np.flatnonzero(kind == number)
                order = own[np.argsort(key[own])]
                present = np.zeros(_MAP, bool)
                present[(key[own] & np.uint64(_MAP - 1)).astype(np.int64)] = True
                tables[number] = present, key[order], owner[order], shift[order]
            self.tables.append(tables)

    def plausible(self, tokens: np.ndarray, begin: np.ndarray, row: np.ndarray, item: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Candidates some stretch of which has enough of the item's words; a stretch within the
        allowed edits keeps all but as many of its words, so no match is lost."""
        lengths = np.array([len(i) for i in self.items])
        allowed = np.array([edits_allowed(n, self.similarity) for n in lengths.tolist()])
        good = np.zeros(len(row), bool)
        order = np.argsort(lengths[item], kind="stable")
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            long, most = int(lengths[item[part[-1]]]), allowed[item[part]]
            reach = int(most.max())
            offset = np.arange(long + 4 * reach)
            at = first[part, None] - 2 * most[:, None] + offset
            inside = (at >= 0) & (at < (begin[row[part] + 1] - 1 - begin[row[part]])[:, None])
            word = tokens[np.where(inside, at + begin[row[part], None], 0)]
            hits = self.present[item[part, None], (word >> np.uint64(20) & np.uint64(1023)).astype(np.int64)] & inside
            sums = np.concatenate([np.zeros((len(part), 1), np.int32), np.cumsum(hits, axis=1, dtype=np.int32)], axis=1)
            span = min(long + reach, sums.shape[1] - 1)
            good[part] = (sums[:, span:] - sums[:, : sums.shape[1] - span]).max(axis=1) >= lengths[item[part]] - most
        return good

    def matches(self, tokens: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, distance, first word, end word): the nearest stretch, the first of
        several, for each text and item that are near enough."""
        counts = np.diff(begin) - 1
        windows = -(-counts // self.stride)
        rows = np.repeat(np.arange(len(counts)), windows)
        starts = begin[rows] + self.stride * (np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows))
        found = []
        for turn, tables in enumerate(self.tables):
            for number, key in self.keys.walk(tokens, starts, turn).items():
                present, sorted_keys, owner, shift = tables[number]
                near = np.flatnonzero(present[(key & np.uint64(_MAP - 1)).astype(np.int64)])
                low, high = np.searchsorted(sorted_keys, key[near]), np.searchsorted(sorted_keys, key[near], side="right")
                many = high - low
                at = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                row = np.repeat(rows[near], many)
                first = np.repeat(starts[near], many) - begin[row] - shift[at]
                found.append(np.stack([row, owner[at], first]))
        if not found:
            return
        row, item, first = np.concatenate(found, axis=1)
        _, one = np.unique((row * len(self.items) + item) * (1 << 31) + (first + (1 << 20)), return_index=True)
        one = one[self.plausible(tokens, begin, row[one], item[one], first[one])]
        row, item, first = row[one], item[one], first[one]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen_to: dict[tuple[int, int], int] = {}
        for r, n, at in zip(row.tolist(), item.tolist(), first.tolist()):
            words_of = self.items[n]
            allowed = edits_allowed(len(words_of), self.similarity)
            low, high = max(0, at - 2 * allowed), min(int(counts[r]), at + len(words_of) + 2 * allowed)
            if seen_to.get((r, n), -1) >= high or high - low < len(words_of) - allowed:
                continue
            # Candidates come by place; windows that overlap are looked at together once.
            seen_to[r, n] = high
            text = tokens[begin[r] + low : begin[r] + high]
            distance, end = nearest_stretch(words_of, text)
            if distance <= allowed and distance < best.get((r, n), (allowed + 1,))[0]:
                back, length = nearest_stretch(words_of[::-1], text[:end][::-1])
                best[r, n] = distance, low + end - length, low + end
        for (r, n), (distance, start, end) in best.items():
            yield r, self.ids[n], distance, start, end


def found_leaks(rows: DataFrame, benchmark: DataFrame, similarity: float, target_recall: float, seed: int) -> DataFrame:
    """(doc_id, key, item_id, distance, start_word, end_word) of rows (doc_id, key, text)."""
    spark = rows.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    blocks = parts_for(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], BLOCK_BYTES)
    found = spark.createDataFrame([], "doc_id long, key long, item_id long, distance int, start_word long, end_word long")
    for block in range(blocks):
        taken = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if not taken:
            continue
        known = spark.sparkContext.broadcast(Index([r.item_id for r in taken], text_words([r.text for r in taken]), similarity, target_recall, seed))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat(batch.column("text"))
                ids, keys, out = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), []
                for a, b in passes(offsets):
                    tokens, begin = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out += [(ids[a + r], keys[a + r], *rest) for r, *rest in known.value.matches(tokens, begin)]
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=found_names)

        found_names = found.columns
        found = found.unionByName(rows.select("doc_id", "key", "text").mapInArrow(run, found.schema))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, seed: int = 42) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): a row for each row of ``docs`` and item
    that it leaks, with the nearest stretch, the first of several.

    Words are what white space parts, A-Z in lower case. Texts that are null or have no words leak
    nothing; items that are null, have no words or no id leak nowhere; of items with one id each counts. A
    null doc_id is kept. Empty tables give no rows; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), "text")
    return found_leaks(rows, benchmark, similarity, target_recall, seed).drop("key")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go. A row is known by its id, null or not, and a hash
    of its text, so rows that share either alone are not taken along; columns of any name are handed on."""
    doc_id, key = F.col("doc_id").cast("long"), F.xxhash64(text_of())
    found = found_leaks(docs.select(doc_id.alias("doc_id"), key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), SIMILARITY, TARGET_RECALL, 42)
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("id"), key.alias("key"))
    left = rows.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
