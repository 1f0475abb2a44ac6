"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots name the candidates.

A run is a maximal stretch of consecutive words with smallest period q and at least ``EXPONENT`` times q
(and ``SHORTEST``) words. By the runs theorem every run holds, for one of two opposite orders of the words, a
Lyndon word of its period that is the longest Lyndon word from its place on; that word ends at the next
smaller suffix. So each place gives one candidate root an order. Ukkonen's trees of the words and of
their reversal, toured once, answer in constant time (lowest common ancestor as a range minimum over the tour)
how far the root's two ends agree to the right and to the left; a root that extends far enough is a run.

Trees are only grown where runs can be. Every five words of a run occur again at distance q in the same
run, and q is at most a quarter of it; so a run lies within one stretch of places whose five words occur
again near by, and what it could be extended by lies there too. The stretches are found by one sort of a batch.

A document's words are exact (numbered by a dictionary of the batch); no row moves to another task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import PASS_BYTES, mixed, ship_package

SHORTEST, EXPONENT = 6, 4
#: Words that are looked up together; a run of SHORTEST words or more repeats each of its grams.
GRAM = 5

Words = list[bytes]
Run = tuple[int, int, int]


class SuffixTree:
    """Ukkonen's tree of whole numbers >= 0, closed by a symbol of its own that sorts first."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        size = len(text)
        start, stop, link, kids = [0], [0], [0], [{}]
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            bare = 0  # the inner node that still lacks its suffix link
            while waiting:
                if not length:
                    edge = i
                child = kids[node].get(text[edge])
                if child is None:
                    kids[node][text[edge]] = len(start)
                    start.append(i), stop.append(size), link.append(0), kids.append(None)
                    if bare:
                        link[bare] = node
                    bare = node
                else:
                    span = min(stop[child], i + 1) - start[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    at = start[child]
                    if text[at + length] == symbol:
                        length += 1
                        if bare:
                            link[bare] = node
                        break
                    fork = len(start)
                    start.append(at), stop.append(at + length), link.append(0), kids.append({text[at + length]: child, symbol: fork + 1})
                    start.append(i), stop.append(size), link.append(0), kids.append(None)
                    start[child] = at + length
                    kids[node][text[edge]] = fork
                    if bare:
                        link[bare] = fork
                    bare = fork
                waiting -= 1
                if node == 0 and length:
                    length, edge = length - 1, i - waiting + 1
                elif node:
                    node = link[node]
        self.size, self.start, self.stop, self.kids = size, start, stop, kids

    def tour(self, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and the depths at which the tour turns between them: the depth of
        the lowest common ancestor of each suffix and the one before it. ``turned`` takes the opposite order of symbols."""
        start, stop, kids, size = self.start, self.stop, self.kids, self.size
        suffixes, turns = [], []
        turn, stack = 0, [(0, 0, 0)]
        while stack:
            node, depth, above = stack.pop()
            if above < turn:
                turn = above
            if kids[node] is None:
                suffixes.append(start[node] - depth)
                turns.append(turn)
                turn = size
                continue
            depth += stop[node] - start[node]
            # The last pushed is toured first; the closing symbol stays first in both orders.
            order = sorted(kids[node], reverse=not turned)
            if turned and order[0] < 0:
                order.append(order.pop(0))
            stack += [(kids[node][s], depth, depth) for s in order]
        return np.array(suffixes), np.array(turns, np.int32)


class Extension:
    """Longest common extensions of two places: range minima over a tree's tour."""

    def __init__(self, suffixes: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        # Row k has the minima of 2**k turns from each on; what lies past the end is never read.
        self.table = np.repeat(turns[None], len(turns).bit_length(), axis=0)
        for k in range(1, len(self.table)):
            half = 2 ** (k - 1)
            np.minimum(self.table[k - 1, :-half], self.table[k - 1, half:], out=self.table[k, :-half])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from ``a`` and from ``b`` on, two different places."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high + 1 - (1 << level)]).astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the first later one of smaller rank; there is one, the closing symbol's."""
    found, stack, ranks = [0] * len(rank), [], rank.tolist()
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found[:-1], np.int64)


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of every run of one sequence of whole numbers >= 0."""
    n = len(symbols)
    if n < max(shortest, exponent):
        return []
    tree = SuffixTree(symbols.tolist())
    suffixes, turns = tree.tour()
    forth, back = Extension(suffixes, turns), Extension(*SuffixTree(symbols[::-1].tolist()).tour())
    other = np.empty(n + 1, np.int64)
    other[tree.tour(turned=True)[0]] = np.arange(n + 1)
    found: set[Run] = set()
    for rank in (forth.rank, other):
        end = next_smaller(rank)
        begin = np.flatnonzero((end - np.arange(n)) * exponent <= n)
        end = end[begin]
        period, left = end - begin, back(n - begin, n - end)
        length = left + forth(begin, end) + period
        long = length >= np.maximum(shortest, exponent * period)
        found.update(zip((begin - left)[long].tolist(), length[long].tolist(), period[long].tolist()))
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(symbols: np.ndarray, owner: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that hold all runs of the sequences laid end to end; ``owner``
    names the sequence of each symbol. Grams are told apart by hashes: chance makes a stretch longer, never shorter."""
    places = len(symbols) - GRAM + 1
    if places < 2:
        return []
    h = mixed(owner[:places].astype(np.uint64))
    for k in range(GRAM):
        h = mixed(h ^ symbols[k : places + k].astype(np.uint64)) + np.uint64(k + 1)
    order = np.argsort(h, kind="stable")
    again = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    apart = np.where(again, order[1:] - order[:-1], len(symbols))
    gap = np.full(places, len(symbols), np.int64)
    gap[order[1:]] = apart
    gap[order[:-1]] = np.minimum(gap[order[:-1]], apart)
    near = (gap < len(symbols)) & (owner[:places] == owner[GRAM - 1 :])
    while True:
        edge = near & np.concatenate([[True], ~near[:-1] | (owner[1:places] != owner[: places - 1])])
        begin = np.flatnonzero(edge)
        number = np.cumsum(edge) - 1
        length = np.bincount(number[near], minlength=len(begin)) + GRAM - 1
        keep = near.copy()
        keep[near] = (gap[near] * exponent <= length[number[near]]) & (length[number[near]] >= shortest)
        if keep.sum() == near.sum():
            return [(b, b + n) for b, n in zip(begin.tolist(), length.tolist())]
        near = keep


def kept_places(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    ends = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        ends[start + period] += 1
        ends[start + length] -= 1
    return np.cumsum(ends[:-1]) == 0


def batch_runs(texts: list[Words], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[list[Run]]:
    """Each text's runs, by start, then period."""
    counts = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    symbols = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    found: list[list[Run]] = [[] for _ in texts]
    for begin, end in stretches(symbols, owner, shortest, exponent):
        row = int(owner[begin])
        found[row] += [(begin + start - int(first[row]), length, period) for start, length, period in runs_of(symbols[begin:end], shortest, exponent)]
    return found


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, Words], Words] | None = None, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs``: its runs by start, then period, and the
    words outside all runs' repeats, joined by one space. ``rewrite`` may change a row's words first.

    ``shortest`` is 6 at least and ``exponent`` 4 (smaller runs need not repeat their grams). Words are what
    the white space of ASCII parts, taken as bytes. A text that is null, empty or blank has no words and no
    runs, and collapses to the empty text. Repeated rows are each answered alike; a null doc_id is kept; an
    empty table gives no rows; other columns are not read. A text is worked on whole, in one task."""
    if shortest < SHORTEST or exponent < EXPONENT:
        raise ValueError(f"runs shorter than {SHORTEST} words or {EXPONENT} periods are not found")
    ship_package(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answered(ids: list[int | None], texts: list[bytes | None]) -> pa.RecordBatch:
        words = [(t or b"").split() for t in texts]
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words)]
        found, collapsed = batch_runs(words, shortest, exponent), []
        for text, runs in zip(words, found):
            kept = [text[i] for i in np.flatnonzero(kept_places(len(text), runs)).tolist()] if runs else text
            collapsed.append(b" ".join(kept).decode("utf-8", "replace"))
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], kind)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc_id), texts.append(text)
                size += len(text or b"")
                if size >= PASS_BYTES:
                    yield answered(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield answered(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def echoed(doc_id: int | None, words: Words) -> Words:
    """The words as the query has them: every tenth document (by the crc32 of its id; a null id
    counts as an empty text) repeats a stretch of itself to its end."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def op13_runs(docs: DataFrame) -> DataFrame:
    """Each document's number of runs, its longest run (ties: smallest start, then period; four
    nulls without one), and digests of all runs and of what is left of its words. Nulls, empty texts,
    repeated rows and clashing columns: as ``periodic_runs``."""
    found = periodic_runs(docs, echoed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.expr("1000 * best.length div -best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
