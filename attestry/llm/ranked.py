"""Ranked lexical search by NRA: impact-sorted lists are read from the top, with no random access.

Documents stay where they are read. A task turns its share of them into segments of about ``SEGMENT_BYTES``:
how long each document is, and which of the items' terms it has how often. What the weights need from
the whole corpus (documents, terms, documents holding a term) is summed over segments. Then each segment
orders its terms' lists by impact and answers every item on its own:

- lists are read in lockstep, ever further; a document's lower bound is the sum of what was read of it, its
  upper bound adds for each list not yet seen in it the smallest impact read there;
- documents never met can be left aside once all smallest impacts together are less than the k-th lower bound,
  a met one once its upper bound is; from then on only the others' entries are taken from what is read;
- reading goes on until every document left has equal bounds, so that its score is final and ties are known.
  A list is read on only while some document left may be in it.

A document among the best of all is among the best of its segment, so only k rows for each item and
segment are ranked at the end. Items come in blocks of a bounded size, each a pass over the documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import PASS_BYTES, parts_for, ship_package, table, text_of, written

#: Text of a segment, and of a block of items (what the driver holds of them at once).
SEGMENT_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
#: Entries of each list that are read first; each further reading is twice as long.
FIRST_READ = 128
#: A-Z in lower case, and a blank for each byte that is in no term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SEGMENT = "documents long, terms long, doc_id array<long>, length array<long>, term array<int>, doc array<int>, tf array<int>, df_term array<int>, df array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


class Segment:
    """Documents of one task that have terms, and the items' terms in them."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        words = [terms_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        place = np.cumsum(counts > 0) - 1 + len(self.ids)
        number = np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, int(counts.sum()))
        doc = np.repeat(place, counts)
        known = number >= 0
        key, tf = np.unique(doc[known] * len(self.vocabulary) + number[known], return_counts=True)
        self.found.append(np.stack([key // len(self.vocabulary), key % len(self.vocabulary), tf]))
        self.ids += [i for i, n in zip(ids, counts.tolist()) if n]
        self.lengths += counts[counts > 0].tolist()
        self.size += sum(len(t or b"") for t in texts)

    def row(self) -> pa.RecordBatch:
        doc, term, tf = np.concatenate(self.found, axis=1) if self.found else np.zeros((3, 0), np.int64)
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        have, df = np.unique(term, return_counts=True)
        values = [len(self.ids), sum(self.lengths), self.ids, self.lengths, term, doc, tf, have, df]
        kinds = [pa.int64(), pa.int64(), *map(pa.list_, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()])]
        names = [field.split()[0] for field in SEGMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(known.value)
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id), texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= PASS_BYTES:
                    segment.add(ids, texts)
                    ids, texts, size = [], [], 0
            segment.add(ids, texts)
            if segment.size >= SEGMENT_BYTES:
                yield segment.row()
                segment = Segment(known.value)
        if segment.ids:
            yield segment.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SEGMENT)


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents and their scores by NRA over (documents, contributions) lists, each
    of falling contributions above 0; ties to the smaller ``tie``."""
    low = np.zeros(documents, np.int64)
    seen = np.zeros((len(lists), documents), bool)
    ends = np.array([len(d) for d, _ in lists])
    read = np.zeros(len(lists), np.int64)
    open_ = np.ones(len(lists), bool)
    alive, closed, step = None, False, FIRST_READ
    while True:
        for t in np.flatnonzero(open_ & (read < ends)).tolist():
            docs, gains = (x[read[t] : read[t] + step] for x in lists[t])
            if closed:
                mine = wanted[docs]
                docs, gains = docs[mine], gains[mine]
            low[docs] += gains
            seen[t, docs] = True
            read[t] = min(ends[t], read[t] + step)
        step *= 2
        bottom = np.array([gains[r - 1] if r < end else 0 for (_, gains), r, end in zip(lists, read.tolist(), ends.tolist())], np.int64)
        alive = np.flatnonzero(low) if alive is None or not closed else alive
        kth = np.partition(low[alive], len(alive) - k)[len(alive) - k] if len(alive) >= k else 0
        upper, wait = low[alive].copy(), np.zeros(len(lists), bool)
        for t in np.flatnonzero(bottom).tolist():
            upper += bottom[t] * ~seen[t, alive]
        near = upper >= kth
        alive, upper = alive[near], upper[near]
        # Whoever is met for the first time later on has all smallest impacts at most.
        closed = closed or int(bottom.sum()) < kth or not bottom.any()
        if closed and (upper == low[alive]).all():
            break
        if closed:
            wanted = np.zeros(documents, bool)
            wanted[alive] = True
            for t in np.flatnonzero(bottom).tolist():
                wait[t] = not seen[t, alive].all()
            open_ = wait
    best = alive[np.lexsort((tie[alive], -low[alive]))][:k]
    return best, low[best]


def answer(row: dict, items: list[tuple[int | None, list[int]]], weights: np.ndarray, documents: int, terms: int, k: int) -> Iterator[tuple[int | None, int | None, int]]:
    """(item, doc_id, score) of the best of one segment for every item."""
    ids, length = row["doc_id"], np.array(row["length"], np.int64)
    term, doc, tf = (np.asarray(row[name], np.int64) for name in ("term", "doc", "tf"))
    m = 50 + 50 * length * documents // terms
    gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
    some = gain > 0
    term, doc, gain = term[some], doc[some], gain[some]
    order = np.lexsort((-gain, term))
    term, doc, gain = term[order], doc[order].astype(np.int32), gain[order]
    edges = np.searchsorted(term, np.arange(len(weights) + 1))
    tie = np.empty(len(ids), np.int64)
    tie[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
    for item, wanted in items:
        lists = [(doc[edges[t] : edges[t + 1]], gain[edges[t] : edges[t + 1]]) for t in wanted if edges[t] < edges[t + 1]]
        if lists:
            best, scores = best_documents(lists, len(ids), tie, k)
            for d, score in zip(best.tolist(), scores.tolist()):
                yield item, ids[d], score


def ranked_block(docs: DataFrame, items: dict[int | None, set[bytes]], k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of every segment for the items of one block."""
    spark = docs.sparkSession
    vocabulary = {term: n for n, term in enumerate(sorted(set().union(*items.values())))}
    filed = written(segments(docs, vocabulary), "segments")
    documents, terms = filed.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    held = filed.select(F.explode(F.arrays_zip("df_term", "df")).alias("x")).groupBy("x.df_term").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.collect():  # the block's terms at most
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    asked = spark.sparkContext.broadcast(([(i, sorted(vocabulary[t] for t in terms)) for i, terms in items.items()], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: column[at].values.to_numpy(zero_copy_only=False) if name != "doc_id" else column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                found = list(zip(*answer(row, *asked.value, documents, terms, k))) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["item_id", "doc_id", "score"])

    return filed.select("doc_id", "length", "term", "doc", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest score above 0
    (all, if fewer), equal scores by ascending doc_id, null last.

    An item is all rows of one item_id (a null id is one too); each of its terms counts once. Every row of
    ``docs`` is a document, repeated ones and those without an id included. Texts that are null, empty or
    without terms are no documents and no items. Empty tables give no rows; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    blocks = parts_for(asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], BLOCK_BYTES)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        terms = defaultdict(set)
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            terms[row.item_id].update(terms_of(row.text.encode()))
        terms = {i: t for i, t in terms.items() if t}
        if terms:
            found = found.unionByName(ranked_block(docs, terms, k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark, sf_dir: str) -> DataFrame:
    """Each benchmark item's fifty best documents; nulls, ties and repeats as in ``ranked``."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH said AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM said WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, docs.doc_id, docs.d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * corpus.docs) // corpus.terms)))) AS BIGINT) AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (d), corpus GROUP BY ALL
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
