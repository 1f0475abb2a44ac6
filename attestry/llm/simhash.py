"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has a bit for each of 64 positions, set where over half of its word shingles' hashes
have it. Fingerprints that differ in few bits link. Equal ones are merged first, so trees hold distinct
fingerprints only.

Two fingerprints within r bits are within r // blocks bits on at least one of ``blocks`` stretches of the
64 bits, so there is a vantage-point tree for each stretch, searched with that small radius. A tree's
inner node holds a vantage point and a distance: nearer fingerprints go left, others right, and by the
triangle inequality a search need only enter the other side within the radius of the boundary. The upper
levels are fitted on a bounded sample (``SAMPLE``) and sent to all tasks; every fingerprint then goes to
its leaf as a resident and visits the leaves whose regions its ball overlaps (from the left of a boundary
only: of two linked ones on either side, one must visit). Leaves are shards; what outgrows
``CELL`` is cut into square cells of chunks by chunks, so no task holds a whole big leaf. A cell compares
all 64 bits and sends on a spanning forest of the links it found, at most one row a
fingerprint, from which a distributed union-find makes components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import flat, lowered, parts_for, passes, ship_package, words, written
from attestry.llm.components import components

SAMPLE = 16_384
LEAF = 2048
MOST_LEAVES = 4096
CELL = 16_384


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text of a pass, and how many each text has. A text with
    fewer words than ``width`` has its whole sequence as one, a text without words none."""
    low = lowered(data)
    starts, ends, rows = words(low, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    lengths = ends - starts
    # All words again, one blank between two, so a shingle is a stretch of bytes.
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 32, np.uint8)
    owner = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[begin[owner] + inside] = low[starts[owner] + inside]
    first = np.concatenate([[0], np.cumsum(counts)])
    shingles = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    at = np.repeat(first[:-1], shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + width, np.repeat(first[1:], shingles)) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(text[a:b], seed) for a, b in zip(begin[at].tolist(), (begin[last] + lengths[last]).tolist())], np.uint64, len(at))
    return hashes, shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints: the bits that over half of a text's hashes have."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts)
    octets = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    for i in some:
        part = octets[ends[i] - counts[i] : ends[i]]
        total = np.zeros(64, np.int64)
        for a in range(0, len(part), 255):
            total += np.unpackbits(part[a : a + 255], axis=1).sum(axis=0, dtype=np.uint8)
        out[i] = np.packbits(total * 2 > counts[i]).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): each text's fingerprint as a signed long; null is the empty text,
    whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            found = [majority(*shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)) for a, b in passes(offsets)]
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over the bits of ``mask``; leaves carry a number."""

    mask: int
    radius: int
    vantage: int = 0
    cut: int = -1
    left: Tree | None = None
    right: Tree | None = None
    leaf: int = -1

    def distance(self, points: np.ndarray) -> np.ndarray:
        return np.bitwise_count((points ^ np.uint64(self.vantage)) & np.uint64(self.mask))


def grow(sample: np.ndarray, mask: int, radius: int, leaves: int, counter: list[int]) -> Tree:
    """Split at the median distance from the member, of a few, that has the fewest
    others at the boundary, until the leaves are used up or nothing splits."""
    node = Tree(mask, radius)
    best = None
    if leaves > 1 and len(sample) > 1:
        for member in sample[:: max(1, len(sample) // 5)][:5]:
            d = np.bitwise_count((sample ^ member) & np.uint64(mask))
            cut = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            cut = cut - 1 if (d > cut).sum() == 0 else cut
            low = int((d <= cut).sum())
            if 0 < low < len(d):
                cost = int(((d > cut - radius) & (d <= cut + radius)).sum()) + abs(2 * low - len(d))
                if best is None or cost < best[0]:
                    best = cost, int(member), cut, d <= cut
    if best is None:
        node.leaf = counter[0]
        counter[0] += 1
        return node
    _, node.vantage, node.cut, near = best
    node.left = grow(sample[near], mask, radius, leaves // 2, counter)
    node.right = grow(sample[~near], mask, radius, leaves - leaves // 2, counter)
    return node


def route(node: Tree, points: np.ndarray, home: bool, out: list[tuple[int, bool, np.ndarray]]) -> None:
    """Residents go to their own leaf; where one is left of a boundary and within the
    radius of it, it also visits the right side, and from there every overlapped side."""
    if not len(points):
        return
    if node.left is None:
        out.append((node.leaf, home, points))
        return
    d = node.distance(points).astype(np.int64)
    if home:
        near = d <= node.cut
        route(node.left, points[near], True, out)
        route(node.right, points[~near], True, out)
        route(node.right, points[near & (d + node.radius > node.cut)], False, out)
    else:
        route(node.left, points[d - node.radius <= node.cut], False, out)
        route(node.right, points[d + node.radius > node.cut], False, out)


def forest(one: np.ndarray, one_home: np.ndarray, other: np.ndarray | None, other_home: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two chunks (or within one) as a spanning forest: members and the
    first member of their component. Two visitors need no comparing."""
    if other is None:  # residents first: only they are compared with what follows
        order = np.argsort(~one_home, kind="stable")
        points, homes, compared = one[order], one_home[order], int(one_home.sum())
    else:
        points, homes, compared = np.concatenate([one, other]), np.concatenate([one_home, other_home]), len(one)
    label = np.arange(len(points))
    for a in range(0, compared, 128):
        z = min(a + 128, compared)
        begin = a if other is None else len(one)
        close = np.bitwise_count(points[a:z, None] ^ points[None, begin:]) <= bits
        close &= homes[a:z, None] | homes[None, begin:]
        for i in np.flatnonzero(close.sum(axis=1) > (other is None)):
            touched = label[begin + np.flatnonzero(close[i])]
            least = min(int(touched.min()), int(label[a + i]))
            for stale in np.unique(np.append(touched, label[a + i])):
                if stale != least:
                    label[label == stale] = least
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the links within ``bits`` bits among
    distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    ship_package(spark)
    blocks = next(n for n in range(1, 65) if bits // n <= 1) if bits > 1 else 1
    radius = bits // blocks
    count = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    trees, edges = [], np.linspace(0, 64, blocks + 1).astype(int)
    leaves = min(MOST_LEAVES, parts_for(count, LEAF))
    counter = [0]
    for low, high in zip(edges[:-1], edges[1:]):
        trees.append(grow(sample, sum(1 << int(i) for i in range(low, high)), radius, leaves, counter))
    upper = spark.sparkContext.broadcast(trees)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            out: list[tuple[int, bool, np.ndarray]] = []
            for tree in upper.value:
                route(tree, points, True, out)
            leaf = np.concatenate([np.full(len(p), number, np.int32) for number, _, p in out])
            home = np.concatenate([np.full(len(p), is_home) for _, is_home, p in out])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), pa.array(np.concatenate([p for _, _, p in out]).view(np.int64))], names=["leaf", "home", "fp"])

    members = written(distinct.select("fp").mapInArrow(routed, "leaf int, home boolean, fp long"), "leaves")
    sizes = members.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    filed = members.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A chunk's rows go to the cells of its row and column; nearly all leaves have one cell.
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with")
    cells = filed.select("leaf", "home", "fp", "chunk", every).select("leaf", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "home", "fp", "chunk")

    def joined(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        chunk, low, high = table.column("chunk").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        # One fingerprint may come here from home and as a guest, in either order: nothing depends on it.
        if low == high:
            a, b = forest(points, home, None, None, bits)
        else:
            first = chunk == low
            a, b = forest(points[first], home[first], points[~first], home[~first], bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("leaf", "low", "high").applyInArrow(joined, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: its fingerprint and the smallest
    doc_id reachable over links, its own included.

    A null or empty text has fingerprint zero and links like any other. Rows with equal fingerprints are
    one component; a null doc_id is kept in its row and never the smallest unless the component has
    no other. Repeated rows are each answered; an empty table gives no rows; other columns are not read."""
    marked = written(fingerprints(docs, width), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, bits), name="simhash")
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
