"""Near copies of documents: exact Jaccard similarity of five-word shingles, candidates by SimHash trees.

A text is the set of its hashed shingles; texts of one set are merged first. A set has ``WORDS`` independent
64-bit fingerprints, and at the threshold of 0.8 two sets differ in a bit with probability
acos(2 * 0.8 / 1.8) / pi = 0.15. Every word's bits are cut into ``STRETCHES``, each with a vantage-point tree
that is searched with radius 1: a pair meets in one of ten trees with probability 0.99. Pairs that
meet are candidates within ``BITS`` of all bits (3.3 standard deviations above what is expected). In a leaf a
set meets only those that differ from it in at most ``REACH`` bits of the stretch, about one in ninety.

Candidates are verified by their sets, so no chance link joins two texts. No group puts out all its pairs:
in a round each text names its nearest candidates outside its component (1, then 4, then 16, ...); those not
tested yet are verified and merged. A text without an untested candidate outside its component is settled,
and only the others are filed again; rounds end when all are settled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import flat, mixed, parts_for, passes, ship_package, text_of, written
from attestry.llm.components import components
from attestry.llm.linededup import jaccard
from attestry.llm.simhash import MOST_LEAVES, SAMPLE, Tree, grow, majority, shingle_hashes

WIDTH, THRESHOLD = 5, 0.8
WORDS, STRETCHES, RADIUS = 2, 5, 1
BITS = 33
# Sets of a leaf are compared where they differ in so many bits of its stretch, one more than trees are searched with.
REACH = 2
# Leaves only deal sets out, so they are few: each set visits fewer, and their number is the same for small tables.
LEAF, LEAST_LEAVES, CELL = 16_384, 32, 262_144
# Pairs compared at a time.
AREA = 1 << 20
TURNS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
POINTS = [f"p{k}" for k in range(WORDS)]


def sets_of(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Passes of texts as their sorted distinct shingle hashes."""
    data, offsets = flat(column)
    for a, b in passes(offsets):
        hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WIDTH)
        ends = np.cumsum(counts)
        yield [np.unique(hashes[end - n : end]) for n, end in zip(counts.tolist(), ends.tolist())]


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sid, p0, p1): of every row a hash of its text, of its set, and the set's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, points = [], [[] for _ in POINTS]
            for sets in sets_of(batch.column("text")):
                sids += [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                together, counts = np.concatenate(sets), np.array([len(s) for s in sets])
                for k, found in enumerate(points):
                    found.append(majority(mixed(together ^ TURNS[k]), counts))
            columns = [np.array(sids, np.uint64), *[np.concatenate(p) if p else np.zeros(0, np.uint64) for p in points]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *[pa.array(c.view(np.int64)) for c in columns]], names=["doc_id", "key", "sid", *POINTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, sid long, p0 long, p1 long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, set) of the texts whose hashes are the ``key`` of the wanted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in sets_of(batch.column("text")) for s in part]
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), lists], names=["sid", "set"])

    texts = docs.select(F.xxhash64(text_of()).alias("key"), "text").join(wanted, "key").dropDuplicates(["sid"])
    return texts.select("sid", "text").mapInArrow(run, "sid long, set array<long>")


def visits(node: Tree, points: np.ndarray, rows: np.ndarray, home: bool, out: list[tuple[int, bool, np.ndarray]]) -> None:
    """As simhash.route, but with the numbers of the points."""
    if not len(rows):
        return
    if node.left is None:
        out.append((node.leaf, home, rows))
        return
    d = node.distance(points[rows]).astype(np.int64)
    left, right = d - node.radius <= node.cut, d + node.radius > node.cut
    if home:
        near = d <= node.cut
        visits(node.left, points, rows[near], True, out)
        visits(node.right, points, rows[~near], True, out)
        visits(node.right, points, rows[near & right], False, out)
    else:
        visits(node.left, points, rows[left], False, out)
        visits(node.right, points, rows[right], False, out)


def trees(distinct: DataFrame) -> list[tuple[int, Tree]]:
    """A vantage-point tree for each stretch of each fingerprint, grown on a bounded sample."""
    count = distinct.count()
    drawn = distinct.select(*POINTS).orderBy(F.xxhash64(*POINTS), *POINTS).limit(SAMPLE).collect()
    leaves, counter, grown = min(MOST_LEAVES, max(LEAST_LEAVES, parts_for(count, LEAF))), [0], []
    edges = np.linspace(0, 64, STRETCHES + 1).astype(int)
    for k, name in enumerate(POINTS):
        sample = np.unique(np.array([r[name] for r in drawn], np.int64).view(np.uint64))
        for low, high in zip(edges[:-1], edges[1:]):
            grown.append((k, grow(sample, sum(1 << int(i) for i in range(low, high)), RADIUS, leaves, counter)))
    return grown


def first_leaf(node: Tree) -> int:
    return node.leaf if node.left is None else first_leaf(node.left)


def filed(sets: DataFrame, upper) -> DataFrame:
    """(leaf, home, sid, label, p0, p1): every set in its own leaf of each tree and in those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                points = [part.column(name).to_numpy(zero_copy_only=False).view(np.uint64) for name in POINTS]
                for k, tree in upper.value:
                    out: list[tuple[int, bool, np.ndarray]] = []
                    visits(tree, points[k], np.arange(part.num_rows), True, out)
                    leaf = np.concatenate([np.full(len(rows), number, np.int32) for number, _, rows in out])
                    home = np.concatenate([np.full(len(rows), is_home) for _, is_home, rows in out])
                    moved = part.take(pa.array(np.concatenate([rows for _, _, rows in out])))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), *moved.columns], names=["leaf", "home", "sid", "label", *POINTS])

    return sets.select("sid", "label", *POINTS).mapInArrow(run, "leaf int, home boolean, sid long, label long, p0 long, p1 long")


def first_of_each(src: np.ndarray, dst: np.ndarray, d: np.ndarray, sid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every source the ``most`` nearest targets, of equal distance those of the smallest sid."""
    order = np.lexsort((sid[dst], d, src))
    src, dst, d = src[order], dst[order], d[order]
    begin = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, int)
    rank = np.arange(len(src)) - np.repeat(begin, np.diff(np.append(begin, len(src))))
    keep = rank < most
    return src[keep], dst[keep], d[keep]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of several stretches, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def nearest(table: pa.Table, most: int, tree: Callable[[int], tuple[int, int]]) -> pa.Table:
    """(a, b, d): what each set of a cell has nearest to it outside its component.

    Only sets are compared that differ in at most ``REACH`` bits of the stretch the cell's tree is over: those
    within the tree's radius are among them, and what a set is compared with does not grow with the leaf."""
    home = table.column("home").to_numpy(zero_copy_only=False)
    chunk, low, high = table.column("chunk").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
    word, mask = tree(table.column("leaf")[0].as_py())
    stretch = table.column(POINTS[word]).to_numpy().view(np.uint64) & np.uint64(mask)
    # Within one chunk residents meet all behind them; of two chunks the first meets the second.
    one = home if low == high else chunk == low
    order = np.lexsort((stretch, ~one))
    table, home, stretch, split = table.take(pa.array(order)), home[order], stretch[order], int(one.sum())
    sid, label = table.column("sid").to_numpy(), table.column("label").to_numpy()
    points = [table.column(name).to_numpy().view(np.uint64) for name in POINTS]
    values, starts, counts = np.unique(stretch[:split], return_index=True, return_counts=True)
    rest, behind, many = np.unique(stretch[split:], return_index=True, return_counts=True)
    none = np.zeros(0, np.int64)
    best, found, waiting = (none, none, none), [], 0
    for v, value in enumerate(values):
        close = np.flatnonzero(np.bitwise_count(rest ^ value) <= REACH)
        others = runs(behind[close] + split, many[close])
        if low == high:
            close = np.flatnonzero(np.bitwise_count(values[v:] ^ value) <= REACH) + v
            others = np.concatenate([runs(starts[close], counts[close]), others])
        if not len(others):
            continue
        theirs, step = [p[others] for p in points], max(1, AREA // len(others))
        for a in range(starts[v], starts[v] + counts[v], step):
            z = min(a + step, starts[v] + counts[v])
            d = sum(np.bitwise_count(p[a:z, None] ^ q[None, :]) for p, q in zip(points, theirs))
            near = d <= BITS
            if low != high:
                near &= home[a:z, None] | home[others][None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            far, i, j = d[i, j].astype(np.int64), i + a, others[j]
            fresh = label[i] != label[j]
            if low == high:
                fresh &= i < j
            i, j, far = i[fresh], j[fresh], far[fresh]
            found.append((np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])))
            waiting += 2 * len(i)
            if waiting > AREA:
                best, found, waiting = first_of_each(*(np.concatenate(x) for x in zip(best, *found)), sid, most), [], 0
    best = first_of_each(*(np.concatenate(x) for x in zip(best, *found)), sid, most)
    return pa.table({"a": sid[best[0]], "b": sid[best[1]], "d": best[2].astype(np.int32)})


def naming(most: int, spans: list[tuple[int, int, int]]) -> Callable[[pa.Table], pa.Table]:
    """``spans``: of each tree its first leaf, its word and the bits it is over."""
    def tree(leaf: int) -> tuple[int, int]:
        return next((word, mask) for first, word, mask in reversed(spans) if first <= leaf)

    return lambda table: nearest(table, most, tree)


def linked(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, component) of the sets that have a near copy.

    A set is settled once it has no candidate outside its component but tested ones; as candidates are
    mutual, later rounds are filed without it."""
    spark = distinct.sparkSession
    ship_package(spark)
    grown = trees(distinct)
    upper, spans = spark.sparkContext.broadcast(grown), [(first_leaf(tree), word, tree.mask) for word, tree in grown]
    active, most, tested, sets = distinct.withColumn("label", F.col("sid")), 1, None, None
    while True:
        members = written(filed(active, upper), "near-leaves")
        sizes = members.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
        dealt = members.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with")
        cells = dealt.select(*members.columns, "chunk", every).select("*", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high")).drop("with")
        found = cells.groupBy("leaf", "low", "high").applyInArrow(naming(most, spans), "a long, b long, d int").distinct()
        ranked = written(found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= most), "near-named")
        named = ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(named if tested is None else named.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")
        if sets is None:
            wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
            sets = written(shingle_sets(docs, distinct.select("key", "sid").join(wanted, "sid")), "near-sets")
        a, b = sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), sets.select(F.col("sid").alias("b"), F.col("set").alias("y"))
        checked = pairs.join(a, "a").join(b, "b").select("a", "b", (jaccard(F.col("x"), F.col("y")) >= THRESHOLD).alias("near"))
        checked = written(checked, "near-checked")
        tested = checked if tested is None else written(tested.unionByName(checked), "near-tested")
        links = components(tested.where("near"), name="near")
        # Whoever named something new, or was cut short, may have more.
        open_ = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(ranked.where(F.col("rank") == most).select("a")).distinct()
        labels = links.select(F.col("node").alias("sid"), F.col("component").alias("now"))
        active = written(active.drop("label").join(open_, "sid").join(labels, "sid", "left").select("sid", *POINTS, F.coalesce("now", "sid").alias("label")), "near-active")
        if active.isEmpty():
            return links
        most *= 4


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, key, least, component) for every row: a hash of its text, and of its component
    the smallest id and the name."""
    ship_package(docs.sparkSession)
    marked = written(marks(docs), "near-marks")
    distinct = written(marked.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *[F.min(p).alias(p) for p in POINTS]), "near-distinct")
    named = distinct.join(linked(docs, distinct).withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    return marked.join(named.drop("least").join(least, "component"), "sid").select("doc_id", "key", "least", "component")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: the smallest doc_id reachable over links of
    Jaccard similarity 0.8 or more, its own included.

    Texts without words have the same empty set. A null doc_id is kept in its row and never the
    smallest unless the component has no other. Repeated rows are each answered; an empty table gives no rows."""
    return labelled(docs).select("doc_id", F.col("least").alias("component_id"))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near copies one row stays, that with the smallest doc_id (rows without one
    come last), then the smallest hash of its text. Rows of one id are held apart by their texts; columns of
    any name are handed on."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    kept = labelled(docs).groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.key").alias("kept_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("key"))
    left = rows.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["id", "key"])
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
