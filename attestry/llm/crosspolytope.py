"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A vector's direction is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
filed under the nearest signed axis; a table's code joins as many of these as its number of bits asks for, the last over
fewer axes. A query looks into several buckets of each of ``TABLES`` tables, in the order of what its turned
coordinates lose by each axis against their best, and what it finds is ranked by exact distances.

How many bits a code has and how many buckets are probed is fitted: a bounded sample of the queries is compared with every
vector, and of all numbers of bits at which the sample's true neighbours are found with ``TARGET`` recall the one is
taken that costs least. The index itself holds every vector.

Equal vectors are one from the start, with the few smallest ids that any answer can need, and equal queries are
searched once. Buckets are cut into cells of bounded size on both sides, so a bucket of any size is spread over tasks. A
query for which the probes find too few vectors is compared with all of them, in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import ship_package, written

TABLES, TARGET = 4, 0.96
#: Queries the index is fitted on, and queries that are compared with all vectors at once.
SAMPLE, BLOCK = 192, 2048
#: Vectors and queries of a cell; probes of one table at most.
CELL, QUERY_CELL, MOST_PROBES = 4096, 512, 2048
#: What a probe costs, in comparisons of vectors.
PROBE_COST = 32


class Hashes:
    """Every table's functions for codes of ``bits`` bits over vectors of one dimension."""

    def __init__(self, dimension: int, bits: int, seed: int = 4):
        self.dimension, self.width = dimension, 1 << max(0, dimension - 1).bit_length()
        full = self.width.bit_length()  # a signed axis of all
        parts = [full] * (bits // full) + [bits % full] * (bits % full > 0)
        self.axes = [1 << (b - 1) for b in parts]
        rng = np.random.default_rng([seed, dimension])
        # Drawn for many functions at once, so that a code of fewer bits uses the same turns.
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (TABLES, 16, 3, self.width))

    def turned(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Signed coordinates under each function of a table: axes, then their opposites."""
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        flat = np.zeros((len(vectors), self.width), np.float32)
        flat[:, : self.dimension] = vectors / np.where(lengths > 0, lengths, 1)
        out = []
        for number, axes in enumerate(self.axes):
            y = flat
            for signs in self.signs[table, number]:
                y = y * signs
                half = 1
                while half < self.width:
                    y = y.reshape(len(flat), -1, 2, half)
                    y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2)
                    half *= 2
                y = y.reshape(len(flat), self.width) * np.float32(self.width**-0.5)
            out.append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
        return out

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for values in self.turned(vectors, table):
            code = code * values.shape[1] + values.argmax(axis=1)
        return code

    def probes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """Each vector's ``most`` likeliest codes (all, if fewer), the likeliest first."""
        loss, code = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
        for values in self.turned(vectors, table):
            lost = (values.max(axis=1, keepdims=True) - values.astype(np.float64)) ** 2
            order = np.argsort(lost, axis=1, kind="stable")[:, :most]
            # The j-th of one and the i-th of the other come after (i + 1)(j + 1) - 1 others.
            i, j = (x.ravel() for x in np.meshgrid(np.arange(loss.shape[1]), np.arange(order.shape[1]), indexing="ij"))
            can = (i + 1) * (j + 1) <= most
            i, j = i[can], j[can]
            loss, code = loss[:, i] + np.take_along_axis(lost, order, 1)[:, j], code[:, i] * values.shape[1] + order[:, j]
            best = np.argsort(loss, axis=1, kind="stable")[:, :most]
            loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
        return code


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed coordinate by coordinate."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def nearest_pairs(q: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of each query's k nearest, ties to smaller ``least``. Products
    choose whom to compare exactly, with room for their rounding."""
    rows, columns, far = [], [], []
    # Scaled and moved alike, so that products neither overflow nor drown what differs.
    scale = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) or 1.0
    q, v, q0, v0 = q / scale - v[:1] / scale, v / scale - v[:1] / scale, q, v
    norms = (v**2).sum(1)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = norms - 2 * part @ v.T + (part**2).sum(1)[:, None]
        if len(v) > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            near = rough <= limit + 1e-9 * (1 + limit)
        else:
            near = np.ones(rough.shape, bool)
        i, j = np.nonzero(near)
        d = distances(q0[a + i], v0[j])
        order = np.lexsort((least[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        rows.append(a + i[keep]), columns.append(j[keep]), far.append(d[keep])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(far)


FOUND = "qa long, qb long, a long, b long, ids array<long>, score double"
NONE = pa.table({n: pa.array([], pa.list_(pa.int64()) if n == "ids" else pa.float64() if n == "score" else pa.int64()) for n in ("qa", "qb", "a", "b", "ids", "score")})


def found_batch(q: pa.Table, v: pa.Table, k: int) -> pa.Table:
    """FOUND rows of the k nearest vectors of each query, of one cell or block."""
    least = v.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(v.column("ids").combine_chunks().value_lengths())
    i, j, d = nearest_pairs(matrix(q.column("vector").combine_chunks()), matrix(v.column("vector").combine_chunks()), least[np.cumsum(sizes) - sizes], k)
    q, v = q.select(["a", "b"]).take(pa.array(i)), v.select(["a", "b", "ids"]).take(pa.array(j))
    return pa.table([*q.columns, *v.columns, pa.array(d)], names=["qa", "qb", "a", "b", "ids", "score"])


def compared(vectors: DataFrame, queries: list, dimension: int, k: int) -> DataFrame:
    """FOUND rows: a bounded block of queries against every vector of its dimension."""
    block = pa.table({"a": [r.a for r in queries], "b": [r.b for r in queries], "vector": [r.vector for r in queries]})
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from found_batch(sent.value, pa.Table.from_batches([batch]), k).to_batches() if batch.num_rows else ()

    return nearest_of(vectors.where(F.size("vector") == dimension).select("a", "b", "ids", "vector").mapInArrow(run, FOUND), k)


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest different vectors, ties to the smaller first id."""
    rank = F.row_number().over(Window.partitionBy("qa", "qb").orderBy("score", F.col("ids")[0]))
    return found.dropDuplicates(["qa", "qb", "a", "b"]).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def fitted(vectors: DataFrame, sample: list, dimension: int, count: int, k: int) -> tuple[Hashes, int]:
    """The hashes and number of probes that reach the target on the sample at least cost."""
    others = compared(vectors, sample, dimension, k + 1).where((F.col("a") != F.col("qa")) | (F.col("b") != F.col("qb"))).select("qa", "qb", "a", "b", "score")
    rank = F.row_number().over(Window.partitionBy("qa", "qb").orderBy("score"))
    true = others.withColumn("rank", rank).where(F.col("rank") <= k).join(vectors.select("a", "b", "vector"), ["a", "b"]).select("qa", "qb", "vector").collect()
    place = {(r.a, r.b): n for n, r in enumerate(sample)}
    asked, near = np.array([r.vector for r in sample], np.float64), np.array([r.vector for r in true], np.float64).reshape(-1, dimension)
    owner = np.array([place[r.qa, r.qb] for r in true], np.int64)
    best = None
    for bits in range(2, max(3, int(count / 16).bit_length() + 1)):
        hashes = Hashes(dimension, bits)
        most = min(MOST_PROBES, 1 << bits)
        turn = np.full(len(near), most)
        for table in range(TABLES):
            hit = hashes.probes(asked, table, most)[owner] == hashes.codes(near, table)[:, None]
            turn = np.minimum(turn, np.where(hit.any(axis=1), hit.argmax(axis=1), most)) if len(near) else turn
        probes = 1 + (int(np.sort(turn)[int(np.ceil(TARGET * len(turn))) - 1]) if len(turn) else 0)
        if probes <= most:
            cost = probes * (count / 2**bits + PROBE_COST)
            best = min(best, (cost, bits, probes)) if best else (cost, bits, probes)
    return Hashes(dimension, best[1]), best[2]


def tabled(rows: DataFrame, hashes: Hashes, probes: int | None) -> DataFrame:
    """Every row once for each table and code: a vector's own, or those a query probes."""
    sent = rows.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                x = matrix(part.column("vector"))
                for table in range(TABLES):
                    codes = sent.value.codes(x, table)[:, None] if probes is None else sent.value.probes(x, table, probes)
                    moved = part.take(pa.array(np.repeat(np.arange(len(x)), codes.shape[1])))
                    numbers = pa.array(np.full(codes.size, table, np.int32)), pa.array(codes.ravel())
                    yield pa.RecordBatch.from_arrays([*numbers, *moved.columns], names=["table", "code", *part.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"table int, code long, {kinds}")


def probed(vectors: DataFrame, queries: DataFrame, hashes: Hashes, probes: int, k: int) -> DataFrame:
    """FOUND rows: the k nearest of what each query's probes find, table by table and cell by cell."""
    filed = written(tabled(vectors.select("a", "b", "ids", "vector"), hashes, None), "ann-index")
    asked = written(tabled(queries.select("a", "b", "vector"), hashes, probes), "ann-probes")
    bucket = ["table", "code"]
    sizes = filed.groupBy(bucket).agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    sizes = sizes.join(asked.groupBy(bucket).agg(F.ceil(F.count("*") / QUERY_CELL).cast("int").alias("parts")), bucket)

    def cells(rows: DataFrame, own: str, other: str, asking: bool) -> DataFrame:
        dealt = rows.join(sizes, bucket).withColumn(own, F.pmod(F.xxhash64("b"), F.col(own)).cast("int"))
        ids = F.lit(None).cast("array<long>").alias("ids") if asking else "ids"
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_{other}")
        return dealt.select(*bucket, own, each, F.lit(asking).alias("asking"), "a", "b", ids, "vector").withColumnRenamed(f"_{other}", other)

    def search(cell: pa.Table) -> pa.Table:
        asking = cell.column("asking")
        q, v = cell.filter(asking), cell.filter(pa.compute.invert(asking))
        return found_batch(q, v, k) if q.num_rows and v.num_rows else NONE

    both = cells(filed, "chunks", "parts", False).unionByName(cells(asked, "parts", "chunks", True))
    return nearest_of(both.groupBy(*bucket, "chunks", "parts").applyInArrow(search, FOUND), k)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, a, b, vector) of the rows that take part; a and b are two hashes of the vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    same = F.transform("vector", lambda x: x + F.lit(0).cast("float"))  # -0 is 0
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), same.alias("vector")).select("vec_id", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(11), "vector").alias("b"), "vector")


def neighbours(vectors: DataFrame, wanted: Column, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of ``vectors`` (vec_id, vector) that meets
    ``wanted``, the k nearest other rows found, by Euclidean distance in doubles, ties to the smaller vec_id.

    All other rows of its dimension are answered where they are no more than k. Rows without an id and
    vectors that are null, empty, all zero or hold a null or non-finite component take no part. Only a
    query's own row is left out: other rows of its id or its vector are candidates, and repeated query rows are each
    answered. An empty table gives no rows; other columns are not read."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = clean(vectors)
    # Of equal vectors no answer can name more than the k + 1 smallest ids.
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    distinct = written(few.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")), "ann-vectors")
    asking = written(rows.where(wanted).select("vec_id", "a", "b"), "ann-queries")
    queries = written(distinct.join(asking.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "vector"), "ann-asked")
    found = None
    for dimension, count in sorted(distinct.groupBy(F.size("vector")).count().collect()):
        of = F.size("vector") == dimension
        sample = queries.where(of).orderBy("a", "b").limit(SAMPLE).collect()
        if not sample:
            continue
        hashes, probes = fitted(distinct, sample, dimension, count, k)
        near = written(probed(distinct.where(of), queries.where(of), hashes, probes, k + 1), "ann-found")
        counts = near.groupBy("qa", "qb").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"))
        short = queries.where(of).join(counts, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb")), "left")
        short = written(short.where((F.coalesce("ids", F.lit(0)) <= k) & (F.coalesce("n", F.lit(0)) < count)).select("a", "b", "vector"), "ann-short")
        blocks = -(-short.count() // BLOCK)
        for block in range(blocks):
            taken = short.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == block).collect()
            near = near.unionByName(compared(distinct, taken, dimension, k + 1)) if taken else near
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    listed = nearest_of(found, k + 1).select("qa", "qb", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("qa", "qb").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    answer = listed.groupBy("qa", "qb").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    answer = asking.join(answer, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).select(F.col("vec_id").alias("query_id"), "near")
    own = F.coalesce(F.array_min(F.transform(F.filter("near", lambda x: (x["score"] == 0) & (x["vec_id"] == F.col("query_id"))), lambda x: x["place"])), F.lit(k + 1))
    rest = answer.select("query_id", F.filter("near", lambda x: x["place"] != own).alias("near"))
    return rest.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op11_neighbours(embeddings: DataFrame) -> DataFrame:
    """Each hundredth vector's ten nearest others found; nulls, ties and repeats as in ``neighbours``."""
    return neighbours(embeddings.select("vec_id", F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0, 10)
