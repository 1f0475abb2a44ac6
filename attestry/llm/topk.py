"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length into buckets and packed into blocks of bounded size. Every query first
gets a lower bound of its k-th best product from a bounded set of seeds (the longest vectors and some
by hash; the bound only prunes, so any seeds give the same result). In a bucket whose longest vector
has length l, a query can only be interested in vectors whose cosine reaches bound / (|q| l), the
bucket's local threshold. Over 1 the whole bucket is skipped. A high threshold is met by coordinate
pruning: the query's largest coordinates bound the interval in which a vector's same coordinate must
lie. A low one leaves length pruning: only vectors of length bound / |q| or more are looked at. What is
left is verified by exact products of integers.

Blocks of queries meet blocks of vectors by joins on block keys; no task holds more than a block of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attestry.llm.common import parts_for, ship_package, with_fields, written

LONGEST, HASHED = 512, 1536
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 512
MOST_BUCKETS = 256
#: Local cosine thresholds from which the coordinates prune; FOCUS of them are looked at.
COORDINATE_FROM, FOCUS = 0.55, 3
SLACK = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` with the rows of ``b``."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def unpack(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and the matrix of one packed block."""
    packed = column[row].values
    rows, ids = (packed.field(name).to_numpy(zero_copy_only=False) for name in ("row", "vec_id"))
    vectors = packed.field("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, ids, flat.reshape(len(ids), -1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_block(q_rows: np.ndarray, q: np.ndarray, bounds: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query row, vec_id, product) of the best k of a block for each query but its own row, less
    what the query's bound proves to be too small."""
    lengths = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((v_ids, -lengths))
    v, v_rows, v_ids, lengths = v[order], v_rows[order], v_ids[order], lengths[order]
    units = v / np.maximum(lengths, 1e-300)[:, None]
    q_lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    reach = q_lengths * lengths[0]
    local = np.where(reach > 0, bounds / np.maximum(reach, 1e-300), np.where(bounds > 0, 2.0, -1.0))
    alive = local <= 1 + SLACK
    by_coordinate = alive & (local >= COORDINATE_FROM)
    by_length = np.flatnonzero(alive & ~by_coordinate)
    if len(by_length):
        needed = bounds[by_length] / np.maximum(q_lengths[by_length], 1e-300)
        longest = int(np.searchsorted(-lengths, -(needed.min() * (1 - SLACK)), side="right")) if needed.min() > 0 else len(v)
        scores = products(q[by_length], v[:longest])
        for i, row in zip(by_length, scores):
            near = np.flatnonzero((row >= bounds[i]) & (v_rows[:longest] != q_rows[i]))
            for j in near[best_of(v_ids[near], row[near], k)]:
                yield q_rows[i], v_ids[j], row[j]
    sorted_coordinates: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in np.flatnonzero(by_coordinate):
        unit, threshold = q[i] / max(q_lengths[i], 1e-300), min(1.0, local[i])
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        inside = None
        for f in focus:
            spread = math.sqrt(max(0.0, 1 - threshold**2) * max(0.0, 1 - unit[f] ** 2))
            # A vector of cosine t or more has this coordinate between the two ends; the end
            # opens to 1 (or -1) where the query's own coordinate is past the threshold.
            high = 1.0 if unit[f] >= threshold else unit[f] * threshold + spread
            low = -1.0 if unit[f] <= -threshold else unit[f] * threshold - spread
            if inside is None:
                if f not in sorted_coordinates:
                    by = np.argsort(units[:, f], kind="stable")
                    sorted_coordinates[f] = by, units[by, f]
                by, values = sorted_coordinates[f]
                inside = by[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, side="right")]
            else:
                here = units[inside, f]
                inside = inside[(here >= low - 1e-7) & (here <= high + 1e-7)]
        inside = inside[(lengths[inside] * q_lengths[i] >= bounds[i] * (1 - SLACK)) & (v_rows[inside] != q_rows[i])]
        if len(inside):
            row = products(q[i : i + 1], v[inside])[0]
            near = row >= bounds[i]
            inside, row = inside[near], row[near]
            for j in best_of(v_ids[inside], row, k):
                yield q_rows[i], v_ids[inside[j]], row[j]


def top_k(vectors: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of ``vectors`` (vec_id long, vector array<long>)
    that meets ``wanted``, the k highest products among all other rows, ties to the smaller vec_id; all of them, if fewer.

    Rows with a null id, a null or empty vector or a null component take no part. Only a query's own row is
    left out: other rows of its id are candidates, rows repeated as a whole count as often as they come, and
    repeated query rows are each answered. Vectors only meet vectors of their own dimension. An empty table gives no rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # No answer names more than k + 1 copies of a row; one of them is the row itself.
    copies = good.groupBy("vec_id", "vector").agg(F.count("*").alias("times"))
    copies = copies.select("*", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k + 1)))).alias("copy"))
    rows = written(copies.select("vec_id", "vector", "copy", "times", F.size("vector").alias("dim"), length.alias("length"), F.monotonically_increasing_id().alias("row")), "vectors")
    longest = rows.orderBy(F.desc("length"), "vec_id").limit(LONGEST).select("row", "vector").collect()
    hashed = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(HASHED).select("row", "vector").collect()
    seeds: dict[int, tuple[list[int], list[list[int]]]] = {}
    for row, vector in {r.row: r.vector for r in [*longest, *hashed]}.items():
        numbers, matrix = seeds.setdefault(len(vector), ([], []))
        numbers.append(row)
        matrix.append(vector)
    packed_seeds = spark.sparkContext.broadcast({d: (np.array(i), np.array(m, dtype=np.int64)) for d, (i, m) in seeds.items()})

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for own, vector in zip(batch.column("row").to_pylist(), batch.column("vector").to_pylist()):
                numbers, matrix = packed_seeds.value.get(len(vector), (np.zeros(0, np.int64), None))
                others = np.flatnonzero(numbers != own)
                if len(others) < k:
                    bounds.append(-math.inf)
                else:
                    found = products(np.array([vector], dtype=np.int64), matrix[others])[0]
                    bounds.append(float(np.partition(found, len(found) - k)[len(found) - k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=[*batch.schema.names, "bound"])

    queries = rows.where(wanted & (F.col("copy") == 1)).drop("copy")
    parts = parts_for(queries.count(), BLOCK_QUERIES)
    asked = queries.mapInArrow(bounded, with_fields(queries.schema, bound=DoubleType())).withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    asked = asked.groupBy("dim", "_part").agg(
        F.collect_list(F.struct("row", "vec_id", "vector", "bound")).alias("asked"), F.min(F.when(F.col("length") > 0, F.col("bound") / F.col("length")).otherwise(F.lit(-math.inf))).alias("needed")
    )
    count, ends = rows.agg(F.count("*"), F.percentile_approx("length", [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)], 10_000)).first()
    ends = sorted(set(ends or []))
    step = max(1, math.ceil(len(ends) / parts_for(count, BLOCK_VECTORS)))
    ends = ends[step - 1 :: step]
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e < F.col("length"))) if ends else F.lit(0)
    filed = rows.withColumn("_bucket", bucket)
    most = filed.groupBy("dim", "_bucket").count().agg(F.max("count")).first()[0] or 0
    # Equal lengths share a bucket however many they are: it is cut into blocks by a hash.
    filed = filed.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(parts_for(most, BLOCK_VECTORS, 1))))
    blocks = filed.groupBy("dim", "_bucket", "_block").agg(F.collect_list(F.struct("row", "vec_id", "vector")).alias("vectors"), F.max("length").alias("reach"))
    blocks = written(blocks, "blocks")
    # Only the blocks' keys are repeated for each part of the queries; what a whole part
    # can prove to be too short is dropped before any vector moves.
    heads = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_bucket", "_block", "reach")
    meeting = asked.join(heads, ["dim", "_part"]).where(F.col("reach") * (1 + SLACK) >= F.col("needed")).select("dim", "_bucket", "_block", "asked")
    pairs = meeting.join(blocks.drop("reach"), ["dim", "_bucket", "_block"]).select("asked", "vectors")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_rows, _, q = unpack(batch.column("asked"), row)
                bounds = batch.column("asked")[row].values.field("bound").to_numpy(zero_copy_only=False)
                found = list(search_block(q_rows, q, bounds, *unpack(batch.column("vectors"), row), k))
                yield pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in range(3)], names=["query_row", "vec_id", "score"])

    near = pairs.mapInArrow(searched, "query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), "times")).alias("time"))
    return best.join(named, "query_row").select("query_id", "rank", "vec_id", "score")


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) with every component x as floor(256 * x), x as double. A vector that
    is null, or holds a null or non-finite component, is left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform(x, lambda e: F.floor(e * 256)).alias("vector"))


def op4_topk(embeddings: DataFrame) -> DataFrame:
    """Each 50th vector's five highest integer products among all others."""
    vectors = whole_numbers(embeddings)
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH whole AS (
  SELECT row_number() OVER () AS at, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.at, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.at <> q.at WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY at ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
