"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their stratum (the source); the fraction
(rank - 1/2) / size of the stratum spreads every stratum evenly over [0, 1). Sorting all rows by that
fraction interleaves the strata in proportion, and cutting the order into equal runs gives shards that
each hold the mixture, within about one row a stratum, with row counts at most one apart.

Ranks are never taken in one task: rows fall into about sqrt(n) hash buckets, a row is numbered inside
its (stratum, bucket), and the counts of earlier buckets are added. A stratum that holds most rows is
split like any other; the counts' table has sqrt(n) rows a stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import text_of, written

#: Bytes that every row adds to the size of its text.
ROW_BYTES = 16


def numbered(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Rows with their number, from 1, in the order (bucket, *order) of their group."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    counts = counts.select(*group, bucket, (F.sum("_n").over(whole.orderBy(bucket)) - F.col("_n")).alias("_before"), *([F.sum("_n").over(whole).alias(total)] if total else []))
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return rows.withColumn("_inside", inside).join(counts, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def interleave(docs: DataFrame, shards: int = 40, seed: int = 42, id_column: str = "doc_id", stratum_column: str = "source", text_column: str = "text") -> DataFrame:
    """Each row's shard, its slot there (gapless from 0) and its rank in its stratum.

    A null stratum is a stratum of its own; a null id hashes like any value; a null text has no bytes
    and the CRC of none; an empty table gives no rows. Repeated rows each get a slot of their own: only
    their contents order them, so equal rows may swap. Other columns of ``docs`` are not read."""
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_column).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = written(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "interleave")
    count = rows.count()
    buckets = max(1, math.isqrt(count))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets)))
    ranked = numbered(rows, ["stratum"], "_bucket", ["_h", "doc_id", "text_crc32", "size"], "stratum_rank", "_of").drop("_bucket")
    ranked = ranked.withColumn("_fraction", (F.col("stratum_rank") - 0.5) / F.col("_of"))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_fraction") * buckets))
    placed = numbered(ranked, [], "_bucket", ["_fraction", "stratum", "stratum_rank"], "_place")
    whole = F.lit(max(1, count))
    place = (F.col("_place") - 1).cast("long")
    shard = F.expr(f"cast((_place - 1) * {shards} div {max(1, count)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {max(1, count)} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", place - first)
        .select("doc_id", "size", "text_crc32", "shard", "slot", F.when(F.length("stratum") > 0, F.expr("substring(stratum, 2)")).alias("stratum"), "stratum_rank", whole.alias("rows"))
    )


def op5_interleave(docs: DataFrame) -> DataFrame:
    """The sharding contract's columns, under its ``rows`` law."""
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"), "stratum_rank"
    )
