"""Connected components as a distributed union-find, in DataFrame operations only.

Rounds of large-star and small-star: every node tells its larger neighbours its smallest one, then its
smaller ones, until each component is a star around its smallest node. Minima are partial aggregations
and neighbours are joined, never collected, so a node with any number of neighbours stays spread out.
Every round's edges are written to the shared folder: nothing is held on one executor, and the driver
sees only a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_written, written


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _minima(edges)
    moved = edges.join(near, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.select("u", F.col("m").alias("v")).unionByName(moved)


def components(edges: DataFrame, left: str = "a", right: str = "b", name: str = "components") -> DataFrame:
    """(node, component): each node of some edge between different nodes, with its component's
    smallest node. Edges with a null end, loops and repeats change nothing."""
    tidy = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    tidy = tidy.where(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    current = written(tidy, name)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = mark(current)
    while seen[0]:
        following = written(_small_star(_large_star(current).distinct()).distinct(), name)
        found = mark(following)
        drop_written(current)
        current = following
        if found == seen:
            break
        seen = found
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
