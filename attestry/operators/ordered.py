"""Order-dependent patterns that stay distributed when one key is hot.

A plain window sorts a whole key in one task. Here each key is cut into
buckets along its order column, buckets are summarised by a partial
aggregation, the summaries (one row per key and bucket) get the short window,
and what a bucket needs from those before it is joined back. No task holds
more than one bucket of one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket should hold, and how many buckets a key can have where it is cut by rows.
ROWS, QUANTILES = 4096, 256


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def bucketed(df: DataFrame, keys: list[str], at: str, size: int | None) -> DataFrame:
    """Rows with the bucket of their key they fall in: stretches of ``size`` where the order column
    is as dense as the rows (line numbers), else cuts at the key's own quantiles, so that a
    bucket holds about ``ROWS`` rows, or one of ``QUANTILES`` parts of a longer key, however close its
    times lie. Rows that tie share a bucket."""
    if size:
        return df.withColumn("_bucket", F.floor(F.col(at) / size))
    marks = [i / QUANTILES for i in range(1, QUANTILES)]
    told = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(at, marks, 10_000).alias("_cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES * ROWS) / F.col("_rows")))
    told = told.select(*keys, F.array_distinct(F.filter("_cuts", lambda e, i: (i + 1) % step == 0)).alias("_cuts"))
    left, right = df.alias("l"), told.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in keys])
    before = F.size(F.filter("r._cuts", lambda e: e < F.col(f"l.{at}")))
    return left.join(right, on).select("l.*", before.cast("long").alias("_bucket"))


def _with_carry(df: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """Join each bucket to what was carried into it; null keys stay together."""
    left, right = df.alias("l"), carry.alias("r")
    on = [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in [*keys, "_bucket"]]
    extra = [F.col(f"r.{name}") for name in carry.columns if name not in [*keys, "_bucket"]]
    condition = on[0]
    for term in on[1:]:
        condition = condition & term
    return left.join(right, condition, "left").select("l.*", *extra)


def row_numbers(df: DataFrame, keys: list[str], at: str, order: list[Column], out: str, size: int = 4096) -> DataFrame:
    """``row_number`` over (keys order by ``order``), whose first column is ``at``."""
    cut = bucketed(df, keys, at, size)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        _with_carry(cut.withColumn("_local", local), keys, offsets)
        .withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_local", "_offset", "_bucket")
    )


def previous(df: DataFrame, keys: list[str], at: str, order: list[str], payload: list[str], size: int | None = None) -> DataFrame:
    """``lag`` of the payload columns by one row, as ``prev_<name>`` columns."""
    cut = bucketed(df, keys, at, size)
    value = F.struct(*[F.col(name) for name in payload])
    rank = F.struct(*[F.col(name) for name in order])
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(value, rank).alias("_last"))
    carry = last.withColumn("_carry", F.last("_last").over(_earlier(keys))).drop("_last")
    local = F.lag(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    joined = _with_carry(cut.withColumn("_prev", local), keys, carry)
    joined = joined.withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select("*", *[F.col(f"_prev.{name}").alias(f"prev_{name}") for name in payload]).drop(
        "_prev", "_carry", "_bucket"
    )


def fill_forward(df: DataFrame, keys: list[str], at: str, names: list[str], size: int = 4096) -> DataFrame:
    """Replace nulls by the last non-null value at or before them, per column."""
    cut = bucketed(df, keys, at, size)
    last = cut.groupBy(*keys, "_bucket").agg(
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col(at))).alias(f"_last_{name}") for name in names]
    )
    carry = last.select(
        *keys, "_bucket",
        *[F.last(f"_last_{name}", ignorenulls=True).over(_earlier(keys)).alias(f"_carry_{name}") for name in names],
    )
    here = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.select(
        *[F.last(name, ignorenulls=True).over(here).alias(name) if name in names else F.col(name) for name in df.columns],
        "_bucket",
    )
    joined = _with_carry(filled, keys, carry)
    return joined.select(
        *[F.coalesce(name, f"_carry_{name}").alias(name) if name in names else F.col(name) for name in df.columns]
    )


def running_total(df: DataFrame, keys: list[str], at: str, amount: str, out: str, size: int = 4096) -> DataFrame:
    """Sum of ``amount`` from the key's first row to this one."""
    cut = bucketed(df, keys, at, size)
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    carry = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(_earlier(keys)), F.lit(0))).drop("_sum")
    here = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(cut.withColumn("_here", F.sum(amount).over(here)), keys, carry)
        .withColumn(out, F.col("_here") + F.coalesce("_carry", F.lit(0)))
        .drop("_here", "_carry", "_bucket")
    )


def last_two_at(
    events: DataFrame, marks: DataFrame, keys: list[str], event_at: str, mark_at: str,
    mark_order: list[str], payload: list[str], size: int | None = None,
) -> DataFrame:
    """Each event with the last mark at or before it (``last``) and the mark
    before that one (``before_last``), both structs of ``payload``."""
    prior = previous(marks, keys, mark_at, mark_order, payload, size)
    value = F.struct(
        F.struct(*[F.col(name) for name in payload]).alias("last"),
        F.struct(*[F.col(f"prev_{name}").alias(name) for name in payload]).alias("before_last"),
    )
    rank = F.struct(*[F.col(name) for name in mark_order])
    empty = F.lit(None)
    body = F.struct(*[F.col(name) for name in events.columns])
    line = prior.select(
        *keys, F.col(mark_at).alias("_t"), F.lit(0).alias("_o"), rank.alias("_rank"), value.alias("_mark"),
    ).unionByName(
        events.select(*keys, F.col(event_at).alias("_t"), F.lit(1).alias("_o"), body.alias("_event")),
        allowMissingColumns=True,
    )
    cut = bucketed(line, keys, "_t", size)
    ends = cut.filter("_o = 0").groupBy(*keys, "_bucket").agg(
        F.max_by("_mark", F.struct("_t", "_rank")).alias("_end")
    )
    # A bucket with events alone still needs its carry: every bucket is listed.
    buckets = cut.groupBy(*keys, "_bucket").agg(F.max("_o").alias("_any")).drop("_any")
    carry = _with_carry(buckets, keys, ends).withColumn(
        "_carry", F.last("_end", ignorenulls=True).over(_earlier(keys))
    ).drop("_end")
    here = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_o", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("_seen", F.last("_mark", ignorenulls=True).over(here)).filter("_o = 1")
    joined = _with_carry(seen, keys, carry).withColumn("_seen", F.coalesce("_seen", "_carry"))
    return joined.select("_event.*", F.col("_seen.last").alias("last"), F.col("_seen.before_last").alias("before_last"))


def sole_container(
    points: DataFrame, spans: DataFrame, keys: list[str], at: str,
    start: str, end: str, owner: str, size: int | None = None,
) -> DataFrame:
    """Each point with the owner of the one span of its key holding it.

    Null where no span holds it or several do. A sweep keeps the number of
    open spans and the XOR of their owners' hashes: where one is open, the XOR
    is that owner's hash, so no point–span pair is ever formed. Owners are
    unique within a key, and ``owner_count`` says how many spans were open.
    """
    mark = F.xxhash64(owner)
    body = F.struct(*[F.col(name) for name in points.columns])
    sweep = (
        spans.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d"), mark.alias("_h"))
        .unionByName(spans.select(*keys, F.col(end).alias("_t"), F.lit(2).alias("_o"), F.lit(-1).alias("_d"), mark.alias("_h")))
        .unionByName(
            points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_d"),
                          F.lit(0).cast("long").alias("_h"), body.alias("_point")),
            allowMissingColumns=True,
        )
    )
    cut = bucketed(sweep, keys, "_t", size)
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_d").alias("_d"), F.bit_xor("_h").alias("_h"))
    carry = sums.select(
        *keys, "_bucket",
        F.sum("_d").over(_earlier(keys)).alias("_open_before"), F.bit_xor("_h").over(_earlier(keys)).alias("_hash_before"),
    )
    here = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_o").rangeBetween(Window.unboundedPreceding, 0)
    seen = cut.select("*", F.sum("_d").over(here).alias("_open"), F.bit_xor("_h").over(here).alias("_hash")).filter("_o = 1")
    counted = _with_carry(seen, keys, carry).select(
        "_point.*",
        (F.col("_open") + F.coalesce("_open_before", F.lit(0))).alias("owner_count"),
        F.col("_hash").bitwiseXOR(F.coalesce("_hash_before", F.lit(0))).alias("_hash"),
    )
    owners = spans.select(*keys, F.col(owner).alias("_owner"), mark.alias("_hash"),
                          F.col(start).alias("_start"), F.col(end).alias("_end"))
    left = counted.withColumn("_hash", F.when(F.col("owner_count") == 1, F.col("_hash"))).alias("c")
    right = owners.alias("o")
    on = (F.col("c._hash") == F.col("o._hash")) & F.col(f"c.{at}").between(F.col("o._start"), F.col("o._end"))
    for name in keys:
        on = on & (F.col(f"c.{name}") == F.col(f"o.{name}"))
    return left.join(right, on, "left").select("c.*", F.col("o._owner").alias("owner")).drop("_hash")


def ranges(df: DataFrame, keys: list[str], at: str, size: int = 4096) -> DataFrame:
    """Runs of consecutive integers per key: ``start`` and ``end``.

    Runs are found inside each bucket; only those touching a bucket's edge, at
    most two per bucket, can be parts of a longer run and are joined up.
    """
    cut = bucketed(df.select(*keys, at).distinct(), keys, at, size)
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(at))
    parts = (
        cut.withColumn("_island", F.col(at) - place)
        .groupBy(*keys, "_bucket", "_island")
        .agg(F.min(at).alias("start"), F.max(at).alias("end"))
        .withColumn(
            "_edge",
            (F.col("start") == F.col("_bucket") * size) | (F.col("end") == F.col("_bucket") * size + size - 1),
        )
    )
    whole = parts.filter("not _edge").select(*keys, "start", "end")
    order = Window.partitionBy(*keys).orderBy("start")
    joins = F.coalesce(F.lag("end").over(order) + 1 == F.col("start"), F.lit(False))
    edges = (
        parts.filter("_edge").select(*keys, "start", "end", F.when(joins, 0).otherwise(1).alias("_new"))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    )
    return whole.unionByName(edges)


def _before(df: DataFrame, keys: list[str], split: str, summary: list[Column], carried: list[Column]) -> DataFrame:
    """Rows with what the splits before theirs come to: one summary row for each split."""
    totals = df.groupBy(*keys, split).agg(*summary)
    told = totals.select(*keys, split, *carried)
    return df.join(told, [*keys, split])


def split_numbers(df: DataFrame, keys: list[str], split: str, at: str, out: str) -> DataFrame:
    """Numbers from one along (split, at) of each key. A task holds one split, as a scan cut it."""
    earlier = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    placed = _before(df, keys, split, [F.count(F.lit(1)).alias("_n")], [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")])
    local = F.row_number().over(Window.partitionBy(*keys, split).orderBy(at))
    return placed.withColumn(out, F.col("_offset") + local).drop("_offset")


def fill_splits(df: DataFrame, keys: list[str], split: str, at: str, names: list[str]) -> DataFrame:
    """Replace nulls by the last value before them along (split, at) of each key, per column."""
    earlier = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    summary = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col(at))).alias(f"_last_{name}") for name in names]
    carried = [F.last(f"_last_{name}", ignorenulls=True).over(earlier).alias(f"_carry_{name}") for name in names]
    placed = _before(df, keys, split, summary, carried)
    along = Window.partitionBy(*keys, split).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    filled = {name: F.coalesce(F.last(name, ignorenulls=True).over(along), f"_carry_{name}") for name in names}
    return placed.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])
