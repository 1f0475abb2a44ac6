"""Runs as rows: catalogue, choice, comparison, merging, pairing in time.

``runs`` carry the fingerprint columns named in DOMAINS beside run_id and
started_ms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.paths import beside_the_tests, configuration_file, dependency_file
from attestry.operators.selection import NoMatch
from attestry.operators.timing import separate_repeats

# Fingerprint columns with their names in a merge and in a stale run.
DOMAINS = {
    "schema_version": ("coverage schema", "coverage schema changed"),
    "instrumenter": ("instrumenter", "instrumenter contract changed"),
    "source": ("source", "instrumented source changed"),
    "tests_digest": ("tests", "test files changed"),
    "dependencies": ("dependencies", "dependencies or lockfile changed"),
    "configuration": ("configuration", "test/build configuration changed"),
}


def catalogue(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid runs newest first, and rejected ones with the reason.

    ``read`` is a permissive scan: run_id, started_at and ``corrupt``, the text
    of a document that did not parse."""
    reason = (
        F.when(F.col("corrupt").isNotNull(), "run metadata is not valid JSON")
        .when(F.col("run_id").isNull(), "run metadata has no id")
        .when(F.col("started_at").isNull(), "run metadata has no start")
    )
    told = read.withColumn("reason", reason)
    valid = told.filter("reason is null").drop("reason", "corrupt")
    return newest_first(valid, "started_at"), told.filter("reason is not null")


def newest_first(runs: DataFrame, started: str = "started_ms") -> DataFrame:
    return runs.orderBy(F.desc(started), F.desc("run_id"))


def select_run(runs: DataFrame, selector: str, started: str = "started_ms") -> DataFrame:
    """``latest``, the exact id, else the newest whose id starts with the text."""
    wanted = runs if selector == "latest" else runs.filter(F.col("run_id").startswith(selector))
    return wanted.orderBy(F.desc(F.col("run_id") == selector), F.desc(started), F.desc("run_id")).limit(1)


def run_list(runs: DataFrame, summary: DataFrame, tests: DataFrame) -> DataFrame:
    """Per run: its shares of lines, branches and conditions and its tests; null
    shares where it could not be read."""
    shares = summary.groupBy("run_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"{m}_pct") for m in ("lines", "branches", "conditions")])
    counts = tests.filter("role = 'test'").groupBy("run_id").agg(F.count(F.lit(1)).alias("tests"))
    return runs.join(shares, "run_id", "left").join(counts, "run_id", "left").withColumn("tests", F.coalesce("tests", F.lit(0)))


def _differing(columns: dict[str, str], left: str, right: str) -> list[Column]:
    return [F.when(~F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")), F.lit(word)) for name, word in columns.items()]


def merge_conflicts(runs: DataFrame) -> DataFrame:
    """Per run, the domains in which it differs from the first run named (lowest
    ``position``); the fingerprint itself only where every domain agrees."""
    first = F.broadcast(runs.orderBy("position").limit(1))
    left, right = first.alias("f"), runs.alias("c")
    joined = right.join(left, F.col("c.position") > F.col("f.position"))
    domains = F.array_compact(F.array(*_differing({k: v[0] for k, v in DOMAINS.items()}, "f", "c")))
    whole = (F.size(domains) == 0) & (F.col("f.combined") != F.col("c.combined")) & (F.col("f.execution") == F.col("c.execution"))
    names = F.when(whole, F.array(F.lit("integrity fingerprint"))).otherwise(domains)
    return joined.select(F.col("c.run_id").alias("run_id"), F.array_join(names, ", ").alias("conflicts")).filter("conflicts <> ''")


def require_mergeable(run_ids: list[str]) -> None:
    """A merge names at least two runs, each once."""
    if len(run_ids) < 2:
        raise ValueError("a merge needs at least two runs")
    if len(set(run_ids)) != len(run_ids):
        raise ValueError("a merge names a run twice")


def manifest_difference(points: DataFrame, left: str, right: str) -> DataFrame:
    """Obligations of one run's manifest the other lacks, copies counted."""
    shape = [name for name in points.columns if name != "run_id"]
    one = points.filter(F.col("run_id") == left).select(*shape)
    two = points.filter(F.col("run_id") == right).select(*shape)
    signed = one.withColumn("_n", F.lit(1)).unionByName(two.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*shape).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def merge(records: DataFrame, run_ids: list[str], merged_id: str, superseded: DataFrame | None = None) -> DataFrame:
    """The shards' records under one run id, in the order the runs were named;
    records of superseded (run, test) pairs are left out."""
    require_mergeable(run_ids)
    ranks = F.create_map(*[F.lit(x) for pair in ((run, i) for i, run in enumerate(run_ids)) for x in pair])
    kept = records.filter(F.col("run_id").isin(run_ids))
    if superseded is not None:
        kept = kept.join(superseded.select("run_id", "test_id"), ["run_id", "test_id"], "left_anti")
    return kept.withColumn("shard", ranks[F.col("run_id")]).withColumn("run_id", F.lit(merged_id))


def table_fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, domain, rows, total, mixed): what each run's rows of each table come to, in whatever order.

    Count, sum and exclusive or of row hashes are the same for the same rows, copies counted, and need one
    partial aggregation, however large the tables. A null hashes apart from a missing neighbour's value."""
    parts = []
    for domain, rows in tables.items():
        names = sorted(name for name in rows.columns if name != "run_id")
        row = F.xxhash64(*[x for name in names for x in (F.col(name), F.col(name).isNull())])
        parts.append(rows.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(row).alias("mixed")).withColumn("domain", F.lit(domain)))
    return reduce(DataFrame.unionByName, parts)


def denominator_conflicts(tables: dict[str, DataFrame], run_ids: list[str]) -> DataFrame:
    """(run_id, domain) where a run named for a merge has other rows than the first one; runs
    without rows in a domain have the empty table there."""
    require_mergeable(run_ids)
    spark = next(iter(tables.values())).sparkSession
    named = {domain: rows.filter(F.col("run_id").isin(run_ids)) for domain, rows in tables.items()}
    prints = table_fingerprints(named)
    every = spark.createDataFrame([(run, domain) for run in run_ids for domain in tables], "run_id string, domain string")
    told = every.join(prints, ["run_id", "domain"], "left").withColumn("_print", F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "total", "mixed"))
    first = told.filter(F.col("run_id") == run_ids[0]).select("domain", F.col("_print").alias("_first"))
    return told.filter(F.col("run_id") != run_ids[0]).join(first, "domain").filter(~F.col("_print").eqNullSafe(F.col("_first"))).select("run_id", "domain")


def denominator_difference(tables: dict[str, DataFrame], conflicts: DataFrame, first: str) -> DataFrame:
    """(run_id, domain, id, surplus): rows by which the first run and one in conflict with it differ, copies
    counted, positive where the first has more. Domains that agree are not looked at."""
    parts, against = [], {}
    for run, domain in sorted((r.run_id, r.domain) for r in conflicts.distinct().collect()):  # few: runs named times tables
        against.setdefault(domain, []).append(run)
    for domain, others in against.items():
        rows, shape = tables[domain], [name for name in tables[domain].columns if name != "run_id"]
        one = rows.filter(F.col("run_id") == first).select(*shape, F.lit(1).alias("_n"), F.explode(F.array(*map(F.lit, others))).alias("run_id"))
        other = rows.filter(F.col("run_id").isin(others)).withColumn("_n", F.lit(-1))
        surplus = one.unionByName(other).groupBy("run_id", *shape).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")
        parts.append(surplus.select("run_id", F.lit(domain).alias("domain"), "id", "surplus"))
    empty = conflicts.select("run_id", "domain", F.lit("").alias("id"), F.lit(0).cast("long").alias("surplus")).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


def merge_evidence(tables: dict[str, DataFrame], run_ids: list[str], merged_id: str, superseded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every evidence table of the runs as one run's, with the ``shard`` each row is from: records, hits, vectors, phases
    and whatever else names a run and a test. Rows of superseded (run, test) pairs are left out of all alike.

    Sightings that several shards make are one, the first shard's and its first; phases that shards declare under one
    id get ids of their own, ``fresh_id``, in the order the runs were named."""
    out = {name: merge(rows, run_ids, merged_id, superseded) for name, rows in tables.items()}
    if "hits" in out:
        sight = F.struct("shard", "seq")
        out["hits"] = out["hits"].groupBy("run_id", "test_id", "hit_id").agg(F.min(sight).alias("_first")).select("run_id", "test_id", "hit_id", "_first.shard", "_first.seq")
    if "vectors" in out:
        shape = [name for name in out["vectors"].columns if name not in ("seq", "shard")]
        out["vectors"] = out["vectors"].groupBy(*shape).agg(F.min(F.struct("shard", "seq")).alias("_first")).select(*shape, "_first.shard", "_first.seq")
    if "phases" in out:
        # A record is a shard's test; it stands where its first phase does, behind all of the shards before.
        begun = out["phases"].groupBy("shard", "test_id").agg(F.min("seq").alias("_begun"))
        placed = out["phases"].join(begun, ["shard", "test_id"]).withColumn("record_seq", F.shiftleft(F.col("shard").cast("long"), 44) + F.col("_begun")).drop("_begun")
        out["phases"] = separate_repeats(placed)
    return out


def first_kind(merged_tests: DataFrame) -> DataFrame:
    """A test's kind is the first named run's that has it."""
    return merged_tests.groupBy("run_id", "test_id").agg(F.min_by("kind", "shard").alias("kind"))


def superseded_records(out_of_date: DataFrame, records: DataFrame) -> DataFrame:
    """(run, test) pairs whose record is out of date and that another run measured again."""
    measured = records.select(F.col("run_id").alias("_other"), "test_id").distinct()
    again = out_of_date.join(measured, "test_id").filter("run_id <> _other").select("run_id", "test_id").distinct()
    return again


def declared_runners(declarations: DataFrame) -> DataFrame:
    """One row per runner over shards; ``conflict`` where shards declare it differently."""
    shape = F.to_json(F.struct(*[F.col(n) for n in declarations.columns if n not in ("run_id", "runner")]))
    return declarations.select("runner", shape.alias("_shape")).distinct().groupBy("runner").agg(
        F.min("_shape").alias("declaration"), (F.count(F.lit(1)) > 1).alias("conflict"))


def across(rows: DataFrame) -> DataFrame:
    """One entry per file with its reasons joined, ``file (why; why)``."""
    whys = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("whys"))
    return whys.select("file", F.when(F.col("whys") == "", F.col("file")).otherwise(F.concat("file", F.lit(" ("), "whys", F.lit(")"))).alias("explanation"))


def stale_reasons(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Why a run no longer matches its checkout, in order; ``current`` has one row
    per source tree, keyed by ``checkout``. The environment counts only alone."""
    left, right = stored.alias("s"), current.alias("c")
    reasons = F.array_compact(F.array(*_differing({k: v[1] for k, v in DOMAINS.items()}, "s", "c")))
    environment = (F.size(reasons) == 0) & (F.col("s.execution") != F.col("c.execution"))
    told = F.when(F.col("c.checkout").isNull(), F.array(F.lit("source cannot be measured"))).when(
        environment, F.array(F.lit("execution environment changed"))).otherwise(reasons)
    return left.join(right, F.col("s.checkout") == F.col("c.checkout"), "left").select(
        F.col("s.run_id").alias("run_id"), (F.size(told) > 0).alias("stale"), F.array_join(told, ", ").alias("reasons"))


def choose_for_merge(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Runs of this source to merge, by measurement: current, not merges, not
    superseded by a later run of the same measurement, newest first."""
    live = runs.join(stale_reasons(runs, current).filter("not stale").select("run_id"), "run_id", "left_semi").filter("not merged")
    measurement = ["dependencies", "instrumenter"]
    replaced = live.filter("supersedes is not null").select(F.col("supersedes").alias("run_id"), *measurement, F.col("started_ms").alias("_later"))
    gone = live.join(replaced, ["run_id", *measurement]).filter(F.col("_later") >= F.col("started_ms")).select("run_id").distinct()
    kept = live.join(gone, "run_id", "left_anti")
    place = F.row_number().over(Window.partitionBy(*measurement).orderBy(F.desc("started_ms"), F.desc("run_id")))
    return kept.withColumn("place", place).select("run_id", *measurement, "started_ms", "place")


def judge_files(changed: DataFrame) -> DataFrame:
    """What a changed file means for an earlier run: outdated, across, reached or
    no matter, by the first rule that holds.

    ``changed``: run_id, file, gone, own_test, known_test, runner (of a settings
    file, null for none), ran_runner (whether the run used it), same_settings,
    measured (null where the run does not say), supported (null unless a server
    loaded it), served, loads (the run's tests load it; null where unknown),
    placed, only_added.
    """
    file = F.col("file")
    measured = F.coalesce("measured", ~beside_the_tests(file))
    settings = (
        F.when(F.col("runner").isNotNull() & (F.col("ran_runner") == False), "across: another runner's settings")  # noqa: E712
        .when((F.col("runner") == "playwright") & F.coalesce("same_settings", F.lit(False)), "across: only settings that schedule tests")
        .otherwise("outdated: configuration")
    )
    loads = F.coalesce("loads", F.lit(False))
    rule = (
        F.when(F.col("own_test"), "outdated: own test")
        .when(F.col("known_test"), "no matter")
        .when(dependency_file(file), "outdated: dependency")
        .when(configuration_file(file), settings)
        .when(measured, "outdated: measured")
        .when(F.coalesce("supported", F.lit(False)) & ~loads, F.when(F.col("served"), "reached: served").otherwise("across: served no test"))
        .when(F.col("loads").isNotNull() & ~loads & F.col("placed"), "across: not loaded")
        .when(F.col("gone"), "outdated: gone")
        .when(F.col("only_added"), "across: only added")
        .otherwise("outdated: changed")
    )
    return changed.select("run_id", "file", F.split(rule, ": ")[0].alias("judgment"), F.get(F.split(rule, ": "), 1).alias("why"))


def pair_moments(run_files: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """Runs and snapshots of one moment: they share a file, and every file they
    share has one digest."""
    shared = run_files.select("run_id", "path", F.col("sha256").alias("_r")).join(
        snapshot_files.select("snapshot", "path", F.col("sha256").alias("_s")), "path")
    return shared.groupBy("run_id", "snapshot").agg(F.bool_and(F.col("_r") == F.col("_s")).alias("_same"), F.count(F.lit(1)).alias("shared")).filter(
        "_same").select("run_id", "snapshot", "shared")


def timeline(runs: DataFrame, snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs and snapshots in one list by time, pairs as one entry."""
    left = runs.select("run_id", F.col("started_ms").alias("_rt")).join(pairs.select("run_id", "snapshot"), "run_id", "left")
    right = snapshots.select("snapshot", F.col("taken_ms").alias("_st"))
    joined = left.join(right, "snapshot", "full_outer")
    return joined.select("run_id", "snapshot", F.coalesce("_rt", "_st").alias("at_ms")).orderBy("at_ms", "run_id", "snapshot")


def require_rows_of_both(left: DataFrame, right: DataFrame, what: str) -> None:
    """A filter neither side has a test for is refused."""
    if left.isEmpty() and right.isEmpty():
        raise NoMatch(f"no test matches {what} in either run")
