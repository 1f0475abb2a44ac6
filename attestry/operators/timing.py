"""Who ran when: phases of events, owners of unattributed work, served tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import ordered
from attestry.session import landed


def join_server_records(server: DataFrame, attempts: DataFrame, scope: list[str]) -> DataFrame:
    """Server records with the first attempt record of their scope.

    Equal records of one scope are one. Attempts are folded to one row per scope
    before the join, so a record meets at most one.
    """
    first = attempts.groupBy(*scope).agg(F.min("seq").alias("attempt_seq"))
    return server.dropDuplicates().join(first, scope, "left")


def phase_of_events(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Each event with its phase: its own where it names one, else the last to
    start at or before it; in the millisecond one phase hands over to the next,
    the ending one."""
    keys = ["run_id", "test_id"]
    placed = ordered.last_two_at(
        events, phases, keys, "timestamp_ms", "started_at_ms", ["started_at_ms", "id"], ["id", "started_at_ms", "ended_at_ms"],
    )
    t, last, before = F.col("timestamp_ms"), F.col("last"), F.col("before_last")
    handed_over = (
        (last.started_at_ms == t) & (before.ended_at_ms == t) & (before.started_at_ms < t)
    )
    inferred = F.when(F.coalesce(handed_over, F.lit(False)), before.id).otherwise(last.id)
    return placed.select(
        *events.columns, F.coalesce("own_phase_id", inferred).alias("phase_id"), F.col("own_phase_id").isNotNull().alias("explicit")
    )


def phase_event_counts(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Events per phase by environment and by whether they named it; events of a
    phase nobody declared are not counted."""
    placed = phase_of_events(events, phases).filter(F.col("phase_id").isNotNull())
    counted = placed.groupBy("run_id", "test_id", "phase_id").agg(
        *[
            F.count_if((F.col("environment") == env) & (F.col("explicit") == explicit)).alias(f"{word}_{env}_events")
            for env in ("browser", "server") for explicit, word in ((True, "explicit"), (False, "inferred"))
        ]
    )
    known = phases.select("run_id", "test_id", F.col("id").alias("phase_id"), "kind")
    return counted.join(known, ["run_id", "test_id", "phase_id"])


def owners_by_time(records: DataFrame, windows: DataFrame, served: DataFrame) -> DataFrame:
    """The one attempt running when a background record's request came.

    Candidates are the attempts its process served, if it served any, else every
    attempt of the run. ``owner`` is null where none or several were running, or
    the record names no request or no time.
    """
    pools = served.select("process").distinct().withColumn("_limited", F.lit(True))
    pooled = records.join(pools, "process", "left").withColumn("pool", F.when(F.col("_limited"), F.col("process")).otherwise(F.col("run_id"))).drop("_limited")
    timed = F.col("request").isNotNull() & F.col("timestamp_ms").isNotNull()
    spans = windows.withColumn("pool", F.col("run_id")).unionByName(
        windows.join(served.select("run_id", "attempt_id", F.col("process").alias("pool")), ["run_id", "attempt_id"]).select(*windows.columns, "pool")
    ).select("pool", "attempt_id", "start_ms", "end_ms")
    found = ordered.sole_container(pooled.filter(timed), spans, ["pool"], "timestamp_ms", "start_ms", "end_ms", "attempt_id")
    rest = pooled.filter(~timed).select("*", F.lit(0).cast("long").alias("owner_count"), F.lit(None).cast("string").alias("owner"))
    return found.unionByName(rest).drop("pool")


def unattributed(owned: DataFrame) -> DataFrame:
    """Work no test is credited with, once however many requests repeat it."""
    return owned.filter(F.col("owner").isNull()).drop("owner", "owner_count", "request", "record_id").distinct()


def interleaved(starts: DataFrame, process: str = "transport") -> DataFrame:
    """Processes that came back to an attempt after leaving it: more runs of one
    attempt than attempts."""
    stepped = ordered.previous(starts, [process], "seq", ["seq", "attempt"], ["attempt"], 4096)
    return stepped.groupBy(process).agg(
        F.count_if(~F.col("attempt").eqNullSafe(F.col("prev_attempt"))).alias("_runs"), F.count_distinct("attempt").alias("_attempts")
    ).select(process, "_runs", "_attempts").select(process, (F.col("_runs") > F.col("_attempts")).alias("interleaved"))


def in_process_owners(requests: DataFrame, starts: DataFrame) -> DataFrame:
    """The attempt whose phase began last before a request in its process; none
    where the process ran attempts at once."""
    shifted = starts.withColumn("_after", F.col("seq") + 1)
    placed = ordered.last_two_at(requests, shifted, ["transport"], "seq", "_after", ["seq", "attempt"], ["attempt"], 4096)
    mixed = interleaved(starts)
    return placed.join(mixed, "transport", "left").select(
        *requests.columns, F.when(~F.coalesce("interleaved", F.lit(False)), F.col("last.attempt")).alias("owner")
    )


def support_reach(loads: DataFrame, served: DataFrame, unscoped: DataFrame, windows: DataFrame) -> DataFrame:
    """Files a serving process loaded with the tests it served, and with the one
    test running when a request that named none came."""
    alone = ordered.sole_container(unscoped, windows, ["run_id"], "timestamp_ms", "start_ms", "end_ms", "attempt_id")
    owners = alone.filter(F.col("owner").isNotNull()).select("run_id", "process", F.col("owner").alias("attempt_id"))
    names = windows.select("run_id", "attempt_id", "test_id")
    tests = served.select("run_id", "process", "attempt_id").unionByName(owners).join(names, ["run_id", "attempt_id"]).select(
        "run_id", "process", "test_id").distinct()
    return loads.join(tests, ["run_id", "process"]).select("file", "test_id").distinct()


RECORD = ["run_id", "record_seq"]


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())


def repeated_records(phases: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(run_id, record_seq) of records that declare a phase some earlier record had declared.

    A repeat declares nothing itself, so records are decided in rounds: one that meets a declared phase is a repeat,
    one that is the first undecided for each of its phases declares them. ``named`` (run_id, id, at) are names
    given to earlier repeats' phases."""
    pending = landed(phases.select(*RECORD, "id").distinct())
    declared, repeats = [named.select("run_id", "id", "at")] if named is not None else [], []
    while True:
        first = pending.groupBy("run_id", "id").agg(F.min("record_seq").alias("_first"))
        each = pending.join(first, ["run_id", "id"])
        met = F.lit(False)
        if declared:
            known = reduce(DataFrame.unionByName, declared).groupBy("run_id", "id").agg(F.min("at").alias("_at"))
            each, met = each.join(known, ["run_id", "id"], "left"), F.coalesce(F.col("_at") < F.col("record_seq"), F.lit(False))
        told = each.groupBy(*RECORD).agg(F.bool_or(met).alias("repeat"), F.bool_and(F.col("record_seq") == F.col("_first")).alias("foremost"))
        decided = landed(told.filter("repeat or foremost").select(*RECORD, "repeat"))
        if decided.isEmpty():
            break
        repeats.append(decided.filter("repeat").select(*RECORD))
        declared.append(pending.join(decided.filter("not repeat").select(*RECORD), RECORD).select("run_id", "id", F.col("record_seq").alias("at")))
        pending = landed(pending.join(decided.select(*RECORD), RECORD, "left_anti"))
    return reduce(DataFrame.unionByName, repeats) if repeats else pending.select(*RECORD)


def own_numbers(phases: DataFrame, repeats: DataFrame) -> DataFrame:
    """(run_id, id, n, at): where a record that is no repeat declares ``id~n`` itself."""
    kept = phases.select(*RECORD, "id").distinct().join(repeats, RECORD, "left_anti")
    pattern = r"^(.*)~([1-9][0-9]*)$"
    return kept.select("run_id", F.regexp_extract("id", pattern, 1).alias("id"), F.regexp_extract("id", pattern, 2).try_cast("int").alias("n"), F.col("record_seq").alias("at")).filter("n >= 2")


def fresh_names(phases: DataFrame, repeats: DataFrame, passed_over: DataFrame) -> DataFrame:
    """(run_id, record_seq, id, n): the phases of repeats numbered from 2 on in record order, but for the
    numbers (run_id, id, n) that are passed over."""
    again = phases.select(*RECORD, "id").distinct().join(repeats, RECORD)
    taken = ordered.row_numbers(passed_over.select("run_id", "id", "n").distinct(), ["run_id", "id"], "n", [F.col("n")], "_j")
    # Of the numbers from 2 on that are not passed over, so many lie below one that is.
    gaps = taken.select("run_id", "id", (F.col("n") - 1 - F.col("_j")).alias("_below"))
    numbered = ordered.row_numbers(again, ["run_id", "id"], "record_seq", [F.col("record_seq")], "_i")
    told = numbered.join(gaps, ["run_id", "id"], "left").groupBy(*RECORD, "id", "_i").agg(F.count_if(F.col("_below") < F.col("_i")).alias("_passed"))
    return told.select(*RECORD, "id", (F.col("_i") + 1 + F.col("_passed")).cast("int").alias("n"))


def separate_repeats(phases: DataFrame) -> DataFrame:
    """Phases of a record that declares one an earlier record declared get names of their own, ``id~2``, ``id~3``
    and so on (``fresh_id``); references follow by record.

    A given name is declared too, so a later record that uses it is a repeat, and a name that an earlier record
    has of its own is passed over. What repeats, what is passed over and what names are given each depend only on
    earlier records, so deriving them in turn until nothing moves gives what going through the records would."""
    fresh, seen = None, None
    used = phases.select("run_id", F.col("id").alias("_name")).distinct()
    while True:
        # Only given names that some record has of its own can change what repeats.
        given = None
        if fresh is not None:
            named = fresh.select("run_id", F.concat("id", F.lit("~"), F.col("n").cast("string")).alias("_name"), F.col("record_seq").alias("at"))
            given = landed(named.join(used, ["run_id", "_name"], "left_semi").withColumnRenamed("_name", "id"))
        repeats = landed(repeated_records(phases, given))
        own = own_numbers(phases, repeats)
        if fresh is None:
            over = own.limit(0)
        else:
            # A number is passed over where it is declared before the repeat that would take it.
            reached = own.join(fresh.select("run_id", "id", F.col("n").alias("_n"), "record_seq"), ["run_id", "id"]).filter("_n >= n")
            over = reached.groupBy("run_id", "id", "n", "at").agg(F.min("record_seq").alias("_reached")).filter("at < _reached")
        fresh = landed(fresh_names(phases, repeats, over))
        mark = _mark(fresh)
        if mark == seen:
            told = fresh.select(*RECORD, "id", F.concat("id", F.lit("~"), F.col("n").cast("string")).alias("fresh_id"))
            return phases.join(told, [*RECORD, "id"], "left").withColumn("fresh_id", F.coalesce("fresh_id", "id"))
        seen = mark


def release_leaked(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Events naming another record's phase lose it; a phase no record declares
    is left for validation to refuse."""
    own = phases.select("run_id", "record_seq", F.col("id").alias("phase_id")).distinct().withColumn("_own", F.lit(True))
    declared = phases.select("run_id", F.col("id").alias("phase_id")).distinct().withColumn("_declared", F.lit(True))
    joined = events.join(own, ["run_id", "record_seq", "phase_id"], "left").join(declared, ["run_id", "phase_id"], "left")
    leaked = F.col("_own").isNull() & F.col("_declared").isNotNull()
    return joined.select(
        *[F.when(~leaked, F.col("phase_id")).alias("phase_id") if name == "phase_id" else F.col(name) for name in events.columns],
        leaked.alias("leaked"),
    )


def resolve_places(hits: DataFrame, places: DataFrame, follows: DataFrame) -> DataFrame:
    """Hits named by probe place, ``~p<key>.<place>``, under manifest ids; where
    a probe was dropped its place is hit when its leader is. Other names, and
    places no table knows, stay as they are."""
    pattern = r"^~p(.+)\.([0-9]+)$"
    named = hits.withColumn("_key", F.regexp_extract("hit_id", pattern, 1)).withColumn("_place", F.regexp_extract("hit_id", pattern, 2).try_cast("int"))
    table = places.select(F.col("key").alias("_key"), F.col("place").alias("_place"), F.col("id").alias("_id"))
    resolved = named.join(table, ["_key", "_place"], "left").withColumn("hit_id", F.coalesce("_id", "hit_id")).select(*hits.columns)
    behind = follows.select(F.col("key").alias("_key"), F.col("leader").alias("_place"), F.col("place").alias("_behind")).join(
        table.select("_key", F.col("_place").alias("_behind"), "_id"), ["_key", "_behind"])
    followers = named.join(behind, ["_key", "_place"]).withColumn("hit_id", F.col("_id")).select(*hits.columns)
    return resolved.unionByName(followers)


def confidence(relations: DataFrame) -> DataFrame:
    """How surely an obligation was exercised.

    ``relations``: run_id, id, test_id, role, kind, runner, phase_kind, explicit,
    one row per observation. Level ``action`` needs an explicit action phase;
    setup- and background-only read phases where there are any, else roles.
    """
    told = F.col("phase_kind").isNotNull()

    def only(value: str):
        return F.when(F.col("_phases") > 0, F.col(f"_{value}_phases") == F.col("_phases")).otherwise(F.col(f"_{value}_roles") == F.col("_n"))

    folded = relations.groupBy("run_id", "id").agg(
        F.bool_or((F.col("phase_kind") == "action") & F.col("explicit")).alias("_action"),
        F.count_if(told).alias("_phases"), F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("phase_kind") == v).alias(f"_{v}_phases") for v in ("setup", "background")],
        *[F.count_if(F.col("role") == v).alias(f"_{v}_roles") for v in ("setup", "background")],
        F.bool_or(F.col("kind") == "e2e").alias("e2e"),
        F.count_distinct("kind").alias("kinds"), F.count_distinct("runner").alias("runners"),
    )
    return folded.select(
        "run_id", "id", F.when(F.coalesce("_action", F.lit(False)), "action").otherwise("executed").alias("level"),
        only("setup").alias("setup_only"), only("background").alias("background_only"), "e2e", "kinds", "runners",
    )


def confidence_lines(points: DataFrame, confident: DataFrame) -> DataFrame:
    """Measured lines per run and level: a line is as sure as its surest point."""
    rank = F.when(F.col("level") == "action", 2).when(F.col("level") == "executed", 1).otherwise(0)
    lines = points.filter("not declined").join(confident.select("run_id", "id", "level"), ["run_id", "id"], "left").groupBy(
        "run_id", "file", "line").agg(F.max(rank).alias("_rank"))
    level = F.element_at(F.array(F.lit("unexecuted"), F.lit("executed"), F.lit("action")), F.col("_rank") + 1)
    return lines.groupBy("run_id", level.alias("level")).agg(F.count(F.lit(1)).alias("lines"))
