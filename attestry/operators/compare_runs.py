"""Two runs against each other, a change against a run, and floors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import meets
from attestry.functions.paths import extension_of, folder_of, named_as_test
from attestry.operators import ordered


def covered_facts(states: DataFrame) -> DataFrame:
    """The covered lines, branch outcomes and conditions a diff compares."""
    return states.filter(F.col("covered") & F.col("metric").isin("lines", "branches", "conditions")).select("run_id", "metric", "id", "file", "line")


def diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Facts only one side covers: ``lost`` by the newer, ``gained`` by it."""
    key = ["metric", "id"]
    lost = older.drop("run_id").join(newer.select(*key), key, "left_anti").withColumn("side", F.lit("lost"))
    gained = newer.drop("run_id").join(older.select(*key), key, "left_anti").withColumn("side", F.lit("gained"))
    return lost.unionByName(gained)


def diff_files(difference: DataFrame, top: int = 20) -> DataFrame:
    """Counts per file, most lost first, then most gained."""
    sides = [(side, metric) for side in ("lost", "gained") for metric in ("lines", "branches", "conditions")]
    counted = difference.groupBy("file").agg(
        *[F.count_if((F.col("side") == s) & (F.col("metric") == m)).alias(f"{s}_{m}") for s, m in sides],
        F.count_if(F.col("side") == "lost").alias("lost"), F.count_if(F.col("side") == "gained").alias("gained"),
    )
    return counted.orderBy(F.desc("lost"), F.desc("gained"), "file").limit(top)


def diff_delta(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rounded difference of the summaries' shares, per metric."""
    left = older.select("metric", F.col("pct").alias("older_pct"))
    right = newer.select("metric", F.col("pct").alias("newer_pct"))
    return left.join(right, "metric").withColumn("delta", F.round((F.col("newer_pct") - F.col("older_pct")) * 100) / 100)


def neighbourhoods(files: DataFrame) -> DataFrame:
    return files.select("run_id", folder_of(F.col("file")).alias("_folder"), extension_of(F.col("file")).alias("_ext")).filter("_ext is not null").distinct()


def looks_like_source(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files no test by name that sit beside measured files of their kind."""
    keyed = changed.select("file").distinct().filter(~named_as_test(F.col("file"))).select(
        "file", folder_of(F.col("file")).alias("_folder"), extension_of(F.col("file")).alias("_ext"))
    return keyed.join(neighbourhoods(files), ["_folder", "_ext"]).select("run_id", "file")


def patch(changed: DataFrame, lines: DataFrame) -> DataFrame:
    """Changed lines a run measured, with whether it covered them."""
    return lines.filter("measured").join(changed.select("file", "line").distinct(), ["file", "line"]).select("run_id", "file", "line", "covered")


def patch_missing(changed: DataFrame, lines: DataFrame) -> DataFrame:
    """Changed source files the run did not measure."""
    measured = lines.select("run_id", "file").distinct()
    return looks_like_source(changed, measured).join(measured, ["run_id", "file"], "left_anti")


def patch_check(patched: DataFrame, runs: DataFrame, floor_ppm: int) -> DataFrame:
    """Whether a change's measured lines reach a floor; an empty change passes and says so."""
    counted = patched.groupBy("run_id").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("covered").alias("covered"))
    joined = runs.select("run_id").join(counted, "run_id", "left").select(
        "run_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("eligible", "covered")])
    verdict = F.when(meets(F.col("covered"), F.col("eligible"), F.lit(floor_ppm)), "pass").otherwise("fail")
    return joined.select("*", verdict.alias("verdict"), (F.col("eligible") == 0).alias("empty"))


def uncovered_ranges(patched: DataFrame) -> DataFrame:
    return ordered.ranges(patched.filter("not covered"), ["run_id", "file"], "line")


def workflow_escape(value: Column, in_property: bool) -> Column:
    """Escape for a line-based workflow command; properties escape their delimiters too."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if in_property else [])
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, value)


def annotations(ranges_: DataFrame, cap: int | None = None, prefix: str = "") -> DataFrame:
    """One warning per uncovered range; with a cap each run's first so many, by file and line."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("file", "start"))
    shown = ranges_ if cap is None else ranges_.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    lines = F.when(F.col("start") == F.col("end"), F.format_string("line %d", "start")).otherwise(
        F.format_string("lines %d to %d", "start", "end"))
    message = F.concat(F.lit("Changed "), lines, F.lit(" not covered by the selected tests."))
    place = workflow_escape(F.concat(F.lit(prefix), F.col("file")), True)
    return shown.select(
        "run_id", "file", "start", "end",
        F.format_string("::warning file=%s,line=%d,endLine=%d::%s", place, "start", "end", workflow_escape(message, False)).alias("text"),
    )


def applicability(eligible: Column, unmeasured: Column) -> Column:
    return F.when(eligible == 0, "not applicable").when(unmeasured > 0, "incomplete").otherwise("measured")


def floor_check(
    summary: DataFrame, file_summary: DataFrame, floors: dict[str, int], unmeasured: DataFrame, blockers: DataFrame, per_file: bool = True,
) -> DataFrame:
    """Errors and violations of a run's floors, one row each; none means pass.

    ``floors`` maps a metric to parts per million, ``unmeasured`` gives the
    declined obligations of a run, ``blockers`` (run_id, reason) what makes it
    no evidence for a gate. Where any error stands, violations are not judged.
    """
    asked = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]) if floors else F.lit(None).cast("map<string,int>")
    wanted = summary.filter(F.col("metric").isin(*floors)).withColumn("floor_ppm", asked[F.col("metric")]).join(unmeasured, "run_id", "left")
    state = applicability(F.col("total"), F.coalesce("unmeasured", F.lit(0)))
    runs = summary.select("run_id").distinct()
    stated = wanted.select("run_id").distinct()
    reasons = [
        blockers.select("run_id", F.lit(None).cast("string").alias("metric"), F.col("reason")),
        wanted.filter(state != "measured").select("run_id", "metric", state.alias("reason")),
        runs.join(stated, "run_id", "left_anti").select("run_id", F.lit(None).cast("string").alias("metric"), F.lit("no floor requested" if not floors else "not applicable").alias("reason")),
    ]
    errors = reduce(DataFrame.unionByName, reasons)
    low = ~meets(F.col("covered"), F.col("total"), F.col("floor_ppm"))
    found = wanted.filter(low).select("run_id", "metric", F.lit(None).cast("string").alias("file"), "covered", "total")
    if per_file:
        each = file_summary.filter(F.col("metric").isin(*floors) & (F.col("total") > 0)).withColumn("floor_ppm", asked[F.col("metric")])
        found = found.unionByName(each.filter(low).select("run_id", "metric", "file", "covered", "total"))
    judged = found.join(errors.select("run_id").distinct(), "run_id", "left_anti")
    return errors.select(
        "run_id", F.lit("error").alias("verdict"), "metric", F.lit(None).cast("string").alias("file"), "reason",
        F.lit(None).cast("long").alias("covered"), F.lit(None).cast("long").alias("total"),
    ).unionByName(judged.select("run_id", F.lit("fail").alias("verdict"), "metric", "file", F.lit("below floor").alias("reason"), "covered", "total"))


def run_complete(completeness: DataFrame, measurement: DataFrame, runs: DataFrame) -> DataFrame:
    """Structurally complete, and complete as evidence: passed view, valid, current."""
    structural = F.col("coverage_complete") & F.coalesce("measurement_complete", F.lit(True))
    return completeness.join(measurement, "run_id", "left").join(runs, "run_id").select(
        "run_id", structural.alias("structurally_complete"),
        (structural & (F.col("view") == "passed") & F.col("valid") & ~F.col("stale")).alias("complete"),
    )
