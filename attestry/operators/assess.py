"""Quality and security answers: findings, health, comparisons, paths.

``answers`` hold snapshot, path, window_no, check_id, value in 0..1 and bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import landed

# An answer at or above PRESENT_AT fires; security checks with a
# cut of their own; a line dismissed at DISMISS_AT is no finding.
PRESENT_AT = 0.6
SECURITY_CUTS = {"secret_in_source": 0.5, "unsafe_code_execution": 0.5, "unescaped_output": 0.5, "insecure_configuration": 0.5}
DISMISS_AT = 0.6
NEAR_LINES = 10
#: Rounds of thinning between two shuffles.
ROUNDS = 4
FILE = ["snapshot", "path"]


def merge_windows(answers: DataFrame) -> DataFrame:
    """A file read in windows: the strongest answer per check, bytes added up."""
    return answers.groupBy(*FILE, "check_id").agg(F.max("value").alias("value"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("windows"))


def cut_of(check: Column, cuts: dict[str, float] | None = None) -> Column:
    cut = F.lit(PRESENT_AT)
    for name, own in (cuts or {}).items():
        cut = F.when(check == name, own).otherwise(cut)
    return cut


def fired(answers: DataFrame, cuts: dict[str, float] | None = None) -> DataFrame:
    """Answers at or above their check's cut."""
    return answers.filter(F.col("value") >= cut_of(F.col("check_id"), cuts))


def top_findings(found: DataFrame, keep: int = 3) -> DataFrame:
    """A file's strongest findings and how many more there are. Findings per
    file are at most one per check of the catalogue."""
    order = Window.partitionBy(*FILE).orderBy(F.desc("value"), "check_id")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    counts = found.groupBy(*FILE).agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("more"))
    return ranked.join(counts, FILE).select(*FILE, "check_id", "value", "place", "more")


def health(answers: DataFrame) -> DataFrame:
    """Ten less the mean answer, on a scale of ten, two decimals."""
    return answers.groupBy(*FILE).agg(
        F.round((1 - F.avg("value")) * 10 * 100).alias("_h"), F.max("bytes").alias("bytes")
    ).select(*FILE, (F.col("_h") / 100).alias("health"), "bytes")


def weighted(files: DataFrame, by: list[str]) -> DataFrame:
    """Health weighted by bytes; null where there are none."""
    total = F.sum("bytes")
    value = F.when(total > 0, F.round(F.sum(F.col("bytes") * F.col("health")) / total * 100) / 100)
    return files.groupBy(*by).agg(value.alias("health"), total.alias("bytes"), F.count(F.lit(1)).alias("files"))


def directory_health(files: DataFrame, depth: int = 2) -> DataFrame:
    """Weighted health per snapshot and directory, with the snapshot's own row
    (null directory) as the rollup's total."""
    from attestry.operators.gaps import area_directory

    total = F.sum("bytes")
    value = F.when(total > 0, F.round(F.sum(F.col("bytes") * F.col("health")) / total * 100) / 100)
    placed = files.withColumn("directory", area_directory(F.col("path"), depth))
    return placed.rollup("snapshot", "directory").agg(value.alias("health"), total.alias("bytes"), F.count(F.lit(1)).alias("files")).filter(
        "snapshot is not null")


def flagged_files(files: DataFrame, found: DataFrame, failed: DataFrame) -> DataFrame:
    """Files with a finding or failed; the rest counted as quiet."""
    counts = found.groupBy(*FILE).agg(F.count(F.lit(1)).alias("findings"))
    told = files.select(*FILE).distinct().join(counts, FILE, "left").join(failed.select(*FILE).distinct().withColumn("failed", F.lit(True)), FILE, "left")
    return told.select(*FILE, F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("failed", F.lit(False)).alias("failed"))


def with_line_tier(found: DataFrame, line_findings: DataFrame) -> DataFrame:
    """Findings of the file's own answers and of confirmed lines; tier ``line``
    where a line stands behind it. A check only lines confirmed takes its first."""
    by_line = line_findings.groupBy(*FILE, F.col("check_id")).agg(
        F.min_by("value", "line").alias("_line_value"), F.count(F.lit(1)).alias("lines"))
    return found.select(*FILE, "check_id", "value").join(by_line, [*FILE, "check_id"], "full_outer").select(
        *FILE, "check_id", F.coalesce("value", "_line_value").alias("value"),
        F.when(F.col("lines").isNotNull(), "line").otherwise("file").alias("tier"), F.coalesce("lines", F.lit(0)).alias("lines"))


def finding_counts(tiered: DataFrame) -> DataFrame:
    """Flagged files, line-confirmed files, findings per snapshot."""
    return tiered.groupBy("snapshot").agg(
        F.count_distinct("path").alias("flagged"), F.count_distinct(F.when(F.col("tier") == "line", F.col("path"))).alias("line_confirmed"),
        F.count(F.lit(1)).alias("findings"))


def findings_per_check(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("snapshot", "check_id").agg(F.count(F.lit(1)).alias("files"))


def thin_lines(line_answers: DataFrame, cuts: dict[str, float] | None = None) -> DataFrame:
    """Confirmed lines, one per check and ten lines, the strongest first (of equal ones the first line).

    In a round every line that is the strongest of its ten on either side stays and takes its neighbours out; the
    others go on. That gives what going through the lines by strength would, in as many rounds as the longest
    series of ever weaker neighbours has steps. Lines are compared by stretches with their margins, so a file of
    any number of lines is spread over tasks. ``ROUNDS`` rounds look no further than their margin: they follow one
    shuffle, and nothing is joined or broadcast."""
    keys, size, margin = [*FILE, "check_id"], 4096, ROUNDS * 2 * NEAR_LINES
    kept = fired(line_answers, cuts).filter(F.coalesce("dismissed", F.lit(0.0)) < DISMISS_AT)
    left, stay = kept.groupBy(*keys, "line").agg(F.max("value").alias("value")), []
    around = Window.partitionBy(*keys, "_part").orderBy("line").rangeBetween(-NEAR_LINES, NEAR_LINES)
    # Stretches begin half of one before the first line, so that short files have no margins.
    part = lambda line: F.floor((line + size // 2) / size)
    while True:
        line = F.col("line")
        margins = F.array_distinct(F.array(part(line), part(line - margin), part(line + margin)))
        told = left.select("*", F.explode(margins).alias("_part"), F.lit(True).alias("_left"), F.lit(False).alias("_stays"))
        for _ in range(ROUNDS):
            best = F.max(F.when(F.col("_left"), F.struct("value", (-line).alias("minus")))).over(around)
            told = told.withColumn("_stays", F.col("_stays") | (F.col("_left") & F.coalesce(best["minus"] == -line, F.lit(False))))
            told = told.withColumn("_left", F.col("_left") & ~F.max("_stays").over(around))
        told = landed(told.filter((F.col("_part") == part(line)) & (F.col("_left") | F.col("_stays"))).select(*keys, "line", "value", "_left"))
        stay.append(told.filter("not _left").drop("_left"))
        left = told.filter("_left").drop("_left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, stay)


def change_review(tiered: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """Findings a change introduced per file, most first, at its first added line."""
    counts = tiered.groupBy("path").agg(F.count(F.lit(1)).alias("introduced"), F.max("value").alias("strongest"))
    anchors = changed_lines.groupBy(F.col("file").alias("path")).agg(F.min("line").alias("anchor"))
    return counts.join(anchors, "path", "left").orderBy(F.desc("introduced"), "path")


def snapshot_diff(before: DataFrame, after: DataFrame, found_before: DataFrame, found_after: DataFrame) -> DataFrame:
    """Per path of two snapshots: declined, improved, added, removed, unchanged,
    with the movement and the checks that appeared and went."""
    checks = check_states(found_before, found_after).groupBy("path").agg(
        F.count_if(F.col("state") == "appeared").alias("appeared"), F.count_if(F.col("state") == "no longer present").alias("gone"))
    old = before.select("path", F.col("health").alias("from"))
    new = after.select("path", F.col("health").alias("to"))
    both = old.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "path", "full_outer").join(checks, "path", "left")
    appeared, gone = F.coalesce("appeared", F.lit(0)), F.coalesce("gone", F.lit(0))
    return both.select(
        "path", "from", "to", (F.round((F.col("to") - F.col("from")) * 100) / 100).alias("movement"),
        appeared.alias("appeared"), gone.alias("gone"),
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("to") < F.col("from"), "declined").when(F.col("to") > F.col("from"), "improved")
        .when(appeared > 0, "declined").when(gone > 0, "improved").otherwise("unchanged").alias("change"),
    )


def check_states(found_before: DataFrame, found_after: DataFrame) -> DataFrame:
    """Per path and check that fired on a side: appeared, no longer present, still present."""
    key = ["path", "check_id"]
    old = found_before.select(*key, F.col("value").alias("from"))
    new = found_after.select(*key, F.col("value").alias("to"))
    return old.join(new, key, "full_outer").withColumn(
        "state", F.when(F.col("from").isNull(), "appeared").when(F.col("to").isNull(), "no longer present").otherwise("still present"))


def refuse_other_catalogue(before: dict, after: dict) -> None:
    """Snapshots compare only under one catalogue and model."""
    for name in ("catalogue_version", "model"):
        if before.get(name) != after.get(name):
            raise ValueError(f"snapshots differ in {name}: {before.get(name)!r} and {after.get(name)!r}")


def shared_health(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each snapshot's weighted health over the files both hold."""
    old = before.join(after.select("path"), "path", "left_semi")
    new = after.join(before.select("path"), "path", "left_semi")
    return weighted(old.select(*FILE, "health", "bytes").unionByName(new.select(*FILE, "health", "bytes")), ["snapshot"])


def decline_gate(difference: DataFrame) -> DataFrame:
    """Paths the gate refuses: health fell, or held while a check appeared."""
    return difference.filter("change = 'declined'")


def cross_with_coverage(flagged: DataFrame, lines: DataFrame, asserted_lines: DataFrame) -> DataFrame:
    """Flagged files against a run: measured and uncovered lines, untested, executed but unasserted."""
    measured = lines.filter("measured").groupBy(F.col("file").alias("path")).agg(
        F.count(F.lit(1)).alias("measured_lines"), F.count_if(~F.col("covered")).alias("uncovered_lines"))
    credited = asserted_lines.select(F.col("file").alias("path"), "line").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("lines_credited"))
    joined = flagged.join(measured, "path", "left").join(credited, "path", "left")
    any_finding, uncovered = F.col("findings") > 0, F.coalesce("uncovered_lines", F.lit(0))
    executed = F.coalesce("measured_lines", F.lit(0)) > uncovered
    return joined.select(
        *FILE, "findings", F.col("measured_lines").isNotNull().alias("in_run"),
        F.coalesce("measured_lines", F.lit(0)).alias("measured_lines"), uncovered.alias("uncovered_lines"),
        (any_finding & (uncovered > 0)).alias("flagged_and_untested"),
        (any_finding & executed & F.col("lines_credited").isNull()).alias("flagged_and_unasserted"))


# --- paths between functions -------------------------------------------------
# ``functions``: file, name, start, end, body, takes_outside, reaches_sink,
# sanitises, sink_kind.

def _sinks(functions: DataFrame) -> DataFrame:
    return functions.filter((F.col("reaches_sink") >= PRESENT_AT) & (F.col("sanitises") < PRESENT_AT) & (F.col("sink_kind") != "none"))


def _named(functions: DataFrame, prefix: str, extra: list[str]) -> DataFrame:
    return functions.select(*[F.col(n).alias(f"{prefix}_{n}") for n in ("file", "name", "start", "end", *extra)])


def import_paths(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """A caller taking outside data, and a function it imports and calls that
    reaches a sink unsanitised. ``imports``: file, target, local, exported,
    target_default (the target's default export's name, null for none)."""
    callers = _named(functions.filter(F.col("takes_outside") >= PRESENT_AT), "caller", ["body"])
    callees = _named(_sinks(functions), "callee", ["sink_kind"])
    linked = imports.withColumnRenamed("file", "caller_file").withColumnRenamed("target", "callee_file")
    named = (
        F.when(F.col("exported") == "*", True)
        .when(F.col("exported") == "default", F.col("callee_name") == F.coalesce("target_default", "local"))
        .otherwise(F.col("callee_name") == F.col("exported"))
    )
    called = F.contains("caller_body", F.concat("local", F.lit("."), "callee_name", F.lit("("))) | F.contains("caller_body", F.concat("local", F.lit("(")))
    return linked.join(callees, "callee_file").filter(named).join(callers, "caller_file").filter(called).select(
        "caller_file", "caller_name", "callee_file", "callee_name", "callee_start", F.col("callee_sink_kind").alias("sink_kind")).distinct()


def executed_functions(functions: DataFrame, executions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(file, name, start, test_id) of functions with a line a test ran, or the named columns of them.

    Spans are cut into line buckets so the containment join has a key, and each
    line is looked for in its own bucket alone."""
    size = 64
    spans = functions.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    ran = executions.select("test_id", "file", "line").withColumn("_bucket", F.floor(F.col("line") / size))
    return spans.join(ran, ["file", "_bucket"]).filter(F.col("line").between(F.col("start"), F.col("end"))).select(
        *(columns or functions.columns), "test_id").distinct()


def _numbered(functions: DataFrame) -> DataFrame:
    """Entry and sink functions with numbers: ``_caller`` in order of file, start and name, ``_callee``, ``_of`` for all
    of a sink's name in its file, ``_file``. A pair of functions is then three longs and not six texts."""
    entry, sink = F.col("takes_outside") >= PRESENT_AT, (F.col("reaches_sink") >= PRESENT_AT) & (F.col("sanitises") < PRESENT_AT) & (F.col("sink_kind") != "none")
    each = functions.select("file", "name", "start", "end", "sink_kind", F.coalesce(entry, F.lit(False)).alias("_entry"), F.coalesce(sink, F.lit(False)).alias("_sinks"))
    sorted_ = landed(each.filter("_entry or _sinks").distinct().orderBy("file", "start", "name", "sink_kind", "end").withColumn("_id", F.monotonically_increasing_id()))

    def first(role: str, *by: str) -> Column:
        return F.when(F.col(role), F.min(F.when(F.col(role), F.col("_id"))).over(Window.partitionBy(*by)))

    return landed(sorted_.select(
        "file", "name", "start", "end", "sink_kind", first("_entry", "file", "name", "start").alias("_caller"),
        first("_sinks", "file", "name", "start", "sink_kind").alias("_callee"), first("_sinks", "file", "name").alias("_of"),
        F.min("_id").over(Window.partitionBy("file")).alias("_file")))


def run_paths(functions: DataFrame, executions: DataFrame, known: DataFrame, per_sink: int = 3) -> DataFrame:
    """Entry and sink functions one test ran in different files, not yet known
    from imports. Three callers per sink are ``asked``; the others stay listed.

    Pairs are made distinct test by test before ranking, and the rank only marks
    rows: nothing is dropped."""
    told = _numbered(functions)
    ran = executed_functions(told, executions, ["_caller", "_callee", "_of", "_file"])
    callers = ran.filter("_caller is not null").select("test_id", "_caller", F.col("_file").alias("_from"))
    callees = ran.filter("_callee is not null").select("test_id", "_callee", "_of", "_file")
    key = ["_of", "_callee", "_caller"]
    entries = told.filter("_caller is not null").select("_caller", F.col("file").alias("caller_file"), F.col("name").alias("caller_name")).distinct()
    sinks = told.filter("_callee is not null").select("_callee", "_of", F.col("file").alias("callee_file"), F.col("name").alias("callee_name"), "sink_kind").distinct()
    imported = known.select("caller_file", "caller_name", "callee_file", "callee_name").join(entries, ["caller_file", "caller_name"]).join(
        sinks, ["callee_file", "callee_name"]).select(*key)
    pairs = callees.join(callers, "test_id").filter("_from <> _file").groupBy(*key).agg(F.min("test_id").alias("test_id")).join(imported, key, "left_anti")
    order = Window.partitionBy("_of").orderBy("test_id", "_caller", "_callee")
    # Ranks below the constant are found without sorting a whole sink's callers.
    first = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_sink).select(*key, F.lit(True).alias("_asked"))
    return pairs.join(first, key, "left").join(sinks.drop("_of"), "_callee").join(entries, "_caller").select(
        "caller_file", "caller_name", "callee_file", "callee_name", "sink_kind", "test_id", F.coalesce("_asked", F.lit(False)).alias("asked"))


def guard_evidence(functions: DataFrame, executions: DataFrame) -> DataFrame:
    """Per entry function: tests that ran it with, and without, a sanitising
    function also running; one guard named and three unguarded tests."""
    ran = executed_functions(functions.select("file", "name", "start", "end", "takes_outside", "sanitises"), executions)
    guards = ran.filter(F.col("sanitises") >= PRESENT_AT).groupBy("test_id").agg(
        F.min(F.struct("file", "start", "name")).alias("_g")).select(
        "test_id", F.format_string("%s:%d %s", "_g.file", "_g.start", "_g.name").alias("guard"))
    entries = ran.filter(F.col("takes_outside") >= PRESENT_AT).select("file", "name", "start", "test_id").distinct().join(guards, "test_id", "left")
    key = ["file", "name", "start"]
    counted = entries.groupBy(*key).agg(
        F.count("guard").alias("tests_with_a_guard"), F.count_if(F.col("guard").isNull()).alias("tests_without"),
        F.min_by("guard", F.when(F.col("guard").isNotNull(), F.col("test_id"))).alias("guard_example"))
    first = entries.filter("guard is null").withColumn(
        "_n", F.row_number().over(Window.partitionBy(*key).orderBy("test_id"))).filter("_n <= 3").groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_list("test_id")), ",").alias("unguarded_tests"))
    return counted.join(first, key, "left")
