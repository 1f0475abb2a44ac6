"""What a set of tests covers, of what a manifest counts.

Every function takes ``keys``: the columns answers are kept apart by, ``run_id``
first. Evidence (hits, vectors) carries all of them, the manifest only
``run_id``. Totals come from the manifest alone and are joined to what each key
covered, so nothing is multiplied out by group, and every group's coverage is
recomputed from its own evidence: shares are never filtered or added up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import percentage
from attestry.operators import mcdc

METRICS = [
    "lines", "statements", "functions", "branches", "decision_outcomes",
    "condition_outcomes", "value_selections", "conditions",
]


def declined_ids(points: DataFrame, branches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids that leave the denominator: those marked, and every branch whose
    alternatives are all marked."""
    branch = branches.groupBy("run_id", F.col("branch_id").alias("id")).agg(F.bool_and("declined").alias("declined"))
    parts = [
        points.select("run_id", "id", "declined"), branches.select("run_id", "id", "declined"),
        decisions.select("run_id", "id", "declined"), branch,
    ]
    return reduce(DataFrame.unionByName, parts).filter("declined").select("run_id", "id").distinct()


def whole_files(limitations: DataFrame) -> DataFrame:
    """Files a limitation declares unmeasured as a whole."""
    return limitations.filter("whole_file").select("run_id", "file").distinct()


def without_whole_files(rows: DataFrame, limitations: DataFrame) -> DataFrame:
    """Obligations with every one of an unmeasured file marked declined."""
    marked = whole_files(limitations).withColumn("_whole", F.lit(True))
    return rows.join(marked, ["run_id", "file"], "left").withColumn(
        "declined", F.col("declined") | F.coalesce("_whole", F.lit(False))
    ).drop("_whole").select(*rows.columns)


def limitations_after_whole_files(limitations: DataFrame) -> DataFrame:
    """A whole-file limitation blocks and silences the file's others."""
    whole = limitations.filter("whole_file").withColumn("blocking", F.lit(True))
    rest = limitations.filter("not coalesce(whole_file, false)").join(whole_files(limitations), ["run_id", "file"], "left_anti")
    return whole.unionByName(rest.select(*whole.columns)).withColumn("blocking", F.coalesce("blocking", F.lit(True)))


def scope_after_whole_files(scope_entries: DataFrame, limitations: DataFrame) -> DataFrame:
    """Unmeasured files are ``excluded`` with the limitation's reason, listed or not."""
    reasons = limitations.filter("whole_file").groupBy("run_id", "file").agg(F.max("reason").alias("_reason"))
    return scope_entries.join(reasons, ["run_id", "file"], "full_outer").select(
        "run_id", "file",
        F.when(F.col("_reason").isNotNull(), "excluded").otherwise(F.col("status")).alias("status"),
        F.coalesce("_reason", "reason").alias("reason"),
    )


def with_outcome_branches(branches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add the two outcomes of every decision that declares no such branch."""
    declared = branches.select("run_id", F.regexp_extract("branch_id", "^(.*):outcome$", 1).alias("id")).filter("id <> ''").distinct()
    made = (
        decisions.join(declared, ["run_id", "id"], "left_anti")
        .withColumn("label", F.explode(F.array(F.lit("true"), F.lit("false"))))
        .select(
            "run_id", F.concat("id", F.lit(":outcome")).alias("branch_id"), F.lit("decision").alias("kind"),
            F.concat("id", F.lit(":outcome:"), "label").alias("id"), "label", "file", "line", "col", "declined",
        )
    )
    return branches.unionByName(made)


def outcome_hits(vectors: DataFrame, decisions: DataFrame, branches: DataFrame) -> DataFrame:
    """The hits a decision's vectors make on an outcome branch it did not declare."""
    declared = branches.select("run_id", F.regexp_extract("branch_id", "^(.*):outcome$", 1).alias("decision_id")).filter("decision_id <> ''").distinct()
    made = decisions.select("run_id", F.col("id").alias("decision_id")).join(declared, ["run_id", "decision_id"], "left_anti")
    return (
        vectors.join(made, ["run_id", "decision_id"], "left_semi")
        .withColumn("hit_id", F.concat("decision_id", F.lit(":outcome:"), F.when(F.col("outcome"), "true").otherwise("false")))
        .select(*[name for name in vectors.columns if name not in ("decision_id", "vals", "outcome", "seq")], "hit_id", "seq")
    )


def covered_ids(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.select(*keys, F.col("hit_id").alias("id")).distinct()


def obligations(points: DataFrame, branches: DataFrame | None) -> DataFrame:
    """Every measured obligation a hit can meet: run_id, metric, id, file, line, site_kind; those of points alone
    where there are no branches."""
    places = points.filter("not declined").select(
        "run_id", F.when(F.col("kind") == "function", "functions").otherwise("statements").alias("metric"),
        "id", "file", "line", F.col("kind").alias("site_kind"),
    )
    if branches is None:
        return places
    return places.unionByName(branches.filter("not declined").select("run_id", F.lit("branches").alias("metric"), "id", "file", "line", F.col("kind").alias("site_kind")))


def line_fold(points: DataFrame, hits: DataFrame, tests: DataFrame) -> DataFrame:
    """Per line: covered by a measured point, measured at all, and by how many
    tests, kinds and runners; ``exclusive_kind`` where one kind alone covers it."""
    measured = points.filter("not declined").select("run_id", "id", "file", "line")
    who = tests.select("run_id", "test_id", "kind", "runner")
    reached = (
        measured.join(hits.select("run_id", "test_id", F.col("hit_id").alias("id")).distinct(), ["run_id", "id"])
        .select("run_id", "file", "line", "test_id").distinct()
        .join(who, ["run_id", "test_id"])
        .groupBy("run_id", "file", "line")
        .agg(
            F.count(F.lit(1)).alias("tests"), F.count_distinct("kind").alias("kinds"),
            F.count_distinct("runner").alias("runners"), F.min("kind").alias("_kind"),
        )
    )
    lines = points.groupBy("run_id", "file", "line").agg(F.bool_or(~F.col("declined")).alias("measured"))
    return lines.join(reached, ["run_id", "file", "line"], "left").select(
        "run_id", "file", "line", "measured", F.col("tests").isNotNull().alias("covered"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("tests", "kinds", "runners")],
        F.when(F.col("kinds") == 1, F.col("_kind")).alias("exclusive_kind"),
    )


SITE_METRICS = ["lines", "statements", "functions", "branches", "value_selections"]


def _long(wide: DataFrame, by: list[str], names: list[str], value: str) -> DataFrame:
    """One row per metric of a wide row of counts."""
    pairs = ", ".join(f"'{name}', CAST({name} AS BIGINT)" for name in names)
    return wide.select(*by, F.expr(f"stack({len(names)}, {pairs}) AS (metric, {value})"))


def _site_counts(sites: DataFrame, by: list[str], counted: dict[str, Column | None]) -> DataFrame:
    """Counts of all site metrics in one aggregation tree: points per line first, which
    is what decides lines, then per ``by``. Branches need no line and fold where they
    are read. ``counted`` names each count and the sites it takes, all by default."""
    point = F.col("metric") != "branches"
    of = {name: F.col("metric") == name for name in ("statements", "functions", "branches")}
    of["value_selections"] = (F.col("metric") == "branches") & (F.col("site_kind") == "logical-value")
    which = {f"{c}_{name}": is_one if taken is None else is_one & taken for c, taken in counted.items() for name, is_one in of.items()}
    folded = sites.groupBy(*by, F.when(point, F.col("file")).alias("_file"), F.when(point, F.col("line")).alias("_line")).agg(
        *[F.count_if(taken).alias(name) for name, taken in which.items()])
    return folded.groupBy(*by).agg(
        *[F.count_if(F.col(f"{c}_statements") + F.col(f"{c}_functions") > 0).alias(f"{c}_lines") for c in counted],
        *[F.sum(name).alias(name) for name in which],
    )


def _site_rows(sites: DataFrame, by: list[str], counted: dict[str, Column | None]) -> DataFrame:
    """Site counts, long: ``by`` + metric + a column per count."""
    wide = _site_counts(sites, by, counted)
    rows = ", ".join(f"'{name}', " + ", ".join(f"CAST({c}_{name} AS BIGINT)" for c in counted) for name in SITE_METRICS)
    return wide.select(*by, F.expr(f"stack({len(SITE_METRICS)}, {rows}) AS (metric, {', '.join(counted)})"))


def _sites_of(points: DataFrame, branches: DataFrame, metrics: list[str] | None) -> DataFrame:
    """The obligations the metrics count; all by default."""
    return obligations(points, branches if metrics is None or {"branches", "value_selections"} & set(metrics) else None)


def _only_sites(metrics: list[str] | None) -> bool:
    return metrics is not None and set(metrics) <= set(SITE_METRICS)


def totals(points: DataFrame, branches: DataFrame, decisions: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Denominators, long: ``by`` + metric + total. ``metrics`` names those to answer for; all by default."""
    sites = _site_rows(_sites_of(points, branches, metrics), by, {"total": None})
    if _only_sites(metrics):
        return sites.filter(F.col("metric").isin(metrics) & (F.col("total") > 0))
    shape = decisions.filter("not declined").groupBy(*by).agg(
        F.sum("conditions").alias("conditions"), (F.sum("conditions") * 2).alias("condition_outcomes"),
        (F.count(F.lit(1)) * 2).alias("decision_outcomes"),
    )
    decided = _long(shape, by, ["decision_outcomes", "condition_outcomes", "conditions"], "total")
    rows = sites.unionByName(decided).filter("total > 0")
    return rows if metrics is None else rows.filter(F.col("metric").isin(metrics))


def covered_counts(
    points: DataFrame | None, branches: DataFrame | None, decisions: DataFrame | None, hits: DataFrame | None, vectors: DataFrame | None,
    keys: list[str], by_file: bool = False, metrics: list[str] | None = None,
) -> DataFrame:
    """Numerators, long: ``keys`` (and file) + metric + covered, plus the
    ``executed_decisions`` and ``covered_decisions`` counts; or the named ``metrics`` alone.
    Frames that none of these asks for may be None, here and in the summary."""
    out = [*keys, "file"] if by_file else keys
    names = ["decision_outcomes", "condition_outcomes", "conditions", "executed_decisions", "covered_decisions"]
    parts = []
    if metrics is None or set(metrics) & set(SITE_METRICS):
        met = _sites_of(points, branches, metrics).join(covered_ids(hits, keys), ["run_id", "id"])
        parts.append(_site_rows(met, out, {"covered": None}))
    if metrics is None or set(metrics) & set(names):
        decided = decision_results(decisions, vectors, keys).groupBy(*out).agg(
            F.sum("outcomes_seen").alias("decision_outcomes"), F.sum("condition_values_seen").alias("condition_outcomes"),
            F.sum("covered_conditions").alias("conditions"), F.count(F.lit(1)).alias("executed_decisions"),
            F.count_if("covered").alias("covered_decisions"),
        )
        parts.append(_long(decided, out, names, "covered"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows if metrics is None else rows.filter(F.col("metric").isin(metrics))


def decision_results(decisions: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Executed decisions with outcomes, condition values and MC/DC conditions shown."""
    whole = decisions.filter("not declined").select("run_id", F.col("id").alias("decision_id"), "file", "line", "col", "conditions")
    return mcdc.decision_facts(vectors, keys).join(whole, ["run_id", "decision_id"]).select(
        *keys, "decision_id", "file", "line", "col", "conditions", "outcomes_seen", "condition_values_seen",
        F.size("shown").cast("long").alias("covered_conditions"), (F.size("shown") == F.col("conditions")).alias("covered"),
    )


def summary(
    points: DataFrame | None, branches: DataFrame | None, decisions: DataFrame | None, hits: DataFrame | None, vectors: DataFrame | None,
    keys: list[str], by_file: bool = False, groups: DataFrame | None = None, metrics: list[str] | None = None,
) -> DataFrame:
    """Covered, total and share of each metric, long.

    ``groups`` lists the keys to answer for (a kind none of whose tests reached
    anything still has a row); by default every run of the manifest.
    """
    manifest_by = ["run_id", "file"] if by_file else ["run_id"]
    if groups is None and keys == ["run_id"]:
        return _run_summary(points, branches, decisions, hits, vectors, manifest_by, metrics)
    whole = totals(points, branches, decisions, manifest_by, metrics)
    counts = covered_counts(points, branches, decisions, hits, vectors, keys, by_file, metrics)
    rows = whole if groups is None else groups.join(whole, "run_id")
    on = [*keys, "file", "metric"] if by_file else [*keys, "metric"]
    return rows.join(counts, on, "left").select(
        *on, F.coalesce("covered", F.lit(0)).alias("covered"), "total",
        percentage(F.coalesce("covered", F.lit(0)), F.col("total")).alias("pct"),
    )


def _run_summary(
    points: DataFrame, branches: DataFrame, decisions: DataFrame, hits: DataFrame, vectors: DataFrame, by: list[str], metrics: list[str] | None,
) -> DataFrame:
    """The summary of whole runs: covered and total are counted together, so the manifest is read and folded once."""
    parts = []
    if metrics is None or set(metrics) & set(SITE_METRICS):
        met = covered_ids(hits, ["run_id"]).withColumn("_met", F.lit(True))
        sites = _sites_of(points, branches, metrics).join(met, ["run_id", "id"], "left")
        parts.append(_site_rows(sites, by, {"covered": F.col("_met").isNotNull(), "total": None}))
    if not _only_sites(metrics):
        facts = mcdc.decision_facts(vectors, ["run_id"])
        whole = decisions.filter("not declined").select(*by, F.col("id").alias("decision_id"), "conditions").join(facts, ["run_id", "decision_id"], "left")
        wide = whole.groupBy(*by).agg(
            F.sum(F.coalesce("outcomes_seen", F.lit(0))).alias("c1"), (F.count(F.lit(1)) * 2).alias("t1"),
            F.sum(F.coalesce("condition_values_seen", F.lit(0))).alias("c2"), (F.sum("conditions") * 2).alias("t2"),
            F.sum(F.coalesce(F.size("shown"), F.lit(0))).alias("c3"), F.sum("conditions").alias("t3"))
        pairs = ", ".join(f"'{name}', CAST(c{i} AS BIGINT), CAST(t{i} AS BIGINT)" for i, name in enumerate(["decision_outcomes", "condition_outcomes", "conditions"], 1))
        parts.append(wide.select(*by, F.expr(f"stack(3, {pairs}) AS (metric, covered, total)")))
    rows = reduce(DataFrame.unionByName, parts).filter("total > 0")
    kept = rows if metrics is None else rows.filter(F.col("metric").isin(metrics))
    return kept.select(*by, "metric", "covered", "total", percentage(F.col("covered"), F.col("total")).alias("pct"))


def completeness(summary_rows: DataFrame, limitations: DataFrame) -> DataFrame:
    """Per run: whether every metric that counts is whole, and no limitation blocks."""
    counted = ["lines", "statements", "functions", "branches", "condition_outcomes", "conditions"]
    whole = summary_rows.filter(F.col("metric").isin(counted)).groupBy("run_id").agg(F.bool_and(F.col("pct") == 100.0).alias("_whole"))
    blocked = limitations.groupBy("run_id").agg(F.bool_or(F.coalesce("blocking", F.lit(True))).alias("_blocked"))
    return whole.join(blocked, "run_id", "left").select(
        "run_id", (F.col("_whole") & ~F.coalesce("_blocked", F.lit(False))).alias("coverage_complete"),
        F.coalesce("_blocked", F.lit(False)).alias("completeness_blocked"),
    )


def exact_fraction(points: DataFrame, branches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Measured share of all obligations; null where none was declined."""
    branch = branches.groupBy("run_id", "branch_id").agg(F.bool_and("declined").alias("declined")).select("run_id", "declined")
    every = reduce(DataFrame.unionByName, [points.select("run_id", "declined"), branch, decisions.select("run_id", "declined")])
    return every.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("obligations"), F.count_if(~F.col("declined")).alias("measured")
    ).select(
        "run_id", "obligations", "measured",
        F.when(F.col("obligations") > F.col("measured"), F.col("measured") * 100.0 / F.col("obligations")).alias("exact_fraction_pct"),
    )
