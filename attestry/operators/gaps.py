"""What is missing: gaps per file and directory, and how they rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import coverage, mcdc

# The five metrics of a gap, with their weight in a file's score.
WEIGHTS = {"lines": 1, "statements": 0, "functions": 2, "branches": 2, "conditions": 3}
LIMITATION_WEIGHT = 3


def uncovered_conditions(decisions: DataFrame, vectors: DataFrame, keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Every measured condition with whether the evidence shows it deciding."""
    whole = decisions.filter("not declined").select("run_id", F.col("id").alias("decision_id"), "file", "line", "col", "conditions")
    if groups is not None:
        whole = groups.join(whole, "run_id")
    facts = mcdc.decision_facts(vectors, keys).select(*keys, "decision_id", "shown")
    every = whole.join(facts, [*keys, "decision_id"], "left").withColumn("condition", F.explode(F.sequence(F.lit(0), F.col("conditions") - 1)))
    return every.withColumn("covered", F.coalesce(F.array_contains("shown", F.col("condition")), F.lit(False))).drop("shown")


def obligation_states(
    points: DataFrame, branches: DataFrame, decisions: DataFrame, hits: DataFrame, vectors: DataFrame,
) -> DataFrame:
    """Every measured obligation of every run with its state, long:
    run_id, metric, id, file, line, covered. Conditions are ``<decision>#<n>``."""
    covered = coverage.covered_ids(hits, ["run_id"]).withColumn("covered", F.lit(True))
    sites = coverage.obligations(points, branches).join(covered, ["run_id", "id"], "left").select(
        "run_id", "metric", "id", "file", "line", F.coalesce("covered", F.lit(False)).alias("covered")
    )
    lines = sites.filter(F.col("metric").isin("statements", "functions")).groupBy("run_id", "file", "line").agg(
        F.bool_or("covered").alias("covered")
    ).select("run_id", F.lit("lines").alias("metric"), F.concat("file", F.lit(":"), "line").alias("id"), "file", "line", "covered")
    conditions = uncovered_conditions(decisions, vectors, ["run_id"]).select(
        "run_id", F.lit("conditions").alias("metric"), F.concat("decision_id", F.lit("#"), "condition").alias("id"), "file", "line", "covered"
    )
    return reduce(DataFrame.unionByName, [sites, lines, conditions])


def limitation_mask(kind: Column) -> Column:
    return F.when(kind == "dynamic-code", 1).when(kind == "semantic-safety", 2).when(kind == "source-scope", 4).otherwise(8)


def file_limitations(limitations: DataFrame) -> DataFrame:
    return limitations.groupBy("run_id", "file").agg(
        F.count(F.lit(1)).alias("limitations"), F.bit_or(limitation_mask(F.col("kind"))).alias("limitation_mask")
    )


def score(columns: dict[str, Column], limitations: Column) -> Column:
    return sum((columns[name] * weight for name, weight in WEIGHTS.items() if weight), limitations * LIMITATION_WEIGHT)


def _wide(rows: DataFrame, by: list[str], value: Column, prefix: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == name, value)), F.lit(0)).alias(f"{prefix}{name}") for name in WEIGHTS]
    )


def file_gaps(
    points: DataFrame, branches: DataFrame, decisions: DataFrame, hits: DataFrame, vectors: DataFrame, limitations: DataFrame,
    metrics: list[str] | None = None,
) -> DataFrame:
    """Per run and file: uncovered and total per metric, limitations, score. Where ``metrics`` are
    named only these are counted, and there is no score."""
    rows = coverage.summary(points, branches, decisions, hits, vectors, ["run_id"], by_file=True, metrics=list(WEIGHTS) if metrics is None else metrics)
    counts = rows.groupBy("run_id", "file").agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("total") - F.col("covered"))), F.lit(0)).alias(f"uncovered_{m}") for m in WEIGHTS],
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("total"))), F.lit(0)).alias(f"total_{m}") for m in WEIGHTS],
    )
    # A file none of whose obligations is measured still has a row, all zero.
    files = points.select("run_id", "file").unionByName(branches.select("run_id", "file")).unionByName(
        decisions.select("run_id", "file")).distinct()
    noted = file_limitations(limitations)
    joined = files.join(counts, ["run_id", "file"], "left").join(noted, ["run_id", "file"], "full_outer")
    zero = [name for name in joined.columns if name not in ("run_id", "file")]
    filled = joined.select("run_id", "file", *[F.coalesce(name, F.lit(0)).alias(name) for name in zero])
    if metrics is not None:
        return filled.select("run_id", "file", *[f"{k}_{m}" for k in ("uncovered", "total") for m in metrics], "limitations", "limitation_mask")
    return filled.withColumn("score", score({m: F.col(f"uncovered_{m}") for m in WEIGHTS}, F.col("limitations")))


def group_gaps(
    points: DataFrame, branches: DataFrame | None, decisions: DataFrame | None, hits: DataFrame, vectors: DataFrame | None,
    tests: DataFrame, dimension: str, metrics: list[str] | None = None,
) -> DataFrame:
    """Per run, group and file: what the group's tests leave uncovered, split
    into what other tests cover and what nothing covers; of the named ``metrics``
    alone, or of all five."""
    metrics = list(WEIGHTS) if metrics is None else metrics
    who = tests.select("run_id", "test_id", dimension)
    keys = ["run_id", dimension]
    groups = who.select(*keys).distinct()
    by_group = coverage.summary(
        points, branches, decisions, hits.join(who, ["run_id", "test_id"]), vectors and vectors.join(who, ["run_id", "test_id"]), keys, by_file=True, groups=groups, metrics=metrics,
    )
    overall = coverage.covered_counts(points, branches, decisions, hits, vectors, ["run_id"], by_file=True, metrics=metrics).withColumnRenamed("covered", "_overall")
    # Coverage is monotone in the tests, so what any test covers beyond the
    # group is the overall count less the group's own.
    return by_group.join(overall, ["run_id", "file", "metric"], "left").select(
        *keys, "file", "metric", (F.col("total") - F.col("covered")).alias("uncovered"), "total", "covered",
        (F.coalesce("_overall", F.lit(0)) - F.col("covered")).alias("covered_by_other_tests"),
        (F.col("total") - F.coalesce("_overall", F.lit(0))).alias("uncovered_everywhere"),
    )


def has_gap(metric: str, with_limitations: bool = False) -> Column:
    """A file with a gap of the metric; ``all`` is any of the five."""
    names = list(WEIGHTS) if metric == "all" else [metric]
    found = reduce(lambda a, b: a | b, [F.col(f"uncovered_{name}") > 0 for name in names])
    return found | (F.col("limitations") > 0) if with_limitations else found


def file_order() -> list[Column]:
    """Largest gap first, then most limitations, then by name."""
    return [F.desc("value"), F.desc("limitations"), F.asc("file")]


def rank_files(gaps: DataFrame, metric: str) -> DataFrame:
    """Largest gap first, then most limitations, then by name."""
    value = F.col("score") if metric == "all" else F.col(f"uncovered_{metric}")
    return gaps.filter(has_gap(metric, with_limitations=True)).withColumn("value", value).orderBy(
        "run_id", *file_order()
    )


def area_directory(file: Column, depth: int) -> Column:
    """The first ``depth`` folders of a path, ``.`` at the top."""
    parts = F.split(file, "/")
    folders = F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1))
    return F.when(F.size(parts) == 1, ".").otherwise(F.array_join(folders, "/"))


def areas(file_counts: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Covered and total per directory and metric from per-file counts."""
    return (
        file_counts.withColumn("directory", area_directory(F.col("file"), depth))
        .groupBy(*keys, "directory", "metric")
        .agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("files"))
    )


def areas_by_kind(
    points: DataFrame, branches: DataFrame, decisions: DataFrame, hits: DataFrame, vectors: DataFrame,
    tests: DataFrame, depth: int, metric: str = "lines",
) -> DataFrame:
    """A directory's coverage: by anything, by all tests together, by each kind."""
    from attestry.operators import dimensions

    whole = coverage.summary(points, branches, decisions, hits, vectors, ["run_id"], by_file=True, metrics=[metric])
    owned = dimensions.kind_rows(tests)
    split = owned.select("run_id", "test_id", F.explode(F.array("kind", F.lit(dimensions.ALL_TESTS))).alias("group"))
    keys = ["run_id", "group"]
    counted = coverage.covered_counts(
        points, branches, decisions, hits.join(split, ["run_id", "test_id"]), vectors.join(split, ["run_id", "test_id"]), keys, by_file=True, metrics=[metric],
    )
    rows = counted.groupBy("run_id", "group", area_directory(F.col("file"), depth).alias("directory")).agg(
        F.sum("covered").alias("covered"))
    every = areas(whole, ["run_id"], depth).drop("metric")
    return every.select("run_id", "directory", "files", "total", F.lit("any").alias("group"), "covered").unionByName(
        every.select("run_id", "directory", "files", "total").join(rows, ["run_id", "directory"])
    )


def decision_gaps(decisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Decisions with a condition not shown: how many, which, and whether run at all."""
    states = uncovered_conditions(decisions, vectors, ["run_id"])
    executed = vectors.select("run_id", "decision_id").distinct().withColumn("executed", F.lit(True))
    return (
        states.groupBy("run_id", "decision_id", "file", "line", "col", "conditions")
        .agg(
            F.count_if(~F.col("covered")).alias("missing"),
            # At most one entry per condition of the decision.
            F.array_join(F.array_sort(F.collect_set(F.when(~F.col("covered"), F.col("condition")))), ",").alias("missing_conditions"),
        )
        .filter("missing > 0")
        .join(executed, ["run_id", "decision_id"], "left")
        .withColumn("executed", F.coalesce("executed", F.lit(False)))
    )


def gap_lines(states: DataFrame, limitations: DataFrame) -> DataFrame:
    """Lines with something open or limited: how many obligations per metric.

    ``missing``: the line is an open obligation itself, or nothing on it ran and
    no MC/DC condition of it is open. ``part``: some of it is open or ran.
    ``limited``: nothing but limitations.
    """
    opened = F.col("metric") != "conditions"
    sites = states.groupBy("run_id", "file", "line").agg(
        F.bool_or(opened & F.col("covered")).alias("_ran"),
        *[F.count_if((F.col("metric") == m) & ~F.col("covered")).alias(m) for m in WEIGHTS],
    )
    noted = limitations.groupBy("run_id", "file", "line").agg(F.count(F.lit(1)).alias("limitations"))
    names = [*WEIGHTS, "limitations"]
    joined = sites.join(noted, ["run_id", "file", "line"], "full_outer").select(
        "run_id", "file", "line", F.coalesce("_ran", F.lit(False)).alias("_ran"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    total = sum((F.col(m) for m in WEIGHTS), F.lit(0))
    never_ran = ~F.col("_ran") & (total > 0) & (F.col("conditions") == 0)
    return joined.filter((total > 0) | (F.col("limitations") > 0)).withColumn(
        "state",
        F.when(never_ran | (F.col("lines") > 0), "missing").when((total > 0) | F.col("_ran"), "part").otherwise("limited"),
    ).drop("_ran")


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """A page of every run's ordered rows."""
    if limit <= 0 or offset < 0:
        raise ValueError("a page needs a positive limit and no negative offset")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= offset + limit).filter(F.col("_place") > offset).drop("_place")


def page_facts(df: DataFrame, offset: int, limit: int, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One row about every run's page: returned, total, has_more, next_offset."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
    more = F.lit(offset) + returned < F.col("total")
    return total.select(
        *keys, F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), returned.alias("returned"), "total",
        more.alias("has_more"), F.when(more, F.lit(offset) + returned).alias("next_offset"),
    )
