"""Evidence rules: each yields (run_id, rule, key) rows, none for a valid run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import checkpointed

# The kinds a phase may have, and the limits of a coverage model.
PHASE_KINDS = ["setup", "test", "action", "assertion", "teardown", "background"]
MAX_IDENTIFIER_BYTES, MAX_DESCRIPTION_BYTES, MAX_SURFACES = 64, 4096, 256


def _rows(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select("run_id", F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def runners(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Every runner seen is declared; every declared one is seen, if anything was."""
    seen = records.select("run_id", "runner").distinct()
    told = declared.select("run_id", "runner").distinct()
    unseen = told.join(seen, ["run_id", "runner"], "left_anti").join(seen.select("run_id").distinct(), "run_id", "left_semi")
    return _rows(seen.join(told, ["run_id", "runner"], "left_anti"), "undeclared runner", F.col("runner")).unionByName(
        _rows(unseen, "unobserved runner", F.col("runner")))


def limitations(declared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared limitation ids are the manifest's, each once."""
    told, known = declared.select("run_id", "id").distinct(), manifest.select("run_id", "id").distinct()
    twice = declared.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return reduce(DataFrame.unionByName, [
        _rows(told.join(known, ["run_id", "id"], "left_anti"), "limitation not in manifest", F.col("id")),
        _rows(known.join(told, ["run_id", "id"], "left_anti"), "limitation not declared", F.col("id")),
        _rows(twice, "limitation declared twice", F.col("id")),
    ])


def identities(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Axes a runner declares exact carry an identity, and a result's retry is its
    scope's. ``records``: record_id, runner, test_id, retry, status, observed and
    scope_* columns, null without a scope; ``declared``: exact_worker,
    exact_test, exact_retry."""
    joined = records.join(declared.select("run_id", "runner", "exact_worker", "exact_test", "exact_retry"), ["run_id", "runner"])
    scoped, missing = F.col("scope_run_id").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unstarted = F.coalesce(F.col("status") == "unstarted", F.lit(False))
    checks = [
        ("no test identity", F.col("exact_test") & (missing("test_id") | (scoped & ~F.col("test_id").eqNullSafe(F.col("scope_test_id"))))),
        ("no worker identity", F.col("exact_worker") & F.when(scoped, missing("scope_worker_id")).otherwise(F.col("observed"))),
        ("no retry identity", F.col("exact_retry") & F.col("retry").isNull() & (scoped | ~unstarted)),
        ("retry is not its scope's", F.col("exact_retry") & scoped & (F.col("retry") != F.col("scope_retry"))),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in checks]))
    return joined.select("run_id", F.explode(found).alias("rule"), F.col("record_id").cast("string").alias("key"))


def unstarted(records: DataFrame) -> DataFrame:
    """An unstarted result is a test with no scope, retry, flaky verdict or observation."""
    bad = (F.col("role") != "test") | F.col("scope_run_id").isNotNull() | F.col("retry").isNotNull() | F.coalesce("flaky", F.lit(False)) | F.col("observed")
    return _rows(records.filter((F.col("status") == "unstarted") & bad), "unstarted result with evidence", F.col("record_id"))


def scope_runs(records: DataFrame) -> DataFrame:
    other = F.col("scope_run_id").isNotNull() & (F.col("scope_run_id") != F.col("run_id"))
    return _rows(records.filter(other), "scope of another run", F.col("record_id"))


def phases(rows: DataFrame) -> DataFrame:
    """Phase kinds are known, ids unique in the run."""
    twice = rows.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _rows(rows.filter(~F.col("kind").isin(*PHASE_KINDS)), "phase kind", F.col("id")).unionByName(_rows(twice, "phase id twice", F.col("id")))


def phase_references(references: DataFrame, rows: DataFrame) -> DataFrame:
    """References name a phase of their own record."""
    known = rows.select("run_id", "record_id", F.col("id").alias("phase_id"))
    return _rows(references.filter("phase_id is not null").join(known, ["run_id", "record_id", "phase_id"], "left_anti"), "unknown phase", F.col("phase_id"))


def cyclic_causes(rows: DataFrame) -> DataFrame:
    """Phases on, or leading into, a cycle of causes.

    Cause chains are followed by doubling: after k rounds a pointer stands 2^k
    causes up, and one that still stands somewhere after as many steps as the
    largest record has phases is on or before a cycle. The loop ends there or when no
    pointer is left; lineage is cut in each round."""
    key = ["run_id", "record_id"]
    links = rows.filter("cause is not null").select(*key, "id", F.col("cause").alias("to"))
    known = rows.select(*key, F.col("id").alias("to"))
    jump = links.join(known, [*key, "to"], "left_semi").select(*key, "id", "to")
    largest = rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(largest).bit_length() + 1):
        jump = checkpointed(jump)
        if jump.isEmpty():
            break
        onward = jump.select(*key, F.col("id").alias("to"), F.col("to").alias("_next"))
        jump = jump.join(onward, [*key, "to"]).select(*key, "id", F.col("_next").alias("to"))
    return _rows(jump, "cyclic cause", F.col("id"))


def coverage_models(models: DataFrame) -> DataFrame:
    """A coverage model's strings are trimmed single lines within limits, its
    lists nonempty where they must be, unique and disjoint, its language the
    frontend's."""
    def clean(c: Column, limit: int) -> Column:
        return (c == F.trim(c)) & (c != "") & ~c.rlike("[\r\n]") & (F.octet_length(c) <= limit)

    def whole(name: str) -> Column:
        return F.forall(name, lambda item: clean(item, MAX_DESCRIPTION_BYTES)) & (F.size(name) <= MAX_SURFACES) & (F.size(F.array_distinct(name)) == F.size(name))

    checks = [
        ("model schema version", F.col("schema_version") != 1),
        ("model identifier", ~clean(F.col("language"), MAX_IDENTIFIER_BYTES) | ~clean(F.col("variant"), MAX_IDENTIFIER_BYTES)),
        ("model description", ~clean(F.col("name"), MAX_DESCRIPTION_BYTES) | ~clean(F.col("meaning"), MAX_DESCRIPTION_BYTES)),
        ("model measures nothing", F.size("measured") == 0),
        ("model surfaces", ~whole("measured") | ~whole("not_measured")),
        ("model lists overlap", F.arrays_overlap("measured", "not_measured")),
        ("model language", F.col("language") != F.col("frontend_language")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(rule)) for rule, test in checks]))
    return models.select("run_id", F.explode(found).alias("rule"), F.col("language").alias("key"))


def decisions(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Decisions have conditions and vectors a value for each."""
    widths = rows.select("run_id", F.col("id").alias("decision_id"), "conditions")
    wrong = vectors.join(widths, ["run_id", "decision_id"]).filter(F.size("vals") != F.col("conditions")).select("run_id", "decision_id").distinct()
    return _rows(rows.filter("conditions = 0"), "decision without conditions", F.col("id")).unionByName(
        _rows(wrong, "vector of another width", F.col("decision_id")))


def results(runs: DataFrame, records: DataFrame) -> DataFrame:
    return _rows(runs.join(records.select("run_id").distinct(), "run_id", "left_anti"), "no results", F.col("run_id"))
