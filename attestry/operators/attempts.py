"""Attempts, outcomes and the views that keep some records of a run.

``records`` hold one row per test record: run_id, test_id, retry, status,
expected_status, flaky, attribution, role, seq and whatever evidence they
carry. All work per test or attempt is a partial aggregation, so a test with a
third of all records costs no more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEST = ["run_id", "test_id"]
ATTEMPT = [*TEST, "retry"]

# Attributions from the most to the least exact.
ATTRIBUTION_RANKS = ["exact", "by-time", "partial", "run-wide"]


def attribution_rank(attribution: Column) -> Column:
    rank = F.lit(0)
    for index, name in enumerate(ATTRIBUTION_RANKS):
        rank = F.when(attribution == name, index).otherwise(rank)
    return rank


def least_exact(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in ATTRIBUTION_RANKS]), rank + 1)


def coverage_is_its_own(attribution: Column) -> Column:
    return F.coalesce(attribution, F.lit("")) != "run-wide"


def coverage_is_complete(attribution: Column) -> Column:
    return F.coalesce(attribution, F.lit("")).isin("exact", "by-time", "")


def effective_status(status: Column, expected: Column) -> Column:
    """An attempt expected to fail passes by failing, and the other way round."""
    inverted = F.when(status == "failed", "passed").when(status == "passed", "failed").otherwise(status)
    return F.when(expected == "failed", inverted).otherwise(status)


def fold_attempts(records: DataFrame) -> DataFrame:
    """One row per (run, test, retry): a failed record sticks, ``unknown``
    never overwrites a known status, the last stated expectation is kept."""
    told = F.col("status").isNotNull()
    known = told & (F.col("status") != "unknown")
    return (
        records.filter(F.col("retry").isNotNull() & told)
        .groupBy(*ATTEMPT)
        .agg(
            F.bool_or(F.col("status") == "failed").alias("_failed"),
            F.max_by("status", F.when(known, F.struct("seq", "status"))).alias("_known"),
            F.max_by("expected_status", F.when(F.col("expected_status").isNotNull(), F.struct("seq", "expected_status"))).alias("expected_status"),
            F.count(F.lit(1)).alias("records"),
        )
        .select(
            *ATTEMPT,
            F.when(F.col("_failed"), "failed").otherwise(F.coalesce("_known", F.lit("unknown"))).alias("status"),
            "expected_status", "records",
        )
    )


def outcomes(records: DataFrame) -> DataFrame:
    """A test's outcome: its last attempt's, ``flaky`` where it passed after an
    attempt that did not or its runner said so; never attempted tests are
    ``unstarted`` where a record says so, else ``unknown``."""
    attempts = fold_attempts(records).withColumn("_effective", effective_status(F.col("status"), F.col("expected_status")))
    folded = attempts.groupBy(*TEST).agg(
        F.max_by("_effective", "retry").alias("_last"),
        F.max("retry").alias("last_retry"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("_effective") != "passed").alias("_not_passed"),
    )
    seen = records.groupBy(*TEST).agg(
        F.bool_or(F.coalesce("flaky", F.lit(False))).alias("_flaky"),
        F.bool_or(F.coalesce(F.col("status") == "unstarted", F.lit(False)) & F.col("retry").isNull()).alias("_unstarted"),
    )
    flaky = (F.col("_last") == "passed") & (F.col("_flaky") | (F.col("_not_passed") > 0))
    return seen.join(folded, TEST, "left").select(
        *TEST,
        F.when(F.col("_last").isNull(), F.when(F.col("_unstarted"), "unstarted").otherwise("unknown"))
        .when(flaky, "flaky").otherwise(F.col("_last")).alias("outcome"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), "last_retry",
    )


def terminal_attempts(records: DataFrame) -> DataFrame:
    """The last attempt of each test."""
    return records.filter(F.col("retry").isNotNull()).groupBy(*TEST).agg(F.max("retry").alias("retry"))


def passed_attempts(records: DataFrame) -> DataFrame:
    """Last attempts some record of which passed and none was expected to fail."""
    folded = records.filter(F.col("retry").isNotNull()).groupBy(*ATTEMPT).agg(
        F.bool_or(F.coalesce(F.col("status") == "passed", F.lit(False))).alias("_passed"),
        F.bool_or(F.coalesce(F.col("expected_status") == "failed", F.lit(False))).alias("_expected_failure"),
    )
    last = folded.groupBy(*TEST).agg(F.max_by(F.struct("retry", "_passed", "_expected_failure"), "retry").alias("_a"))
    return last.filter("_a._passed and not _a._expected_failure").select(*TEST, F.col("_a.retry").alias("retry"))


def failed_attempts(records: DataFrame) -> DataFrame:
    """Attempts that failed; records stating an expectation decide alone where
    there are any."""
    failing = (
        F.when((F.col("status") == "passed") & (F.col("expected_status") == "failed"), True)
        .when((F.col("status") == "failed") & (F.coalesce("expected_status", F.lit("")) != "failed"), True)
        .otherwise(False)
    )
    stated = F.col("expected_status").isNotNull()
    folded = records.filter(F.col("retry").isNotNull()).groupBy(*ATTEMPT).agg(
        F.bool_or(stated).alias("_stated"),
        F.bool_or(stated & failing).alias("_stated_failing"),
        F.bool_or(failing).alias("_failing"),
    )
    return folded.filter(F.when(F.col("_stated"), F.col("_stated_failing")).otherwise(F.col("_failing"))).select(*ATTEMPT)


def view(records: DataFrame, name: str) -> DataFrame:
    """The records of a view: ``passed``, ``failed`` or ``all``."""
    if name == "all":
        return records
    if name not in ("passed", "failed"):
        raise ValueError(f"unknown view {name!r}")
    kept = passed_attempts(records) if name == "passed" else failed_attempts(records)
    return records.join(kept, ATTEMPT, "left_semi")


def test_attributions(records: DataFrame) -> DataFrame:
    """The least exact attribution any record of a test claims."""
    return records.groupBy(*TEST).agg(F.max(attribution_rank(F.col("attribution"))).alias("_rank")).select(
        *TEST, least_exact(F.col("_rank")).alias("attribution")
    )


def attribution_counts(tests: DataFrame) -> DataFrame:
    return tests.filter("role = 'test'").groupBy("run_id").agg(
        *[F.count_if(F.col("attribution") == name).alias(name.replace("-", "_")) for name in ATTRIBUTION_RANKS]
    )


def outcome_counts(records: DataFrame) -> DataFrame:
    """Tests per run and outcome; setup and background records are no tests."""
    return outcomes(records.filter("role = 'test'")).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("tests"))
