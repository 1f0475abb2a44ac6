"""Detail of a line, a test, a decision or a hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_details(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with what the manifest says of them; ``unknown`` where it says nothing."""
    places = points.select("run_id", F.col("id").alias("hit_id"), "kind", "file", "line", "label")
    counted = hits.groupBy("run_id", "test_id", "hit_id").agg(F.count(F.lit(1)).alias("hits"))
    return counted.join(places, ["run_id", "hit_id"], "left").select(
        "run_id", "test_id", "hit_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), "file", "line", "label", "hits"
    )


def compact_source(source):
    """The first line that is not blank, whitespace squeezed, cut at 120 characters."""
    line = F.get(F.filter(F.split(source, "\r?\n"), lambda text: text.rlike(r"\S")), 0)
    squeezed = F.regexp_replace(F.regexp_replace(line, r"\s+", " "), "^ | $", "")
    return F.when(F.char_length(squeezed) > 120, F.concat(F.substring(squeezed, 1, 119), F.lit("…"))).otherwise(squeezed)


def covered_elsewhere(points: DataFrame, hits: DataFrame, tests: DataFrame, selected: DataFrame) -> DataFrame:
    """Obligations the selected tests miss and others cover, with whose they are."""
    mine = selected.select("run_id", "test_id")
    reached = hits.select("run_id", "test_id", F.col("hit_id").alias("id")).distinct()
    met = reached.join(mine, ["run_id", "test_id"], "left_semi").select("run_id", "id").distinct()
    others = reached.join(mine, ["run_id", "test_id"], "left_anti").join(tests.select("run_id", "test_id", "kind", "runner"), ["run_id", "test_id"])
    missing = points.filter("not declined").select("run_id", "id", "file", "line").join(met, ["run_id", "id"], "left_anti")
    return others.join(missing, ["run_id", "id"]).groupBy("run_id", "id", "file", "line").agg(
        F.count(F.lit(1)).alias("tests"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("runner")), ",").alias("runners"),
    )


def line_tests(points: DataFrame, hits: DataFrame, tests: DataFrame, first: int | None = None) -> DataFrame:
    """Tests covering each line; ``first`` keeps that many per line, by name."""
    from pyspark.sql import Window

    measured = points.filter("not declined").select("run_id", F.col("id").alias("hit_id"), "file", "line")
    reached = hits.select("run_id", "test_id", "hit_id").distinct().join(measured, ["run_id", "hit_id"]).select(
        "run_id", "file", "line", "test_id").distinct()
    named = reached.join(tests.select("run_id", "test_id", "name", "kind", "runner"), ["run_id", "test_id"])
    if first is None:
        return named
    # A rank kept below a constant is cut before the shuffle as well as after.
    order = Window.partitionBy("run_id", "file", "line").orderBy("name", "test_id")
    return named.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first)


def line_detail(points: DataFrame, hits: DataFrame, tests: DataFrame, limitations: DataFrame, states: DataFrame) -> DataFrame:
    """Per line: covering tests, kinds, limitations that hold there and obligations open.

    What is told of a line comes from several tables and is counted in one aggregation; a whole file's
    limitations are counted once for the file."""
    on = ["run_id", "file", "line"]
    measured = points.filter("not declined").select("run_id", F.col("id").alias("hit_id"), "file", "line")
    # Equal rows go where a line's tests are told apart, and need not go before.
    covering = hits.select("run_id", "test_id", "hit_id").join(tests.select("run_id", "test_id", F.col("kind").alias("_kind")), ["run_id", "test_id"]).join(
        measured, ["run_id", "hit_id"]).select(*on, "test_id", "_kind").distinct()
    told = limitations.withColumn("_wide", F.coalesce(whole_file_scope(), F.lit(False)))
    one = F.lit(1).cast("long")
    parts = [
        points.select(*on, (~F.col("declined")).alias("_measured")),
        covering.select(*on, one.alias("_tests"), "_kind"),
        told.filter("not _wide").select(*on, one.alias("_noted")),
        states.filter("metric <> 'lines' and not covered").select(*on, one.alias("_open")),
    ]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lines = united.groupBy(*on).agg(
        F.bool_or("_measured").alias("measured"), F.count("_tests").alias("tests"), F.size(F.collect_set("_kind")).cast("long").alias("kinds"),
        F.count("_noted").alias("_noted"), F.count("_open").alias("open")).filter("measured is not null")
    wide = told.filter("_wide").groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("_whole"))
    return lines.join(wide, ["run_id", "file"], "left").select(
        *on, "measured", "tests", "kinds", (F.col("_noted") + F.coalesce("_whole", F.lit(0))).alias("limitations"), "open")


def whole_file_scope() -> Column:
    """Whether a limitation is of its whole file."""
    return (F.col("kind") == "source-scope") & (F.coalesce("source", F.lit("")).isin("") | (F.col("source") == F.col("file")))


def limitations_of_lines(lines: DataFrame, limitations: DataFrame) -> DataFrame:
    """A line's limitations: those on it, and ``source-scope`` ones of its whole
    file, which quote no code of their own."""
    where = lines.select("run_id", "file", "line").distinct()
    told = limitations.withColumn("_wide", F.coalesce(whole_file_scope(), F.lit(False)))
    on_line = where.join(told.filter("not _wide").select("run_id", "file", "line", "id"), ["run_id", "file", "line"])
    in_file = where.join(told.filter("_wide").select("run_id", "file", "id"), ["run_id", "file"]).select("run_id", "file", "line", "id")
    return on_line.unionByName(in_file)


def test_detail(tests: DataFrame, points: DataFrame, hits: DataFrame, vectors: DataFrame, phases: DataFrame) -> DataFrame:
    """Per test: hits, hits the manifest lacks, lines, decisions, vectors, phases."""
    places = points.select("run_id", F.col("id").alias("hit_id"), "file", "line")
    reached = hits.select("run_id", "test_id", "hit_id").distinct().join(places, ["run_id", "hit_id"], "left").groupBy("run_id", "test_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("file").isNull()).alias("unknown_hits"),
        F.count_distinct("file", "line").alias("lines"),
    )
    decided = vectors.groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("decision_id").alias("decisions"))
    ran = phases.groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("phases"))
    on = ["run_id", "test_id"]
    joined = tests.select(*on, "name", "role").join(reached, on, "left").join(decided, on, "left").join(ran, on, "left")
    counts = ("hits", "unknown_hits", "lines", "decisions", "vectors", "phases")
    return joined.select(*on, "name", "role", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def decision_detail(decisions: DataFrame, vectors: DataFrame, selected: DataFrame) -> DataFrame:
    """Per condition under a test filter: values never seen, whether shown, and
    the gap in words. Witnesses are rebuilt from the selected tests alone."""
    from attestry.operators import mcdc

    whole = decisions.filter("not declined").select("run_id", F.col("id").alias("decision_id"), "conditions")
    picked = vectors.join(selected.select("run_id", "test_id"), ["run_id", "test_id"], "left_semi")
    seen = mcdc.observations(picked, ["run_id"])
    shown = mcdc.witnesses(seen, ["run_id"]).select("run_id", "decision_id", "condition", "first_vector", "second_vector")
    values = seen.select("run_id", "decision_id", F.posexplode("vals").alias("condition", "value")).groupBy("run_id", "decision_id", "condition").agg(
        F.bool_or(F.coalesce("value", F.lit(False))).alias("_true"), F.bool_or(~F.coalesce("value", F.lit(True))).alias("_false"))
    every = whole.withColumn("condition", F.explode(F.sequence(F.lit(0), F.col("conditions") - 1)))
    on = ["run_id", "decision_id", "condition"]
    joined = every.join(values, on, "left").join(shown, on, "left")
    seen_values = F.array_compact(F.array(
        F.when(F.col("_true"), "true"), F.when(F.col("_false"), "false")))
    missing = F.array_except(F.array(F.lit("true"), F.lit("false")), seen_values)
    name = F.concat(F.lit("c"), F.col("condition").cast("string"))
    return joined.select(
        *on, F.col("first_vector").isNotNull().alias("covered"), F.array_join(missing, ",").alias("missing"),
        missing_words(name, missing).alias("words"), "first_vector", "second_vector",
    )


def missing_words(condition, missing):
    tick = F.concat(F.lit("`"), condition, F.lit("`"))
    return (
        F.when(F.size(missing) == 0, F.concat(tick, F.lit(" was seen both ways but never deciding the result alone")))
        .when(F.size(missing) == 1, F.concat(tick, F.lit(" was never "), F.get(missing, 0)))
        .otherwise(F.concat(tick, F.lit(" was never evaluated")))
    )
