"""LCOV tracefiles and unified diffs, read from numbered lines (file, pos, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import ordered


def _number(text):
    whole = F.trim(text).try_cast("long")
    decimal = F.trim(text).try_cast("double")
    # A count past the largest whole number is held at it.
    return F.when(whole >= 0, whole).when(decimal >= float(2**63), F.lit(2**63 - 1)).otherwise(F.when(F.coalesce(decimal != 0, F.lit(False)), 1).otherwise(0))


def _total(counts):
    """The counts' sum, held at the largest whole number."""
    return F.least(F.sum(counts.cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def _records(lines: DataFrame) -> DataFrame:
    """Tagged lines with the source file they belong to; the file is carried
    forward from its ``SF`` line and ended by ``end_of_record``."""
    bare = lines.withColumn("text", F.trim("text"))
    tagged = bare.withColumn("tag", F.regexp_extract("text", "^([A-Z]+):", 1)).withColumn("value", F.regexp_replace("text", "^[A-Z]+:", ""))
    mark = F.when(F.col("tag") == "SF", F.col("value")).when(F.col("text") == "end_of_record", "")
    begun = F.when((F.col("tag") == "SF") | (F.col("text") == "end_of_record"), F.col("pos"))
    filled = ordered.fill_forward(tagged.withColumn("source", mark).withColumn("record", begun), ["file"], "pos", ["source", "record"])
    stray = F.col("tag").isin("DA", "FN", "FNDA") & (F.coalesce("source", F.lit("")) == "")
    return filled.withColumn("source", F.when(stray, F.raise_error(F.concat(F.lit("line "), F.col("pos").cast("string"), F.lit(": "), "tag", F.lit(" before any SF"))).cast("string")).otherwise(F.col("source")))


def read_lines(lines: DataFrame) -> DataFrame:
    """(file, line, count): counts of every ``DA`` of a source file added up. A
    count no whole number ran if it is a number other than zero."""
    fields = F.split("value", ",")
    da = _records(lines).filter("tag = 'DA'")
    return da.groupBy(F.col("source").alias("file"), F.trim(F.get(fields, 0)).cast("int").alias("line")).agg(_total(_number(F.get(fields, 1))).alias("count"))


def read_functions(lines: DataFrame) -> DataFrame:
    """(file, line, count) of functions: ``FNDA`` counts by the line ``FN`` gave
    the name in the same record, in its two- and three-field forms."""
    told = _records(lines).withColumn("fields", F.split("value", ","))
    last = F.element_at("fields", -1)
    named = told.filter("tag = 'FN'").groupBy("file", "record", last.alias("name")).agg(F.max_by(F.trim(F.get("fields", 0)).cast("int"), "pos").alias("line"))
    counts = told.filter("tag = 'FNDA'").select("file", "record", "source", F.array_join(F.slice("fields", 2, 2**30), ",").alias("name"), last.alias("_last"), _number(F.get("fields", 0)).alias("count"))
    whole = counts.join(named, ["file", "record", "name"], "left")
    by_last = named.withColumnsRenamed({"name": "_last", "line": "_line"})
    return whole.join(by_last, ["file", "record", "_last"], "left").withColumn("line", F.coalesce("line", "_line")).filter("line is not null").groupBy(
        F.col("source").alias("file"), "line").agg(_total(F.col("count")).alias("count"))


def match_paths(recorded: DataFrame, measured: DataFrame) -> DataFrame:
    """The measured path each recorded one is or ends with after a slash, the
    longest; joined on the file name, so only namesakes are compared."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    told = recorded.select("recorded").distinct().withColumn("_path", F.regexp_replace(F.translate("recorded", "\\", "/"), r"^(\./)+", "")).withColumn("_name", name("_path"))
    known = measured.select(F.col("file")).distinct().withColumn("_name", name("file"))
    fits = (F.col("_path") == F.col("file")) | F.endswith("_path", F.concat(F.lit("/"), "file"))
    return told.join(known, "_name").filter(fits).groupBy("recorded").agg(F.max_by("file", F.length("file")).alias("file"))


def import_hits(read: DataFrame, functions: DataFrame, points: DataFrame, run_id: str, test_id: str | None) -> DataFrame:
    """Hits a tracefile earns: every statement on a line that ran, every entered
    function. They belong to one imported test, or to background work."""
    here = points.filter(F.col("run_id") == run_id)
    ran = read.filter("count > 0").select("file", "line")
    entered = functions.filter("count > 0").select("file", "line")
    hits = here.filter("kind = 'statement'").join(ran, ["file", "line"], "left_semi").unionByName(
        here.filter("kind = 'function'").join(entered, ["file", "line"], "left_semi"))
    return hits.select("run_id", F.lit(test_id or "background").alias("test_id"), F.col("id").alias("hit_id"))


def import_unmeasured(read: DataFrame, points: DataFrame, run_id: str) -> DataFrame:
    """One statement per line of files the run did not measure."""
    known = points.filter(F.col("run_id") == run_id).select("file").distinct()
    new = read.join(known, "file", "left_anti")
    return new.select(
        F.lit(run_id).alias("run_id"), F.concat(F.lit("line:"), "file", F.lit(":"), F.col("line").cast("string")).alias("id"), F.lit("statement").alias("kind"),
        "file", "line", (F.col("count") > 0).alias("covered"))


def past_the_end(read: DataFrame, lengths: DataFrame) -> DataFrame:
    """Recorded lines past the end of their file: a tracefile of another version."""
    return read.join(lengths, "file").filter(F.col("line") > F.col("lines")).select("file", "line", "lines")


def changed_lines(lines: DataFrame) -> DataFrame:
    """(file, line) of a unified diff's added and changed lines. Deleted files and
    hunks that add nothing are passed over."""
    target = F.rtrim(F.regexp_replace(F.regexp_extract("text", r"^\+\+\+ (.*)$", 1), "^b/", ""))
    marked = lines.withColumn("target", F.when(F.col("text").startswith("+++ "), target))
    filled = ordered.fill_forward(marked, ["file"], "pos", ["target"])
    plus = r"^@@ (?:\S+ )*?\+(\d+)(?:,(\d+))?"
    hunks = filled.filter(F.col("text").startswith("@@ ") & (F.col("target") != "/dev/null")).select(
        F.col("target").alias("file"), F.regexp_extract("text", plus, 1).try_cast("int").alias("start"),
        F.coalesce(F.nullif(F.regexp_extract("text", plus, 2), F.lit("")), F.lit("1")).try_cast("int").alias("count"))
    return hunks.filter("start is not null and count > 0").select("file", F.explode(F.expr("sequence(start, start + count - 1)")).alias("line")).distinct()
