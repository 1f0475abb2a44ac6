"""Scans of evidence: JSON documents, journals, manifests, event columns.

Files are split by Spark as far as their format allows: journals by line, other
documents by file. Order inside a file is that of its splits and of the lines in each, so a rule that
reads in order needs no task that holds a whole journal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import schemas
from attestry.operators import ordered


def strict_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Test records; one malformed line or document fails the scan."""
    return spark.read.schema(schemas.RECORD).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): journal lines with where they stand, splittable.

    A file is read by as many tasks as it has splits. ``block`` is where a line's split begins in its file and ``at``
    grows along a split, so (file, block, at) is the order of the file without a task that reads it whole."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, block, at, text): the lines that are not empty, ``pos`` counting all of a file's lines from one."""
    return ordered.split_numbers(text_lines(spark, path), ["file"], "block", "at", "pos").filter("text <> ''").withColumn("text", F.regexp_replace("text", "\r$", ""))


def parsed(lines: DataFrame, schema) -> DataFrame:
    """Lines read as JSON: ``record``, and ``torn`` where a line is no record."""
    shape = schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema
    read = F.from_json("text", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("record", read).withColumn("torn", F.col("record._corrupt").isNotNull() | F.col("record").isNull())


def tolerant(lines: DataFrame, schema=schemas.SERVER_RECORD) -> tuple[DataFrame, DataFrame]:
    """Good records, and one row counting torn records and the files they are in."""
    read = parsed(lines, schema)
    good = read.filter("not torn").drop("torn")
    corrupt = read.agg(F.count_if("torn").alias("corrupt_records"), F.count_distinct(F.when(F.col("torn"), F.col("file"))).alias("corrupt_files"))
    return good, corrupt


def scoped_server_records(lines: DataFrame) -> DataFrame:
    """Server records of numbered lines; a line without a scope takes the scope of
    the line before it in its file, one row for each split being carried to those behind it."""
    good, _ = tolerant(lines)
    flat = good.select("file", "block", "at", "pos", F.col("record.type").alias("type"), F.col("record.id").alias("id"), F.col("record.timestampMs").alias("timestamp_ms"),
                       F.col("record.phaseId").alias("phase_id"), F.col("record.request").alias("request"), F.col("record.scope").alias("scope"))
    return ordered.fill_splits(flat, ["file"], "block", "at", ["scope"]).drop("block", "at")


def manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """A manifest's child tables, one row per entry."""
    unmeasured = F.coalesce("unmeasured", F.array().cast("array<string>"))
    listed = manifests.select(F.col("runId").alias("run_id"), F.explode(unmeasured).alias("id"))
    known = listed.distinct()

    def exploded(name: str) -> DataFrame:
        return manifests.select(F.col("runId").alias("run_id"), F.explode(name).alias("e")).select("run_id", "e.*")

    def marked(entries: DataFrame, column: str, mark: str) -> DataFrame:
        """Entries with whether the run's manifests leave the id unmeasured: a join, so that
        no entry carries the whole list."""
        told = known.select("run_id", F.col("id").alias(column), F.lit(True).alias(mark))
        return entries.join(told, ["run_id", column], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))

    branches = exploded("branches").select("run_id", F.col("id").alias("branch_id"), "kind", "file", "line", F.col("column").alias("col"), F.explode("alternatives").alias("a")).select(
        "run_id", "branch_id", "kind", F.col("a.id").alias("id"), F.col("a.label").alias("label"), "file", "line", "col")
    return {
        "points": marked(exploded("points"), "id", "declined").select("run_id", "id", "kind", "file", "line", F.col("column").alias("col"), "source", "label", "declined"),
        "decisions": marked(exploded("decisions"), "id", "declined").select(
            "run_id", "id", "file", "line", F.col("column").alias("col"), "source", F.size("conditions").alias("conditions"), "declined"),
        "branches": marked(marked(branches, "id", "_own"), "branch_id", "_whole").select(
            "run_id", "branch_id", "kind", "id", "label", "file", "line", "col", (F.col("_own") | F.col("_whole")).alias("declined")),
        "limitations": exploded("limitations").select("run_id", "id", "kind", "file", "line", F.col("column").alias("col"), "source", "reason", "blocking",
                                                      F.coalesce("wholeFile", F.lit(False)).alias("whole_file")),
        "declined": listed,
        "scope_entries": manifests.select(F.col("runId").alias("run_id"), F.explode("scope.entries").alias("e")).select(
            "run_id", "e.file", "e.status", "e.reason", F.col("e.packageRoot").alias("package_root")),
    }


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata, read permissively: one document per file, ``corrupt`` its
    text where it does not parse."""
    schema = schemas.struct(**{f.name: f.dataType for f in schemas.RUN.fields}, corrupt=schemas.STRING)
    read = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(path)
    return read.withColumnsRenamed({"id": "run_id", "startedAt": "started_at"})


def decode_events(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Event columns as event rows.

    ``snapshots``: keys, ``hits`` (array) and ``events`` (struct of columns). Ragged
    columns, positions outside their table and vectors without an event fail the
    scan. Deltas add up in event order by a running total.
    """
    e = F.col("events")
    count = F.size(e["id"])
    ragged = F.array_max(F.array(*[F.abs(F.size(e[n]) - count) for n in ("type", "phase", "environment", "t")])) > 0
    stray = F.exists(F.map_keys(F.coalesce(e["vector"], F.create_map().cast("map<int,struct<values:array<boolean>,outcome:boolean>>"))), lambda k: (k < 0) | (k >= count))

    def entry(table, at, what: str):
        found = F.get(table, at)
        return F.coalesce(found, F.raise_error(F.lit(f"an event {what} outside its table")).cast("string"))

    checked = snapshots.withColumn(
        "_ok", F.when(ragged, F.raise_error(F.lit("event columns of different lengths")).cast("boolean"))
        .when(stray, F.raise_error(F.lit("an event vector without its event")).cast("boolean")).otherwise(True))
    rows = checked.filter("_ok").select(
        *keys, "hits", e["types"].alias("_types"), e["phases"].alias("_phases"), e["environments"].alias("_envs"), e["vector"].alias("_vectors"),
        F.posexplode(F.arrays_zip(*[e[n].alias(n) for n in ("id", "type", "phase", "environment", "t")])).alias("pos", "x"))
    position = F.col("x.id").try_cast("int")
    flat = rows.select(
        *keys, "pos", entry(F.col("_types"), F.col("x.type"), "type").alias("type"),
        F.when(position.isNotNull(), entry(F.col("hits"), position, "hit")).otherwise(F.col("x.id")).alias("id"),
        F.when(F.col("x.phase") != -1, entry(F.col("_phases"), F.col("x.phase"), "phase")).alias("phase_id"),
        entry(F.col("_envs"), F.col("x.environment"), "environment").alias("environment"),
        F.try_element_at("_vectors", F.col("pos")).alias("vector"), F.col("x.t").alias("_t"))
    return ordered.running_total(flat, keys, "pos", "_t", "timestamp_ms").drop("_t")
