"""Scope of source files, and what a run's measurement leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as words
from attestry.functions.paths import folder_of


def holders(files: DataFrame, folders: DataFrame, name: str) -> DataFrame:
    """(checkout, file, depth, name): the folders of a checkout that a file is or lies below.

    A path is met with its own beginnings by equality, so the plan and the work of a file do not
    grow with the number of folders."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    bare = folders.select("checkout", name, F.regexp_replace(name, "/+$", "").alias("_above"))
    met = files.select("checkout", "file", F.explode(above).alias("_above")).join(bare, ["checkout", "_above"])
    return met.select("checkout", "file", (F.length("_above") - F.length(F.replace("_above", F.lit("/"), F.lit("")))).alias("depth"), name)


def classify(files: DataFrame, roots: DataFrame, packages: DataFrame, explicit: bool) -> DataFrame:
    """Each source file of each checkout as included, excluded or ambiguous, by the first rule
    that holds, with the nearest package above it.

    ``files``: checkout, file, text, skipped (reason of a skip convention or null), beside (reason it is
    beside the product, or null), measured; ``roots`` checkout and root; ``packages`` checkout and package."""
    path, key = F.col("file"), ["checkout", "file"]
    rooted = holders(files, roots, "root").select(*key).distinct().withColumn("_rooted", F.lit(True))
    nearest = holders(files, packages, "package").groupBy(*key).agg(F.max_by("package", F.struct("depth", "package")).alias("_package"))
    third = words.third_party(path, F.col("text"))
    by_place = ~F.coalesce("measured", F.lit(False))
    skipped = F.col("skipped").isNotNull() & (by_place | (F.col("skipped") != "test"))

    def ruled(status: str, reason):
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    rest = ruled("excluded", F.lit("outside explicit source roots")) if explicit else ruled("ambiguous", F.lit("unclassified first-party source"))
    rule = (
        F.when(skipped, ruled("excluded", F.col("skipped")))
        .when(F.col("beside").isNotNull() & by_place, ruled("excluded", F.col("beside")))
        .when(third.isNotNull(), ruled("excluded", third))
        .when(~by_place | F.coalesce("_rooted", F.lit(False)), ruled("included", F.lit("explicit source root" if explicit else "discovered package source root")))
        .otherwise(rest)
    )
    told = files.join(rooted, key, "left").join(nearest, key, "left").withColumn("_rule", rule)
    package = F.lit(None).cast("string") if explicit else F.col("_package")
    return told.select(*key, F.col("_rule.status").alias("status"), F.col("_rule.reason").alias("reason"), package.alias("package_root"))


def _directory(file):
    folder = folder_of(file)
    return F.when(folder == "", ".").otherwise(folder)


def groups(entries: DataFrame) -> DataFrame:
    """Files per status, directory and reason; ambiguous first, then most files."""
    rank = F.when(F.col("status") == "ambiguous", 0).when(F.col("status") == "included", 1).otherwise(2)
    return entries.groupBy(rank.alias("rank"), "status", _directory(F.col("file")).alias("directory"), "reason").agg(
        F.count(F.lit(1)).alias("files")).orderBy("rank", F.desc("files"), "directory", "reason")


def listed(entries: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "ambiguous", 0).when(F.col("status") == "included", 1).otherwise(2)
    return entries.withColumn("rank", rank).orderBy("rank", "file")


def unclassified(entries: DataFrame) -> DataFrame:
    """Ambiguous directories by files; a file at the top is its own root."""
    root = F.when(F.contains("file", F.lit("/")), _directory(F.col("file"))).otherwise(F.col("file"))
    return entries.filter("status = 'ambiguous'").groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "root")


def measurement(limitations: DataFrame, corrupt: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: limitations, blocking ones (corrupt records with them), declared
    boundaries, files touched, limitations per kind."""
    blocks = F.coalesce("blocking", F.lit(True))
    noted = limitations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("limitations"), F.count_if(blocks).alias("_blocking"), F.count_if(~blocks).alias("declared"),
        F.count_distinct("file").alias("_files"),
        *[F.count_if(F.col("kind") == kind).alias(kind.replace("-", "_")) for kind in ("dynamic-code", "semantic-safety", "source-scope")])
    joined = runs.select("run_id").join(noted, "run_id", "left").join(corrupt, "run_id", "left")
    n = lambda name: F.coalesce(name, F.lit(0))
    return joined.select(
        "run_id", n("limitations").alias("limitations"), (n("_blocking") + n("corrupt_records")).alias("blocking"), n("declared").alias("declared"),
        (n("_files") + n("corrupt_files")).alias("files"), *[n(k).alias(k) for k in ("dynamic_code", "semantic_safety", "source_scope")],
        n("corrupt_records").alias("corrupt_records"))


def transport_counts(traces: DataFrame) -> DataFrame:
    """Process, launch, workspace and guest events of each run's trace."""
    kinds = ["process", "child-launch", "remote-launch", "workspace-capability", "guest-process"]
    return traces.groupBy("run_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind.replace("-", "_")) for kind in kinds])


def diagnostics(facts: DataFrame) -> DataFrame:
    """Diagnostics of a run, one row each, and whether they block.

    ``facts``: run_id, empty_evidence_tests, corrupt_records, remote_launches,
    server_records (scoped, background, explicit and fallback together)."""
    codes = F.array_compact(F.array(
        F.when(F.col("empty_evidence_tests") > 0, F.struct(F.lit("TEST_EVIDENCE_MISSING").alias("code"), F.lit(False).alias("blocks"))),
        F.when(F.col("corrupt_records") > 0, F.struct(F.lit("CORRUPT_EVIDENCE_RECORDS").alias("code"), F.lit(True).alias("blocks"))),
        F.when((F.col("remote_launches") > 0) & (F.col("server_records") == 0), F.struct(
            F.lit("REMOTE_SERVER_EVIDENCE_MISSING").alias("code"), F.lit(True).alias("blocks"))),
    ))
    return facts.select("run_id", F.explode(codes).alias("d")).select("run_id", "d.code", "d.blocks")
