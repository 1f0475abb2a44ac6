"""Session settings every entry point shares."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("attestry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Timestamps become epoch milliseconds in UTC whatever the driver set."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


#: Bytes of memory for a byte of Parquet, as far as the optimizer is told: ids and paths lie there in dictionaries.
COMPRESSION = "64.0"


def size_as_rows(spark: SparkSession) -> None:
    """Files count as what their rows take in memory. At their size on disk the optimizer broadcast tables
    that grow with the input through the driver."""
    if spark.conf.get("spark.sql.sources.fileCompressionFactor") != COMPRESSION:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", COMPRESSION)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it; a local one of
    our own only where it names none, as in tests."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("name a folder every executor sees in spark.checkpoint.dir")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """A table written once per application to the shared folder, then read.

    Reading Parquet back prunes columns and pushes filters, and a lost executor
    costs a re-read of its splits and no recomputation."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _stored:
        place = hashlib.sha256(scope.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark)}/attestry-{key[0]}/{place}/{name}"
        build().write.mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def landed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage, and all that was known of the
    plan, end there, so rounds may be joined and united with each other freely."""
    path = f"{shared_folder(df.sparkSession)}/attestry-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is
    set only where it is unset, which is the case in local tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
