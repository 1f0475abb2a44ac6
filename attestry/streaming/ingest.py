"""Evidence as it arrives: ingest, live counters, crediting of closed windows.

Each job's final answer equals a batch operator's. Sinks are keyed by batch, so
a replayed batch overwrites what it wrote and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry import schemas
from attestry.operators import timing


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Server records of journals as they are appended. A record without a time
    takes its file's."""
    read = spark.readStream.schema(schemas.SERVER_RECORD).option("mode", "PERMISSIVE").json(path)
    arrived = F.col("_metadata.file_modification_time")
    return read.withColumn("at", F.coalesce(F.timestamp_millis("timestampMs"), arrived))


def ingest(records: DataFrame, identity: list[str], target: str, checkpoint: str, late: str = "10 minutes", at: str = "at") -> StreamingQuery:
    """Append records to a table, equal ones within the watermark once."""
    kept = records.withWatermark(at, late).dropDuplicatesWithinWatermark(identity)
    return kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of batches, empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


FIRST_HITS = "run_id string, hit_id string"


def first_hits(hits: DataFrame, table: str, checkpoint: str, at: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Append the first sighting of every (run, hit).

    What was seen is kept as keyed state, so a batch looks up its own keys and never reads the table; the file
    sink writes each batch once, also when it is replayed after a restart. With an event time ``at`` a
    key's state goes ``late`` after its last sighting (and one seen later than that is written again, which
    counts of distinct hits do not mind)."""
    key = ["run_id", "hit_id"]
    once = hits.select(*key).dropDuplicates(key) if at is None else hits.select(*key, at).withWatermark(at, late).dropDuplicatesWithinWatermark(key).select(*key)
    return once.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def live_counts(spark: SparkSession, table: str, points: DataFrame) -> DataFrame:
    """Lines and statements covered so far per run, from the first-hit table."""
    seen = _written(spark, table, FIRST_HITS).select("run_id", F.col("hit_id").alias("id")).distinct()
    met = points.filter("not declined").join(seen, ["run_id", "id"])
    return met.groupBy("run_id").agg(F.count_distinct("file", "line").alias("lines"), F.count_if(F.col("kind") == "statement").alias("statements"))


RECORDS = "run_id string, record_id long, request long, timestamp_ms long, process string, hit_id string, batch long"


def collect_records(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Background records as they come, by batch, for crediting once their time is closed."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return records.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def credit_closed(spark: SparkSession, table: str, windows: DataFrame, served: DataFrame, closed_before_ms: int | None) -> DataFrame:
    """Owners of records whose time every window that could hold them has passed.

    A window still open may grow over a record, so a record is judged only once
    no test that started before it can still be running; None closes all."""
    records = _written(spark, table, RECORDS).drop("batch")
    if closed_before_ms is not None:
        records = records.filter(F.col("timestamp_ms").isNull() | (F.col("timestamp_ms") < closed_before_ms))
    return timing.owners_by_time(records, windows, served)
