"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestry.plans.catalog import query
from attestry.plans.model import VIEWS, Model, spark_dialect
from attestry.plans.timing_queries import O_OWNED
from attestry.session import shared_folder
from attestry.streaming import ingest


def scratch(m: Model) -> str:
    return f"{shared_folder(m.spark)}/stream-{uuid.uuid4().hex}"


def streamed(m: Model, table: str):
    """A given table as a file stream."""
    path = f"{m.sf_dir}/{table}.parquet"
    return m.spark.readStream.schema(m.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path[:-1] + "[t]")


@query("stream_ingest", "SELECT DISTINCT user_id, event_type, event_id // 2 AS pair FROM events")
def stream_ingest(m: Model):
    place = scratch(m)
    records = streamed(m, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 2).alias("pair"), F.col("ts").cast("timestamp").alias("at"))
    ingest.ingest(records, ["user_id", "event_type", "pair"], f"{place}/table", f"{place}/offsets", late="3650 days").awaitTermination()
    return m.spark.read.parquet(f"{place}/table").drop("at")


@query("stream_live_counters", """
  SELECT p.run_id, count(DISTINCT (p.file, p.line)) AS lines, count(DISTINCT p.id) FILTER (kind = 'statement') AS statements
  FROM points p JOIN hits h ON h.run_id = p.run_id AND h.hit_id = p.id WHERE NOT declined GROUP BY p.run_id""")
def stream_live_counters(m: Model):
    place = scratch(m)
    records = m.spark.sql(spark_dialect(VIEWS["line_records"]).replace("FROM lineitem", "FROM {lineitem}"), lineitem=streamed(m, "lineitem"))
    hits = m.spark.sql(spark_dialect(VIEWS["hits"]).replace("FROM line_records", "FROM {line_records}"), line_records=records)
    ingest.first_hits(hits, f"{place}/table", f"{place}/offsets").awaitTermination()
    return ingest.live_counts(m.spark, f"{place}/table", m.points)


@query("stream_credit_by_time", f"WITH {O_OWNED} SELECT run_id, record_id, running AS owner_count, CASE WHEN running = 1 THEN one END AS owner FROM owned")
def stream_credit_by_time(m: Model):
    place = scratch(m)
    times = m.spark.sql(spark_dialect(VIEWS["event_times"]).replace("FROM events", "FROM {events}"), events=streamed(m, "events"))
    records = m.spark.sql(spark_dialect(VIEWS["background"]).replace("FROM event_times", "FROM {event_times}"), event_times=times)
    ingest.collect_records(records, f"{place}/table", f"{place}/offsets").awaitTermination()
    return ingest.credit_closed(m.spark, f"{place}/table", m.windows, m.served, None).select("run_id", "record_id", "owner_count", "owner")
