"""Live counters: batches, restarts, repeats."""

from attestry.streaming import ingest


def test_first_hits_across_batches_and_a_restart(spark, tmp_path):
    source, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/offsets"
    shape = "run_id string, hit_id string, at timestamp"

    def add(*rows):
        spark.createDataFrame([(*r, None) for r in rows], shape).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest.first_hits(stream, table, checkpoint)
        query.awaitTermination()
        return query.recentProgress

    points = spark.createDataFrame([("r", "a", "f", 1, "statement", False), ("r", "b", "f", 1, "function", False), ("r", "c", "f", 2, "statement", True), ("s", "a", "f", 1, "statement", False)],
                                   "run_id string, id string, file string, line int, kind string, declined boolean")
    add(("r", "a"), ("r", "a"), ("r", "x"))
    add(("r", "a"), ("r", "b"))
    run()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("r", "a"), ("r", "b"), ("r", "x")]
    assert [tuple(x) for x in ingest.live_counts(spark, table, points).collect()] == [("r", 1, 1)]
    # A new query goes on from the checkpoint: only the new file is read, and what was seen is known.
    add(("r", "b"), ("s", "a"), ("r", "c"))
    progress = run()
    assert sum(p.numInputRows for p in progress) == 3
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("r", "a"), ("r", "b"), ("r", "c"), ("r", "x"), ("s", "a")]
    assert sorted(map(tuple, ingest.live_counts(spark, table, points).collect())) == [("r", 1, 1), ("s", 1, 1)]
