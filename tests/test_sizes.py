"""What the optimizer is told of tables written out and read back."""

from pyspark.sql import functions as F

from attestry.plans.model import Model
from attestry.session import landed


def test_tables_that_compress_well_are_not_broadcast(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
    try:
        Model(spark, str(tmp_path))
        path = F.concat(F.lit("src/a/folder/of/some/length/"), (F.col("id") % 7).cast("string"))
        tall = landed(spark.range(400_000).select("id", path.alias("path")))
        plan = tall.join(tall.withColumnRenamed("path", "other"), "id")._jdf.queryExecution().sparkPlan().toString()
        small = tall.join(landed(spark.range(100)), "id")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", before)
    assert "Broadcast" not in plan and "Broadcast" in small
