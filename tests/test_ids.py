"""Ids of stays and admissions stay apart however many an entity has."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from workload.base import Tables


def test_an_entity_with_over_100000_stays(spark, tmp_path):
    many = spark.range(100_001).select(
        F.col("id").alias("event_id"),
        F.lit(1).cast("bigint").alias("user_id"),
        F.timestamp_seconds(F.col("id") * 13 * 3600).alias("ts"),
        F.when(F.col("id") == 100_000, "error").otherwise("view").alias("event_type"),
        F.lit(1.0).alias("value"),
    )
    other = spark.range(1).select(
        F.lit(100_001).cast("bigint").alias("event_id"),
        F.lit(2).cast("bigint").alias("user_id"),
        F.timestamp_seconds(F.lit(0)).alias("ts"),
        F.lit("click").alias("event_type"),
        F.lit(1.0).alias("value"),
    )
    many.unionByName(other).write.parquet(str(tmp_path / "events.parquet"))
    stays = Tables(spark, str(tmp_path)).fx_stays
    assert stays.count() == stays.select("stay_id").distinct().count() == 100_002
    left = entry_point.queries()["anti_excluded_unit"](spark, str(tmp_path))
    assert left.count() == 100_001 and left.filter("entity_id = 2").count() == 1
