"""The query log and its rollups as the problems of this folder count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources.tables import table


def query_key() -> Column:
    """What makes deliveries one query; a row without query_id stands for itself."""
    return F.coalesce(F.col("query_id"), F.concat(F.lit("#"), F.col("id").cast("string")))


def counted(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per query (deliveries of one query_id agree in all else) with the given columns and a timestamp."""
    log = table(spark, folder, "query_log").where("timestamp is not null")
    return log.select(query_key().alias("query_key"), "timestamp", *columns).distinct()


def current_stats(spark: SparkSession, folder: str, *figures: str) -> DataFrame:
    """(stat_name, database_id, bucket_type, time_bucket, stored): figures of the row updated last per bucket."""
    keys = ["database_id", "bucket_type", "time_bucket"]
    row = F.struct("updated_at", "id", *figures)
    last = table(spark, folder, "query_stats").groupBy(*keys).agg(F.max(row).alias("r"))
    each = F.array(*[F.struct(F.lit(f).alias("stat_name"), F.col(f"r.{f}").cast("double").alias("stored")) for f in figures])
    return last.select(*keys, F.inline(each)).where("stored is not null")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(stat_name, database_id, bucket_type, time_bucket, stored) of performance_metrics, repeated rows once."""
    own = table(spark, folder, "performance_metrics")
    return own.select(F.col("metric_name").alias("stat_name"), "database_id", "bucket_type", "time_bucket", F.col("metric_value").alias("stored")).where("stored is not null").distinct()
