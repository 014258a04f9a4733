"""The query log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive; the trigger's file limit is the back-pressure, nothing is dropped."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(log: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a table; a batch that is run again after a failure writes the same files once."""
    return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).outputMode("append").start()


def deduplicated(log: DataFrame, watermark: str = "3 days") -> DataFrame:
    """One row per query_id, for deliveries that come within the watermark of each other."""
    return log.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["query_id"])


def hourly(log: DataFrame, watermark: str = "3 days") -> DataFrame:
    """Per database and hour: counts, errors, mean and approximate percentiles of the time."""
    timed = log.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", watermark)
    ms = F.col("total_time_ms")
    return timed.groupBy("database_id", F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(F.coalesce("has_error", F.lit(False))).alias("failed_queries"),
        F.avg(ms).alias("avg_latency_ms"), F.percentile_approx(ms, F.lit(0.95), F.lit(1000)).alias("p95_latency_ms"),
    ).select("database_id", F.unix_millis("w.start").alias("time_bucket"), "total_queries", "failed_queries", "avg_latency_ms", "p95_latency_ms")


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that is there. Each batch adds the rows it changed under its number (a batch that is run again
    replaces its own); groups older than the watermark leave the state, and later rows for them are dropped."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()
    q.awaitTermination()


def current(spark: SparkSession, out: str, keys: tuple[str, ...] = ("database_id", "time_bucket")) -> DataFrame:
    """The last state of each group."""
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")
