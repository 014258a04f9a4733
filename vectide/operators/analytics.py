"""Query-log analytics: time buckets, patterns, slow and empty results, trends, forecasts.

Log columns: database_id, query_text, query_type, retrieval_time_ms, total_time_ms, num_results, avg_similarity_score,
user_id, session_id, timestamp (ms), has_error. Null measures are left out of averages and percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.text import normalize_query
from vectide.functions.timebuckets import floor_bucket

HOUR, DAY = 3_600_000, 86_400_000
WIDTHS = {"hourly": HOUR, "daily": DAY, "weekly": 7 * DAY, "monthly": 30 * DAY}
TYPES = ("vector", "hybrid", "bm25")


def failed() -> Column:
    return F.coalesce("has_error", F.lit(False))


def statistics(log: DataFrame, granularity: str) -> DataFrame:
    """One row per database and bucket. Buckets count from 1970; percentiles are exact with linear interpolation.

    unique_* are per bucket, *_in_range over all of the database's rows. Failed queries count as zero-result here.
    """
    rows = log.where("timestamp is not null").withColumn("time_bucket", floor_bucket(F.col("timestamp"), WIDTHS[granularity]))
    ms = F.col("total_time_ms")
    ok = ~failed()
    by_type = [F.count_if(F.col("query_type") == t).alias(f"{t}_queries") for t in TYPES]
    keys = ["database_id", "time_bucket"]
    # distinct counts and percentiles come from separate aggregations of the same rows, joined on the few buckets
    plain = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(ok).alias("successful_queries"), F.count_if(failed()).alias("failed_queries"),
        F.count_if(F.coalesce("num_results", F.lit(0)) == 0).alias("zero_result_queries"), F.round(F.avg("num_results"), 9).alias("avg_results"),
        F.round(F.avg("avg_similarity_score"), 9).alias("avg_score"), F.round(F.avg(ms), 9).alias("avg_latency_ms"),
        *[F.round(F.percentile(ms, F.lit(p)), 4).alias(f"p{int(100 * p)}_latency_ms") for p in (0.5, 0.95, 0.99)], F.max(ms).alias("max_latency_ms"), *by_type,
        F.count_if(F.coalesce("used_reranking", F.lit(False))).alias("reranked_queries"),
    )
    unique = rows.groupBy(*keys).agg(F.count_distinct("user_id").alias("unique_users"), F.count_distinct("session_id").alias("unique_sessions"))
    in_range = rows.groupBy("database_id").agg(F.count_distinct("user_id").alias("users_in_range"), F.count_distinct("session_id").alias("sessions_in_range"))
    return plain.join(unique, keys).join(in_range, "database_id")


def patterns(log: DataFrame, min_count: int = 2, limit: int | None = 100) -> DataFrame:
    """Successful queries by normalised text."""
    rows = log.where(~failed()).withColumn("pattern", normalize_query(F.col("query_text"))).where("pattern <> ''")
    out = rows.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("total_time_ms"), 9).alias("avg_latency_ms"), F.round(F.avg("num_results"), 9).alias("avg_results"),
        F.round(F.avg("avg_similarity_score"), 9).alias("avg_score"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    ).where(F.col("n") >= min_count).orderBy(F.desc("n"), "pattern")
    return out.limit(limit) if limit else out


def slow(log: DataFrame, threshold_ms: int = 500, limit: int = 10) -> DataFrame:
    kept = log.where(F.col("total_time_ms") >= threshold_ms).select("id", "query_text", "total_time_ms", "num_results", "timestamp")
    return kept.orderBy(F.desc("total_time_ms"), "id").limit(limit)


def zero_results(log: DataFrame, min_count: int = 1, limit: int = 100) -> DataFrame:
    """Successful queries without results, by normalised text."""
    rows = log.where(~failed() & (F.col("num_results") == 0)).withColumn("pattern", normalize_query(F.col("query_text"))).where("pattern <> ''")
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_seen")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "pattern").limit(limit)


def trending(log: DataFrame, start: int, end: int, min_growth: float = 50.0, limit: int = 100) -> DataFrame:
    """Growth in percent over the preceding period of equal length, both half-open, counted in one pass; a new text
    has grown by 100."""
    before = start - (end - start)
    at = F.col("timestamp")
    rows = log.where(~failed() & (at >= before) & (at < end)).withColumn("pattern", normalize_query(F.col("query_text"))).where("pattern <> ''")
    both = rows.groupBy("pattern").agg(F.count_if(at >= start).alias("current"), F.count_if(at < start).alias("previous")).where("current > 0")
    growth = F.when(F.col("previous") == 0, F.lit(100.0)).otherwise((F.col("current") - F.col("previous")) * 100.0 / F.col("previous"))
    return both.withColumn("growth", F.round(growth, 4)).where(F.col("growth") >= min_growth).orderBy(F.desc("growth"), F.desc("current"), "pattern").limit(limit)


def insights(log: DataFrame, start: int, end: int) -> dict[str, DataFrame]:
    """The reports of a dashboard; `summary` is one row."""
    return {
        "patterns": patterns(log, 2, 10), "slow": slow(log, 500, 10), "zero_results": zero_results(log, 1, 10),
        "trending": trending(log, start, end, 50.0, 10), "summary": summary(log),
    }


def summary(log: DataFrame) -> DataFrame:
    """Success rate, mean and peak queries per second (of the busiest hour), and the hour of the day with most rows."""
    hours = log.where("timestamp is not null").groupBy(floor_bucket(F.col("timestamp"), HOUR).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~failed()).alias("ok"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    of_day = hours.groupBy((F.pmod("hour", F.lit(DAY)) / HOUR).cast("int").alias("h")).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("peak"))
    total = of_day.agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("peak").alias("peak"), F.max_by("h", F.struct("n", -F.col("h"))).alias("peak_hour"))
    return total.select("n", F.round(F.col("ok") / F.col("n"), 6).alias("success_rate"), F.round(F.col("n") * 1000 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)), 6).alias("qps_avg"), F.round(F.col("peak") / 3600, 6).alias("qps_peak"), "peak_hour")


def histogram(values: Column, bounds: list[float]) -> list[Column]:
    """Cumulative counts per upper bound, as one aggregate each."""
    return [F.count_if(values <= b).alias(f"le_{b:g}") for b in bounds] + [F.count(values).alias("le_inf"), F.sum(values).alias("total")]


def recent(log: DataFrame, n: int) -> DataFrame:
    """Averages over the last n rows of each database; a group limit in each task comes before the exchange."""
    last = Window.partitionBy("database_id").orderBy(F.desc("timestamp"), F.desc("id"))
    rows = log.where("timestamp is not null").select("database_id", "timestamp", "id", "total_time_ms", "num_results").withColumn("r", F.row_number().over(last)).where(F.col("r") <= n)
    return rows.groupBy("database_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_time_ms"), 9).alias("avg_ms"), F.round(F.avg("num_results"), 9).alias("avg_results"))


def exposition(metrics: DataFrame, name: str, labels: dict[str, str], value: str, kind: str = "gauge") -> DataFrame:
    """(name, line): a type line for each name and a line with labels and value (3 digits) for each row; sorted by name, with
    the type first, they are a text exposition. Rows without a value are left out."""
    rows = metrics.where(F.col(value).isNotNull())
    own = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), F.col(c).cast("string"), F.lit('"')) for label, c in labels.items()])
    lines = rows.select(F.col(name).alias("name"), F.concat(F.col(name), F.lit("{"), own, F.lit("} "), F.col(value).cast("decimal(18,3)").cast("string")).alias("line"))
    return rows.select(F.col(name).alias("name")).distinct().select("name", F.concat(F.lit("# TYPE "), F.col("name"), F.lit(f" {kind}")).alias("line")).unionByName(lines)


# Forecasts on an ordered series; a series is the points of one metric and database, some thousand at most


def linear_fit(points: DataFrame, group: str, x: str, y: str, ahead: float) -> DataFrame:
    """Slope, intercept and R² per group, the clamped forecast `ahead` after the last x, and its confidence."""
    fit = points.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.max(x).alias("last"))
    guess = F.least(F.greatest(F.col("intercept") + F.col("slope") * (F.col("last") + ahead), F.lit(0.0)), F.lit(100.0))
    level = F.when(F.col("r2") >= 0.8, "HIGH").when(F.col("r2") >= 0.5, "MEDIUM").otherwise("LOW")
    return fit.select(group, F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(guess, 6).alias("forecast"), level.alias("confidence"))


def smoothed(points: DataFrame, group: str, order: str, y: str, alpha: float = 0.3) -> DataFrame:
    """(group, level): s = alpha x + (1 - alpha) s along the order, from the first value on."""
    series = points.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(y).cast("double").alias("v")))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.element_at("s", 1)["v"], lambda a, p: alpha * p["v"] + (1 - alpha) * a)
    return series.select(group, fold.alias("level"))


def third_trend(points: DataFrame, group: str, order: str, y: str) -> DataFrame:
    """(group, trend): mean of the last third of the series minus that of the first."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    rows = points.withColumn("r", F.row_number().over(w.orderBy(order))).withColumn("third", F.greatest(F.floor(n / 3), F.lit(1))).withColumn("n", n)
    return rows.groupBy(group).agg((F.avg(F.when(F.col("r") > F.col("n") - F.col("third"), F.col(y))) - F.avg(F.when(F.col("r") <= F.col("third"), F.col(y)))).alias("trend"))


def scaling_advice(value: Column, target: float) -> Column:
    """Percent by which to change a resource."""
    ratio = value / target
    return F.when(ratio > 1.2, 25).when(ratio > 1.1, 15).when(ratio < 0.6, -20).when(ratio < 0.8, -10).otherwise(0)


def degradation_level(predicted: Column, current: Column) -> Column:
    ratio = predicted / F.greatest(F.lit(1.0), current)
    return F.when(ratio > 2, "CRITICAL").when(ratio > 1.5, "HIGH").when(ratio > 1.2, "MEDIUM").otherwise("LOW")


def capacity(current: Column, growth: Column) -> list[Column]:
    """needed: after a quarter of the growth (percent a year), where there is any; days: how long that difference lasts."""
    more = current * growth / 100 * 0.25
    daily = growth / 100 * current / 365
    needed = F.round(F.when(growth > 0, current + more).otherwise(current), 4)
    return [needed.alias("needed"), F.when((growth > 0) & (current > 0), F.floor(F.round(more / daily, 6)).cast("int")).alias("days")]


#: Forecasts by name: functions of (points, group, x, y, ahead) to (group, forecast).
FORECASTS: dict = {
    "linear": lambda points, group, x, y, ahead: linear_fit(points, group, x, y, ahead).select(group, "forecast"),
    "exponential": lambda points, group, x, y, ahead: smoothed(points, group, x, y).join(third_trend(points, group, x, y), group).select(group, F.round(F.col("level") + F.col("trend"), 6).alias("forecast")),
}


def register_forecast(name: str, strategy) -> None:
    FORECASTS[name] = strategy


def forecast(points: DataFrame, strategy: str, group: str, x: str, y: str, ahead: float) -> DataFrame:
    return FORECASTS[strategy](points, group, x, y, ahead)
