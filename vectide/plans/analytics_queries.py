"""Queries on the query log, metrics and forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectide.functions.text import NORMALISER_STOP_WORDS
from vectide.operators import analytics as A
from vectide.plans.registry import query
from vectide.sources.tables import table

NORM = """array_to_string(list_filter(string_split_regex(regexp_replace(lower(query_text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'),
  lambda x: x <> '' AND x NOT IN __STOP__), ' ')""".replace("__STOP__", "(" + ", ".join(f"'{w}'" for w in NORMALISER_STOP_WORDS) + ")")
L = f"""l AS (SELECT *, {NORM} AS pattern, "timestamp" AS ts, coalesce(has_error, false) AS bad FROM query_log)"""


def log(spark, d):
    return table(spark, d, "query_log")


def stats(name: str, width: int) -> None:
    @query(f"log_stats_{name}", f"""WITH {L}, b AS (SELECT *, ts // {width} * {width} AS time_bucket FROM l WHERE ts IS NOT NULL)
SELECT database_id, time_bucket, count(*) AS total_queries, count(*) FILTER (NOT bad) AS successful_queries, count(*) FILTER (bad) AS failed_queries, count(*) FILTER (coalesce(num_results, 0) = 0) AS zero_result_queries,
  round(avg(num_results), 9) AS avg_results, round(avg(avg_similarity_score), 9) AS avg_score, round(avg(total_time_ms), 9) AS avg_latency_ms, round(quantile_cont(total_time_ms, 0.5), 4) AS p50_latency_ms,
  round(quantile_cont(total_time_ms, 0.95), 4) AS p95_latency_ms, round(quantile_cont(total_time_ms, 0.99), 4) AS p99_latency_ms, max(total_time_ms) AS max_latency_ms,
  count(*) FILTER (query_type = 'vector') AS vector_queries, count(*) FILTER (query_type = 'hybrid') AS hybrid_queries, count(*) FILTER (query_type = 'bm25') AS bm25_queries, count(*) FILTER (used_reranking) AS reranked_queries,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, any_value(u) AS users_in_range, any_value(s) AS sessions_in_range
FROM b JOIN (SELECT database_id, count(DISTINCT user_id) AS u, count(DISTINCT session_id) AS s FROM b GROUP BY 1) USING (database_id) GROUP BY 1, 2""")
    def run(spark, d):
        return A.statistics(log(spark, d), name)


for _name, _width in A.WIDTHS.items():
    stats(_name, _width)


@query("percentiles", "SELECT query_type, round(quantile_cont(total_time_ms, 0.5), 4) AS p50, round(quantile_cont(total_time_ms, 0.95), 4) AS p95, round(quantile_cont(total_time_ms, 0.99), 4) AS p99 FROM query_log GROUP BY 1")
def percentiles(spark, d):
    return log(spark, d).groupBy("query_type").agg(*[F.round(F.percentile("total_time_ms", F.lit(p)), 4).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)])


@query("percentile_index", "SELECT query_type, list_sort(list(total_time_ms) FILTER (total_time_ms IS NOT NULL))[least(floor(count(total_time_ms) * 0.95), count(total_time_ms) - 1)::BIGINT + 1] AS p95 FROM query_log GROUP BY 1")
def percentile_index(spark, d):
    """The value at floor(n p) of the sorted values: found from counts of equal values, so that no task holds a group."""
    counts = log(spark, d).where("total_time_ms is not null").groupBy("query_type", "total_time_ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("query_type")
    running = counts.withColumn("upto", F.sum("c").over(w.orderBy("total_time_ms"))).withColumn("n", F.sum("c").over(w))
    return running.where(F.col("upto") > F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).groupBy("query_type").agg(F.min("total_time_ms").alias("p95"))


@query("search_patterns", f"""WITH {L} SELECT pattern, count(*) AS n, round(avg(total_time_ms), 9) AS avg_latency_ms, round(avg(num_results), 9) AS avg_results, round(avg(avg_similarity_score), 9) AS avg_score, min(ts) AS first_seen, max(ts) AS last_seen
FROM l WHERE NOT bad AND pattern <> '' GROUP BY pattern HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 100""")
def search_patterns(spark, d):
    return A.patterns(log(spark, d), 2, 100)


@query("slow_queries", 'SELECT id, query_text, total_time_ms, num_results, "timestamp" FROM query_log WHERE total_time_ms >= 500 ORDER BY total_time_ms DESC, id LIMIT 10')
def slow_queries(spark, d):
    return A.slow(log(spark, d))


@query("zero_results", f"WITH {L} SELECT pattern, count(*) AS n, max(ts) AS last_seen FROM l WHERE NOT bad AND num_results = 0 AND pattern <> '' GROUP BY 1 ORDER BY n DESC, pattern LIMIT 100")
def zero_results(spark, d):
    return A.zero_results(log(spark, d))


T0, T1 = 1515024000000, 1515283200000


@query("trending", f"""WITH {L}, g AS (SELECT pattern, count(*) FILTER (ts >= {T0}) AS current, count(*) FILTER (ts < {T0}) AS previous FROM l WHERE NOT bad AND pattern <> '' AND ts >= {2 * T0 - T1} AND ts < {T1} GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN previous = 0 THEN 100.0 ELSE round((current - previous) * 100.0 / previous, 4) END AS growth FROM g WHERE current > 0) WHERE growth >= 50 ORDER BY growth DESC, current DESC, pattern LIMIT 100""")
def trending(spark, d):
    return A.trending(log(spark, d), T0, T1)


@query("insights_summary", """WITH h AS (SELECT "timestamp" // 3600000 AS hour, count(*) AS n, count(*) FILTER (NOT coalesce(has_error, false)) AS ok, min("timestamp") AS lo, max("timestamp") AS hi FROM query_log WHERE "timestamp" IS NOT NULL GROUP BY 1),
o AS (SELECT hour % 24 AS h, sum(n) AS n FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(ok) / sum(n), 6) AS success_rate, round(sum(n) * 1000 / greatest(max(hi) - min(lo), 1), 6) AS qps_avg, round(max(n) / 3600, 6) AS qps_peak, (SELECT h::INT FROM o ORDER BY n DESC, h LIMIT 1) AS peak_hour FROM h""")
def insights_summary(spark, d):
    return A.insights(log(spark, d), T0, T1)["summary"]


def insight(part: str, sql: str) -> None:
    @query(f"insights_{part}", sql)
    def run(spark, d):
        return A.insights(log(spark, d), T0, T1)[part]


insight("patterns", f"""WITH {L} SELECT pattern, count(*) AS n, round(avg(total_time_ms), 9) AS avg_latency_ms, round(avg(num_results), 9) AS avg_results, round(avg(avg_similarity_score), 9) AS avg_score, min(ts) AS first_seen, max(ts) AS last_seen
FROM l WHERE NOT bad AND pattern <> '' GROUP BY pattern HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 10""")
insight("slow", 'SELECT id, query_text, total_time_ms, num_results, "timestamp" FROM query_log WHERE total_time_ms >= 500 ORDER BY total_time_ms DESC, id LIMIT 10')
insight("zero_results", f"WITH {L} SELECT pattern, count(*) AS n, max(ts) AS last_seen FROM l WHERE NOT bad AND num_results = 0 AND pattern <> '' GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
insight("trending", f"""WITH {L}, g AS (SELECT pattern, count(*) FILTER (ts >= {T0}) AS current, count(*) FILTER (ts < {T0}) AS previous FROM l WHERE NOT bad AND pattern <> '' AND ts >= {2 * T0 - T1} AND ts < {T1} GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN previous = 0 THEN 100.0 ELSE round((current - previous) * 100.0 / previous, 4) END AS growth FROM g WHERE current > 0) WHERE growth >= 50 ORDER BY growth DESC, current DESC, pattern LIMIT 10""")


@query("recent_statistics", """SELECT database_id, count(*) AS n, round(avg(total_time_ms), 9) AS avg_ms, round(avg(num_results), 9) AS avg_results FROM
  (SELECT * FROM query_log WHERE "timestamp" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY "timestamp" DESC, id DESC) <= 100) GROUP BY 1""")
def recent_statistics(spark, d):
    """Averages over the last hundred queries of each database."""
    return A.recent(log(spark, d), 100)


@query("score_stats", "SELECT query_type, round(avg(avg_similarity_score), 9) AS avg_score, min(min_similarity_score) AS min_score, max(max_similarity_score) AS max_score FROM query_log GROUP BY 1")
def score_stats(spark, d):
    return log(spark, d).groupBy("query_type").agg(F.round(F.avg("avg_similarity_score"), 9).alias("avg_score"), F.min("min_similarity_score").alias("min_score"), F.max("max_similarity_score").alias("max_score"))


@query("rag_analytics", "SELECT count(*) AS queries, round(avg(avg_similarity_score), 9) AS confidence, round(avg(total_time_ms), 9) AS avg_ms, round(avg(CASE WHEN has_error THEN 0.0 ELSE 1.0 END), 6) AS success_rate FROM query_log")
def rag_analytics(spark, d):
    ok = F.when(F.col("has_error"), 0.0).otherwise(1.0)
    return log(spark, d).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("avg_similarity_score"), 9).alias("confidence"), F.round(F.avg("total_time_ms"), 9).alias("avg_ms"), F.round(F.avg(ok), 6).alias("success_rate"))


@query("category_breakdown", "SELECT category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category")
def category_breakdown(spark, d):
    return table(spark, d, "documents").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query("doc_status_counts", "SELECT status, count(*) AS n, sum(CASE WHEN status = 'complete' THEN coalesce(chunk_count, 0) ELSE 0 END)::BIGINT AS chunks FROM documents GROUP BY 1")
def doc_status_counts(spark, d):
    chunks = F.sum(F.when(F.col("status") == "complete", F.coalesce("chunk_count", F.lit(0))).otherwise(0))
    return table(spark, d, "documents").groupBy("status").agg(F.count(F.lit(1)).alias("n"), chunks.alias("chunks"))


BOUNDS = [10, 50, 100, 200, 500, 1000]


@query("histogram", "SELECT query_type, " + ", ".join(f"count(*) FILTER (total_time_ms <= {b}) AS le_{b}" for b in BOUNDS) + ", count(total_time_ms) AS le_inf, sum(total_time_ms)::BIGINT AS total FROM query_log GROUP BY 1")
def histogram(spark, d):
    return log(spark, d).groupBy("query_type").agg(*A.histogram(F.col("total_time_ms"), BOUNDS))


@query("metrics_query", """SELECT database_id, metric_name, bucket_type, count(*) AS n, max(metric_value) AS most FROM (SELECT DISTINCT * FROM performance_metrics) WHERE metric_type = 'latency' AND metric_name LIKE 'retrieval%' AND time_bucket >= 1514851200000 GROUP BY ALL""")
def metrics_query(spark, d):
    """Samples by type, name prefix and history window."""
    m = table(spark, d, "performance_metrics").distinct()
    kept = m.where((F.col("metric_type") == "latency") & F.col("metric_name").startswith("retrieval") & (F.col("time_bucket") >= 1514851200000))
    return kept.groupBy("database_id", "metric_name", "bucket_type").agg(F.count(F.lit(1)).alias("n"), F.max("metric_value").alias("most"))


@query("metrics_export", """WITH m AS (SELECT DISTINCT * FROM performance_metrics WHERE metric_value IS NOT NULL)
SELECT DISTINCT metric_name AS name, '# TYPE ' || metric_name || ' gauge' AS line FROM m
UNION ALL SELECT metric_name, metric_name || '{bucket="' || bucket_type || '",database="' || database_id || '",start="' || time_bucket || '"} ' || CAST(CAST(metric_value AS DECIMAL(18, 3)) AS VARCHAR) FROM m""")
def metrics_export(spark, d):
    """Lines of a text exposition."""
    return A.exposition(table(spark, d, "performance_metrics").distinct(), "metric_name", {"bucket": "bucket_type", "database": "database_id", "start": "time_bucket"}, "metric_value")


@query("analytics_export", f"""WITH {L}, p AS (SELECT pattern, count(*) AS n FROM l WHERE NOT bad AND pattern <> '' GROUP BY 1 HAVING count(*) >= 2)
SELECT 'pattern' AS type, pattern AS data, n AS "count", '' AS metric, NULL::DOUBLE AS value FROM p UNION ALL SELECT 'latency', query_type, count(*), 'avg_ms', round(avg(total_time_ms), 9) FROM query_log GROUP BY query_type""")
def analytics_export(spark, d):
    """Reports of different kinds as one table for CSV."""
    p = A.patterns(log(spark, d), 2, None).select(F.lit("pattern").alias("type"), F.col("pattern").alias("data"), F.col("n").alias("count"), F.lit("").alias("metric"), F.lit(None).cast("double").alias("value"))
    t = log(spark, d).groupBy("query_type").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("total_time_ms"), 9).alias("value"))
    return p.unionByName(t.select(F.lit("latency").alias("type"), F.col("query_type").alias("data"), "count", F.lit("avg_ms").alias("metric"), "value"))


@query("log_list", 'SELECT id, database_id, query_text, "timestamp" FROM query_log WHERE database_id = \'kb_support_main\' AND query_type = \'hybrid\' ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 100')
def log_list(spark, d):
    """A filtered page of the log, newest first."""
    kept = log(spark, d).where("database_id = 'kb_support_main' and query_type = 'hybrid'").select("id", "database_id", "query_text", "timestamp")
    return kept.orderBy(F.desc("timestamp"), F.desc("id")).offset(100).limit(50)


# Forecasts

SERIES = "s AS (SELECT database_id, (time_bucket - 1514764800000) / 3600000.0 AS x, max(metric_value) / 10 AS y FROM performance_metrics WHERE metric_name = 'retrieval_p50_ms' AND bucket_type = 'daily' AND metric_value IS NOT NULL GROUP BY 1, 2)"


def series(spark, d):
    """One daily metric per database: hours since the start, and its value."""
    m = table(spark, d, "performance_metrics").where("metric_name = 'retrieval_p50_ms' and bucket_type = 'daily' and metric_value is not null")
    return m.groupBy("database_id", ((F.col("time_bucket") - 1514764800000) / 3600000.0).alias("x")).agg((F.max("metric_value") / 10).alias("y"))


FIT = f"WITH {SERIES}, f AS (SELECT database_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, max(x) AS last, count(*) AS n, arg_max(y, x) AS newest, arg_min(y, x) AS oldest FROM s GROUP BY 1)"


@query("linear_forecast", f"""{FIT} SELECT database_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(least(greatest(intercept + slope * (last + 24), 0), 100), 6) AS forecast,
  CASE WHEN r2 >= 0.8 THEN 'HIGH' WHEN r2 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM f WHERE n >= 3""")
def linear_forecast(spark, d):
    rows = series(spark, d)
    enough = rows.groupBy("database_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("database_id")
    return A.linear_fit(rows.join(enough, "database_id", "left_semi"), "database_id", "x", "y", 24.0)


SMOOTH = f"""{SERIES}, o AS (SELECT database_id, y, x, row_number() OVER (PARTITION BY database_id ORDER BY x) AS r, count(*) OVER (PARTITION BY database_id) AS n FROM s),
rec AS (SELECT database_id, r, y AS level FROM o WHERE r = 1 UNION ALL SELECT o.database_id, o.r, 0.3 * o.y + 0.7 * rec.level FROM rec JOIN o ON o.database_id = rec.database_id AND o.r = rec.r + 1),
sm AS (SELECT database_id, arg_max(level, r) AS level FROM rec GROUP BY 1),
tr AS (SELECT database_id, avg(y) FILTER (r > n - greatest(n // 3, 1)) - avg(y) FILTER (r <= greatest(n // 3, 1)) AS trend, stddev_pop(y) AS sd FROM o GROUP BY 1)"""


@query("exp_smoothing", f"WITH RECURSIVE {SMOOTH} SELECT database_id, round(level, 6) AS level FROM sm")
def exp_smoothing(spark, d):
    return A.smoothed(series(spark, d), "database_id", "x", "y").select("database_id", F.round("level", 6).alias("level"))


@query("third_trend", f"WITH RECURSIVE {SMOOTH} SELECT database_id, round(trend, 6) AS trend FROM tr")
def third_trend(spark, d):
    return A.third_trend(series(spark, d), "database_id", "x", "y").select("database_id", F.round("trend", 6).alias("trend"))


@query("exp_forecast", f"WITH RECURSIVE {SMOOTH} SELECT database_id, round(level + trend, 6) AS forecast, CASE WHEN sd < 5 THEN 'HIGH' WHEN sd < 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sm JOIN tr USING (database_id)")
def exp_forecast(spark, d):
    rows = series(spark, d)
    sd = rows.groupBy("database_id").agg(F.stddev_pop("y").alias("sd"))
    both = A.smoothed(rows, "database_id", "x", "y").join(A.third_trend(rows, "database_id", "x", "y"), "database_id").join(sd, "database_id")
    level = F.when(F.col("sd") < 5, "HIGH").when(F.col("sd") < 15, "MEDIUM").otherwise("LOW")
    return both.select("database_id", F.round(F.col("level") + F.col("trend"), 6).alias("forecast"), level.alias("confidence"))


def fitted(spark, d):
    return series(spark, d).groupBy("database_id").agg(F.regr_slope("y", "x").alias("slope"), F.max_by("y", "x").alias("newest"), F.min_by("y", "x").alias("oldest"), F.max("x").alias("last"))


@query("exhaustion", f"{FIT} SELECT database_id, round((100 - newest) / slope, 4) AS hours FROM f WHERE slope > 0 AND newest < 100")
def exhaustion(spark, d):
    """Hours until the value reaches 100 at its present rate."""
    return fitted(spark, d).where("slope > 0 and newest < 100").select("database_id", F.round((100 - F.col("newest")) / F.col("slope"), 4).alias("hours"))


@query("scaling_advice", f"{FIT} SELECT database_id, CASE WHEN newest / 12 > 1.2 THEN 25 WHEN newest / 12 > 1.1 THEN 15 WHEN newest / 12 < 0.6 THEN -20 WHEN newest / 12 < 0.8 THEN -10 ELSE 0 END AS change FROM f")
def scaling_advice(spark, d):
    return fitted(spark, d).select("database_id", A.scaling_advice(F.col("newest"), 12.0).alias("change"))


@query("capacity", f"""{FIT}, g AS (SELECT database_id, newest AS c, (newest - oldest) / oldest * 100 AS growth FROM f WHERE oldest > 0) SELECT database_id, round(CASE WHEN growth > 0 THEN c + c * growth / 100 * 0.25 ELSE c END, 4) AS needed,
  CASE WHEN growth > 0 AND c > 0 THEN trunc(round((c * growth / 100 * 0.25) / (growth / 100 * c / 365), 6))::INT END AS days FROM g""")
def capacity(spark, d):
    """What a quarter more of the present growth needs, and the days that the difference lasts."""
    g = fitted(spark, d).where("oldest > 0").select("database_id", F.col("newest").alias("c"), ((F.col("newest") - F.col("oldest")) / F.col("oldest") * 100).alias("growth"))
    return g.select("database_id", *A.capacity(F.col("c"), F.col("growth")))


@query("degradation", f"""{FIT} SELECT database_id, CASE WHEN p / greatest(1, newest) > 2 THEN 'CRITICAL' WHEN p / greatest(1, newest) > 1.5 THEN 'HIGH' WHEN p / greatest(1, newest) > 1.2 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN slope > 0 THEN round(newest / slope, 4) END AS hours_to_double FROM (SELECT *, newest + slope * 168 AS p FROM f WHERE slope IS NOT NULL)""")
def degradation(spark, d):
    rows = fitted(spark, d).where("slope is not null")
    level = A.degradation_level(F.col("newest") + F.col("slope") * 168, F.col("newest"))
    return rows.select("database_id", level.alias("level"), F.when(F.col("slope") > 0, F.round(F.col("newest") / F.col("slope"), 4)).alias("hours_to_double"))


@query("heatmap", """SELECT h, coalesce(sum(n) FILTER (wd = 0), 0)::BIGINT AS d0, coalesce(sum(n) FILTER (wd = 1), 0)::BIGINT AS d1, coalesce(sum(n) FILTER (wd = 2), 0)::BIGINT AS d2, coalesce(sum(n) FILTER (wd = 3), 0)::BIGINT AS d3,
  coalesce(sum(n) FILTER (wd = 4), 0)::BIGINT AS d4, coalesce(sum(n) FILTER (wd = 5), 0)::BIGINT AS d5, coalesce(sum(n) FILTER (wd = 6), 0)::BIGINT AS d6
FROM (SELECT "timestamp" // 3600000 % 24 AS h, ("timestamp" // 86400000 + 3) % 7 AS wd, count(*) AS n FROM query_log WHERE "timestamp" IS NOT NULL GROUP BY ALL) GROUP BY h""")
def heatmap(spark, d):
    """Queries by hour of the day and day of the week, Monday first."""
    at = F.col("timestamp")
    day = F.pmod(F.floor(at / A.DAY) + 3, F.lit(7))
    return log(spark, d).where("timestamp is not null").groupBy(F.floor(F.pmod(at, F.lit(A.DAY)) / A.HOUR).alias("h")).agg(*[F.count_if(day == i).alias(f"d{i}") for i in range(7)])


@query("alerts", """WITH r(metric_name, severity, bound) AS (VALUES ('retrieval_p95_ms', 'warning', 400.0), ('retrieval_p95_ms', 'critical', 800.0), ('p95_latency_ms', 'warning', 500.0))
SELECT DISTINCT m.database_id, m.metric_name, m.bucket_type, m.time_bucket, r.severity FROM performance_metrics m JOIN r ON m.metric_name = r.metric_name AND m.metric_value > r.bound""")
def alerts(spark, d):
    rules = spark.createDataFrame([("retrieval_p95_ms", "warning", 400.0), ("retrieval_p95_ms", "critical", 800.0), ("p95_latency_ms", "warning", 500.0)], "metric_name string, severity string, bound double")
    m = table(spark, d, "performance_metrics")
    # three rules
    return m.join(F.broadcast(rules), "metric_name").where("metric_value > bound").select("database_id", "metric_name", "bucket_type", "time_bucket", "severity").distinct()


@query("own_forecast", f"WITH {SERIES} SELECT database_id, max(y) AS forecast FROM s GROUP BY 1")
def own_forecast(spark, d):
    """A forecast of one's own: the largest value so far."""
    A.register_forecast("largest", lambda points, group, x, y, ahead: points.groupBy(group).agg(F.max(y).alias("forecast")))
    return A.forecast(series(spark, d), "largest", "database_id", "x", "y", 24.0)
