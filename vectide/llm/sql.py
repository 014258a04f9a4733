"""The problems' queries in DuckDB's SQL, where SQL can express them."""

from vectide.functions.text import NORMALISER_STOP_WORDS

_COUNTED = """counted AS (SELECT coalesce(query_id, '#' || id) AS query_key, any_value(database_id) AS database_id,
  any_value(query_text) AS query_text, any_value(query_type) AS query_type, any_value(total_time_ms) AS total_time_ms,
  any_value(retrieval_time_ms) AS retrieval_time_ms, any_value(user_id) AS user_id, any_value(session_id) AS session_id,
  any_value("timestamp") AS ts FROM query_log WHERE "timestamp" IS NOT NULL GROUP BY 1),
dated AS (SELECT *, ts - ts % 86400000 AS d, ts - (ts + 259200000) % 604800000 AS w FROM counted),
bucketed AS (SELECT database_id AS db, 'daily' AS bucket_type, d AS time_bucket, * FROM dated
  UNION ALL SELECT database_id, 'weekly', w, * FROM dated UNION ALL SELECT 'all', 'daily', d, * FROM dated
  UNION ALL SELECT 'all', 'weekly', w, * FROM dated),
cur AS (SELECT * FROM query_stats QUALIFY row_number() OVER (PARTITION BY database_id, bucket_type, time_bucket ORDER BY updated_at DESC, id DESC) = 1),
pm AS (SELECT DISTINCT metric_name, database_id, bucket_type, time_bucket, metric_value FROM performance_metrics WHERE metric_value IS NOT NULL)"""

_NEAREST = "list_sort(list({c}) FILTER ({c} >= 0))[greatest(ceil({p} * count(*) FILTER ({c} >= 0) - 1e-9), 1)::BIGINT]"

_STOP = "(" + ", ".join(f"'{w}'" for w in NORMALISER_STOP_WORDS) + ")"

_FREQUENT = f"""WITH {_COUNTED},
texts AS (SELECT 'log' AS scope, w AS time_bucket, array_to_string(list_filter(string_split_regex(regexp_replace(lower(query_text), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'),
   lambda x: x <> '' AND x NOT IN {_STOP}), ' ') AS normalized_text, 1 AS wt FROM dated WHERE query_text IS NOT NULL),
patterns AS (SELECT 'patterns' AS scope, w AS time_bucket, normalized_text, query_count AS wt FROM
  (SELECT *, first_seen - (first_seen + 259200000) % 604800000 AS w FROM search_patterns WHERE first_seen IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY database_id, normalized_text, w ORDER BY updated_at DESC, id DESC) = 1),
al AS (SELECT * FROM texts WHERE normalized_text <> '' UNION ALL SELECT * FROM patterns WHERE normalized_text IS NOT NULL AND wt > 0),
sums AS (SELECT scope, time_bucket, normalized_text, sum(wt)::BIGINT AS weight FROM al GROUP BY ALL),
tot AS (SELECT *, (sum(weight) OVER (PARTITION BY scope, time_bucket))::BIGINT AS total FROM sums)"""

SQL = {
    "p1_found": """WITH ok AS (SELECT id, "values"::DOUBLE[] AS v FROM (
  SELECT id, any_value("values") AS "values" FROM products GROUP BY id
  UNION ALL SELECT id, "values" FROM (SELECT * FROM arrow_utils QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE NOT deleted)
  WHERE len("values") = 64 AND len(list_filter("values", lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter("values", lambda x: x <> 0)) > 0),
sims AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM ok a JOIN ok b ON a.id <> b.id),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM top WHERE s >= 0.85""",
    "p2_found": f"""WITH {_COUNTED},
figures AS (SELECT db, bucket_type, time_bucket, {_NEAREST.format(c="total_time_ms", p=0.95)} AS p95_latency_ms,
  {_NEAREST.format(c="retrieval_time_ms", p=0.5)} AS retrieval_p50_ms, {_NEAREST.format(c="retrieval_time_ms", p=0.95)} AS retrieval_p95_ms
  FROM bucketed GROUP BY ALL HAVING count(*) >= 60),
truth AS (UNPIVOT figures ON p95_latency_ms, retrieval_p50_ms, retrieval_p95_ms INTO NAME stat_name VALUE v),
stored AS (SELECT 'p95_latency_ms' AS stat_name, database_id, bucket_type, time_bucket, p95_latency_ms AS s FROM cur
  UNION ALL SELECT metric_name, database_id, bucket_type, time_bucket, metric_value FROM pm
  WHERE metric_name IN ('retrieval_p50_ms', 'retrieval_p95_ms') OR metric_name = 'p95_latency_ms' AND database_id = 'all')
SELECT DISTINCT s.stat_name, s.database_id, s.bucket_type, s.time_bucket FROM stored s JOIN truth t
  ON s.stat_name = t.stat_name AND s.database_id = t.db AND s.bucket_type = t.bucket_type AND s.time_bucket = t.time_bucket
WHERE abs(s.s - t.v) > 0.2 * t.v""",
    "p3_found": f"{_FREQUENT} SELECT scope, time_bucket, normalized_text FROM tot WHERE weight >= 0.005 * total",
    "p4_found": f"""WITH {_COUNTED},
clean AS (SELECT db, bucket_type, time_bucket, query_type,
  CASE WHEN lower(trim(user_id)) NOT IN ('', 'anonymous') THEN lower(trim(user_id)) END AS u,
  CASE WHEN lower(trim(session_id)) NOT IN ('', 'anonymous') THEN lower(trim(session_id)) END AS s FROM bucketed),
truth AS (SELECT 'unique_users' AS stat_name, db, bucket_type, time_bucket, count(DISTINCT u) AS v, count(*) AS n FROM clean GROUP BY ALL
  UNION ALL SELECT 'unique_sessions', db, bucket_type, time_bucket, count(DISTINCT s), count(*) FROM clean GROUP BY ALL
  UNION ALL SELECT 'unique_users_' || query_type, db, bucket_type, time_bucket, count(DISTINCT u), count(*) FROM clean WHERE db = 'all' GROUP BY ALL),
stored AS (SELECT 'unique_users' AS stat_name, database_id, bucket_type, time_bucket, unique_users::DOUBLE AS s FROM cur
  UNION ALL SELECT 'unique_sessions', database_id, bucket_type, time_bucket, unique_sessions::DOUBLE FROM cur
  UNION ALL SELECT metric_name, database_id, bucket_type, time_bucket, metric_value FROM pm
  WHERE database_id = 'all' AND (metric_name = 'unique_sessions' OR metric_name LIKE 'unique_users%'))
SELECT DISTINCT s.stat_name, s.database_id, s.bucket_type, s.time_bucket FROM stored s JOIN truth t
  ON s.stat_name = t.stat_name AND s.database_id = t.db AND s.bucket_type = t.bucket_type AND s.time_bucket = t.time_bucket
WHERE t.n >= 60 AND abs(s.s - t.v) > 0.15 * t.v""",
    "p4_distinct": f"""WITH {_COUNTED},
clean AS (SELECT db, bucket_type, time_bucket, CASE WHEN query_type IN ('vector', 'hybrid', 'bm25', 'rerank') THEN query_type ELSE 'other' END AS t,
  CASE WHEN lower(trim(user_id)) NOT IN ('', 'anonymous') THEN lower(trim(user_id)) END AS u,
  CASE WHEN lower(trim(session_id)) NOT IN ('', 'anonymous') THEN lower(trim(session_id)) END AS s FROM bucketed),
sliced AS (SELECT *, '' AS query_type FROM clean UNION ALL SELECT *, t FROM clean)
SELECT 'user' AS kind, db AS database_id, bucket_type, time_bucket, query_type, count(DISTINCT u) AS n_distinct FROM sliced GROUP BY ALL HAVING count(DISTINCT u) > 0
UNION ALL SELECT 'session', db, bucket_type, time_bucket, query_type, count(DISTINCT s) FROM sliced GROUP BY ALL HAVING count(DISTINCT s) > 0""",
    "p4_group_sets": f"""WITH {_COUNTED},
clean AS (SELECT CASE WHEN contains(database_id, 'support') THEN 'support' ELSE 'other' END AS g, w, CASE WHEN lower(trim(user_id)) NOT IN ('', 'anonymous') THEN lower(trim(user_id)) END AS u,
  CASE WHEN lower(trim(session_id)) NOT IN ('', 'anonymous') THEN lower(trim(session_id)) END AS s FROM dated WHERE database_id IS NOT NULL)
SELECT 'user' AS kind, g AS databases, w AS time_bucket, count(DISTINCT u) AS n_distinct FROM clean GROUP BY ALL HAVING count(DISTINCT u) > 0
UNION ALL SELECT 'session', g, w, count(DISTINCT s) FROM clean GROUP BY ALL HAVING count(DISTINCT s) > 0""",
    "p5_found": """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('p' || file_path, 'd' || doc_id) ORDER BY uploaded_at DESC NULLS LAST, doc_id DESC) AS rn
  FROM documents) WHERE rn = 1 AND length(text) > 0),
m AS (SELECT *, CASE WHEN length(text) > 1024 THEN ceil((length(text) - 100) / 924.0) ELSE 1 END AS least,
  list_max(list_transform(string_split_regex(text, '[\\s。！？]'), lambda x: length(x))) AS stretch FROM d)
SELECT doc_id, 'must_split' AS finding FROM m WHERE length(text) > 1024
UNION ALL SELECT doc_id, 'no_boundary' FROM m WHERE stretch > 1024
UNION ALL SELECT doc_id, 'undercount' FROM m WHERE status = 'complete' AND chunk_count < least""",
}
