"""Queries on metadata, geographic, temporal, nested and full-text filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import geo
from vectide.operators import filters as X
from vectide.operators.filters import Condition as C
from vectide.operators.filters import Group as G
from vectide.plans.registry import query
from vectide.plans.vector_queries import places
from vectide.sources.tables import table

OUT = ["id", "version"]


def on_records(name: str, f, where: str) -> None:
    """A filter on arrow_utils, whole table."""

    @query(name, f"SELECT id, version FROM arrow_utils WHERE {where}")
    def run(spark, d):
        return X.apply(table(spark, d, "arrow_utils"), f).select(*OUT)


REGION = "coalesce(json_extract_string(custom, '$.region'), '')"
on_records("flt_eq", C("metadata.category", "EQUALS", "laptop"), "coalesce(category, '') = 'laptop'")
on_records("flt_ne", C("category", "NOT_EQUALS", "laptop"), "coalesce(category, '') <> 'laptop'")
on_records("flt_range", G("AND", (C("score", "GREATER_THAN_OR_EQUAL", 0.3), C("score", "LESS_THAN", "0.7"), C("custom.batch", "GREATER_THAN", 100), C("version", "LESS_THAN_OR_EQUAL", 2))),
           "score::DOUBLE >= 0.3 AND score::DOUBLE < 0.7 AND try_cast(json_extract_string(custom, '$.batch') AS DOUBLE) > 100 AND version <= 2")
on_records("flt_contains", G("AND", (C("owner", "CONTAINS", "er1"), C("tags", "CONTAINS", "hot"))), "coalesce(owner, '') LIKE '%er1%' AND list_contains(tags, 'hot')")
on_records("flt_not_contains", G("AND", (C("owner", "NOT_CONTAINS", "er1"), C("tags", "NOT_CONTAINS", "hot"))), "coalesce(owner, '') NOT LIKE '%er1%' AND NOT coalesce(list_contains(tags, 'hot'), false)")
on_records("flt_in", G("AND", (C("category", "IN", values=("laptop", "phone")), C("permissions", "IN", values=("write", "admin")))), "category IN ('laptop', 'phone') AND list_has_any(permissions, ['write', 'admin'])")
on_records("flt_not_in", G("AND", (C("category", "NOT_IN", values=("laptop", "phone")), C("permissions", "NOT_IN", values=("write",)))),
           "coalesce(category, '') NOT IN ('laptop', 'phone') AND NOT coalesce(list_has_any(permissions, ['write']), false)")
on_records("flt_exists", G("AND", (C("category", "EXISTS"), C("tags", "EXISTS"))), "coalesce(category, '') <> '' AND len(tags) > 0")
on_records("flt_not_exists", G("OR", (C("source_of_nothing", "EXISTS"), C("status", "NOT_EXISTS"), C("tags", "NOT_EXISTS"))), "coalesce(status, '') = '' OR coalesce(len(tags), 0) = 0")
on_records("flt_regex", C("id", "MATCHES_REGEX", "(chair|lamp)_0+[0-9]{2,3}"), "regexp_full_match(id, '(chair|lamp)_0+[0-9]{2,3}')")
on_records("flt_and_or", G("OR", (C("owner", "EQUALS", "owner08"), C("status", "EQUALS", "archived"))), "coalesce(owner, '') = 'owner08' OR coalesce(status, '') = 'archived'")
NESTED = G("AND", (C("custom.region", "IN", values=("north", "east")), G("OR", (C("status", "EQUALS", "active"), G("AND", (C("score", "GREATER_THAN", 0.9), C("tags", "CONTAINS", "new")))))))
NESTED_SQL = f"{REGION} IN ('north', 'east') AND (coalesce(status, '') = 'active' OR coalesce(score::DOUBLE > 0.9 AND list_contains(tags, 'new'), false))"
on_records("flt_nested", NESTED, NESTED_SQL)
on_records("flt_array_all", C("tags", "CONTAINS_ALL", values=("hot", "new")), "list_has_all(tags, ['hot', 'new'])")
on_records("flt_parse_string", X.parse_text("custom.region IN (north, 'east') AND (status = active OR score > 0.9 AND tags CONTAINS new)"), NESTED_SQL)
on_records("flt_parse_json", X.parse_json('{"combination": "AND", "conditions": [{"field": "metadata.custom.region", "op": "IN", "values": ["north", "east"]}, {"combination": "OR", "conditions": '
           '[{"field": "status", "op": "=", "value": "active"}, {"combination": "AND", "conditions": [{"field": "score", "op": ">", "value": 0.9}, {"field": "tags", "op": "CONTAINS", "value": "new"}]}]}]}'), NESTED_SQL)

PLACES = "(SELECT c_custkey, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lon FROM customer)"


@query("geo_radius", f"""WITH h AS (SELECT c_custkey, pow(sin(radians(lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(lat)) * pow(sin(radians(lon - 2.3522) / 2), 2) AS a FROM {PLACES})
SELECT c_custkey FROM h WHERE 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) <= 2500000""")
def geo_radius(spark, d):
    text = F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    lat, lon = geo.parse_point(text)
    return places(spark, d).where(geo.within_radius(lat, lon, (48.8566, 2.3522), 2_500_000)).select("c_custkey")


@query("geo_list", f"""WITH h AS (SELECT c_custkey, lat, lon, pow(sin(radians(lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(lat)) * pow(sin(radians(lon - 2.3522) / 2), 2) AS a FROM {PLACES})
SELECT c_custkey FROM h WHERE 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) <= 6000000 AND lat BETWEEN 0 AND 60 AND lon BETWEEN -40 AND 80 AND c_custkey % 10 <> 0""")
def geo_list(spark, d):
    """All of a list of conditions on a location given as text, a tenth of which is no location."""
    text = F.when(F.col("c_custkey") % 10 == 0, "nowhere").otherwise(F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
    return places(spark, d).where(geo.all_of(text, [("radius", (48.8566, 2.3522), 6_000_000), ("box", (0, -40), (60, 80))])).select("c_custkey")


@query("geo_bbox", f"SELECT c_custkey FROM {PLACES} WHERE lat BETWEEN -10 AND 45.5 AND lon BETWEEN -20 AND 100.25")
def geo_bbox(spark, d):
    return places(spark, d).where(geo.within_box(F.col("lat"), F.col("lon"), (-10, -20), (45.5, 100.25))).select("c_custkey")


@query("tmp_before_after", "SELECT id, version FROM arrow_utils WHERE created_at < TIMESTAMP '2018-01-06' AND updated_at > TIMESTAMP '2018-01-02 06:00:00'")
def tmp_before_after(spark, d):
    created, updated = F.col("created_at").cast("timestamp"), F.col("updated_at").cast("timestamp")
    return table(spark, d, "arrow_utils").where((created < X.parse_time(F.lit("2018-01-06"))) & (updated > X.parse_time(F.lit("2018-01-02T06:00:00Z")))).select(*OUT)


@query("tmp_between", "SELECT id, version FROM arrow_utils WHERE created_at BETWEEN TIMESTAMP '2018-01-02' AND TIMESTAMP '2018-01-04 12:00:00'")
def tmp_between(spark, d):
    return table(spark, d, "arrow_utils").where(F.col("created_at").cast("timestamp").between(X.parse_time(F.lit("2018-01-02")), X.parse_time(F.lit("2018-01-04 12:00:00")))).select(*OUT)


@query("tmp_within", "SELECT id, version FROM arrow_utils WHERE abs(epoch_ms(updated_at) - epoch_ms(created_at)) <= 7200000")
def tmp_within(spark, d):
    return table(spark, d, "arrow_utils").where(X.within_duration(F.col("updated_at").cast("timestamp"), F.col("created_at").cast("timestamp"), 7_200_000)).select(*OUT)


@query("tmp_at", "SELECT id FROM query_log WHERE date_trunc('second', logged_at) = date_trunc('second', make_timestamp(\"timestamp\" * 1000))")
def tmp_at(spark, d):
    return table(spark, d, "query_log").where(X.at_second(F.col("logged_at").cast("timestamp"), F.timestamp_millis("timestamp"))).select("id")


@query("tmp_parse", """SELECT id, CASE id % 7 WHEN 0 THEN epoch_ms(date_trunc('second', logged_at)) WHEN 1 THEN epoch_ms(date_trunc('second', logged_at)) WHEN 2 THEN epoch_ms(date_trunc('day', logged_at))
  WHEN 4 THEN epoch_ms(logged_at) WHEN 5 THEN epoch_ms(date_trunc('second', logged_at)) - 7200000 END AS ms FROM query_log""")
def tmp_parse(spark, d):
    """Texts in all formats: ISO, with a blank, a day, month first (no format), with a fraction, with an offset, no time."""
    at, kind = F.col("logged_at").cast("timestamp"), F.col("id") % 7
    formats = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"]
    text = F.coalesce(*[F.when(kind == i, F.date_format(at, f)) for i, f in enumerate(formats)], F.lit("soon"))
    return table(spark, d, "query_log").select("id", F.unix_millis(X.parse_time(text)).alias("ms"))


GOOD = "CASE WHEN json_valid(metadata) THEN metadata::JSON END"


@query("json_exists", f"SELECT id FROM products WHERE json_extract_string({GOOD}, '$.rating') <> ''")
def json_exists(spark, d):
    return table(spark, d, "products").where(X.path_exists(F.col("metadata"), "$.rating")).select("id")


@query("json_match", f"SELECT id FROM products WHERE json_extract_string({GOOD}, '$.category') = 'laptop'")
def json_match(spark, d):
    return table(spark, d, "products").where((F.get_json_object("metadata", "$.category") == "laptop") & F.try_parse_json("metadata").isNotNull()).select("id")


@query("json_count", f"""SELECT id, len(json_keys({GOOD}))::INT AS n_keys, json_array_length({GOOD}, '$.tags')::INT AS n_tags FROM products
  WHERE json_array_length({GOOD}, '$.tags') > 1 OR len(json_keys({GOOD})) < 4""")
def json_count(spark, d):
    whole = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    tags = F.json_array_length(F.get_json_object(whole, "$.tags"))
    rows = table(spark, d, "products").select("id", X.json_size(whole).alias("n_keys"), tags.alias("n_tags"))
    return rows.where("n_tags > 1 or n_keys < 4")


@query("json_subpath", f"SELECT id FROM products WHERE json_extract({GOOD}, '$.category')::VARCHAR = '\"laptop\"' OR json_extract({GOOD}, '$.rating')::VARCHAR = '2.8'")
def json_subpath(spark, d):
    """Values of keys inside an object, compared as they are written in JSON."""
    m = F.col("metadata")
    return table(spark, d, "products").where(X.subpath_matches(m, "$", "category", '"laptop"') | X.subpath_matches(m, "$", "rating", "2.8")).select("id")


@query("json_values", f"SELECT id, unnest(json_extract_string({GOOD}, '$.tags[*]')) AS value FROM products")
def json_values(spark, d):
    """Nested values as rows."""
    whole = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    return table(spark, d, "products").select("id", F.explode(X.nested_values(whole, "$.tags")).alias("value"))


def on_documents(name: str, f, where: str) -> None:
    @query(name, f"SELECT doc_id FROM documents WHERE {where}")
    def run(spark, d):
        return table(spark, d, "documents").where(f(F.col("text"))).select("doc_id")


on_documents("ft_all", lambda t: X.has_all_terms(t, "Payslip notice"), "contains(lower(text), 'payslip') AND contains(lower(text), 'notice')")
on_documents("ft_any", lambda t: X.has_any_term(t, "payslip Gasket"), "contains(lower(text), 'payslip') OR contains(lower(text), 'gasket')")
on_documents("ft_phrase", lambda t: X.has_phrase(t, "Second look at the"), "contains(lower(text), 'second look at the')")
on_documents("ft_regex", lambda t: t.rlike("[Ss]tep [0-9]+: re"), "regexp_matches(text, '[Ss]tep [0-9]+: re')")
on_documents("ft_fuzzy", lambda t: X.fuzzy(t, "payslip"), "len(list_filter(string_split(text, ' '), lambda t: length(t) BETWEEN 5 AND 9 AND levenshtein(t, 'payslip') <= 2)) > 0")


@query("levenshtein", "SELECT id, levenshtein(lower(pattern_text), normalized_text) AS distance FROM search_patterns")
def levenshtein(spark, d):
    return table(spark, d, "search_patterns").select("id", F.levenshtein(F.lower("pattern_text"), F.col("normalized_text")).cast("bigint").alias("distance"))


@query("flt_combined", f"""SELECT id, version FROM arrow_utils WHERE coalesce(status, '') = 'active' AND created_at < TIMESTAMP '2018-01-05' AND {REGION} <> 'south' AND contains(lower(owner), 'owner1')
  AND score::DOUBLE > 0.1""")
def flt_combined(spark, d):
    rows = table(spark, d, "arrow_utils")
    metadata = X.Compiler(rows.schema).compile(G("AND", (C("status", "EQUALS", "active"), C("score", "GREATER_THAN", 0.1), C("custom.region", "NOT_EQUALS", "south"))))
    return rows.where(metadata & (F.col("created_at").cast("timestamp") < X.parse_time(F.lit("2018-01-05"))) & X.has_any_term(F.col("owner"), "OWNER1")).select(*OUT)
