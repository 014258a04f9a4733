"""Queries on storage, import and export, validation, lifecycle, access and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vectide.operators import lifecycle as Y
from vectide.operators import store as R
from vectide.operators import validation as N
from vectide.plans.registry import query
from vectide.sources import importers as J
from vectide.sources.storage import scratch
from vectide.sources.tables import table
from vectide.streaming import logs

LAST = "SELECT * FROM arrow_utils QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, updated_at DESC) = 1"


def records(spark, d):
    return table(spark, d, "arrow_utils")


def last(df):
    return R.latest(df, "id", ("version", "updated_at"))


@query("scan_vectors", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def scan_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("batch_get", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 141, 59, -7, 9999999)")
def batch_get(spark, d):
    """Rows of the ids that exist."""
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(3, 141, 59, -7, 9999999)).select("vec_id", "label")


@query("list_page", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_name DESC LIMIT 50 OFFSET 100")
def list_page(spark, d):
    return Y.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_mktsegment"), F.desc("c_name"), offset=100)


@query("vec_count", "SELECT count(*) AS n, count(*) > 0 AS exists FROM arrow_utils WHERE NOT deleted")
def vec_count(spark, d):
    return R.live(records(spark, d)).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("exists"))


@query("upsert", f"SELECT id, version, owner FROM ({LAST})")
def upsert(spark, d):
    r = records(spark, d)
    return R.upsert(r.where("version = 1"), r.where("version <> 1 or version is null"), "id", ("version", "updated_at")).select("id", "version", "owner")


VALID = 'id IS NOT NULL AND id <> \'\' AND len("values") = 64 AND len(list_filter("values", lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0'


@query("batch_store", f"""SELECT count(*) FILTER ({VALID}) AS stored, count(*) FILTER (NOT coalesce({VALID}, false)) AS rejected, true AS intact FROM arrow_utils""")
def batch_store(spark, d):
    """All rows validated, the good ones stored and read again: as many, and with the same checksum."""
    good, bad = N.split_valid(records(spark, d), N.vector_errors(64))
    store = R.Store(spark, scratch(spark, "store"))
    store.write(good)
    sent, kept = (R.integrity(x, ["id", "version", "values"]).select(*[F.col(c).alias(f"{c}_{side}") for c in ("n", "checksum")]) for side, x in (("sent", good), ("kept", store.read())))
    refused = bad.agg(F.count(F.lit(1)).alias("rejected"))
    # one row each
    whole = (F.col("n_sent") == F.col("n_kept")) & (F.col("checksum_sent") == F.col("checksum_kept"))
    return kept.crossJoin(F.broadcast(sent)).crossJoin(F.broadcast(refused)).select(F.col("n_kept").alias("stored"), "rejected", whole.alias("intact"))


@query("update_delete", """SELECT id, version, CASE WHEN owner = 'owner01' THEN 'owner99' ELSE owner END AS owner FROM arrow_utils WHERE id NOT IN (SELECT id FROM arrow_utils WHERE status = 'archived')""")
def update_delete(spark, d):
    r = records(spark, d).select(F.concat_ws("/", "id", "version", "updated_at").alias("key"), "id", "version", "owner")
    changes = r.where("owner = 'owner01'").distinct().withColumn("owner", F.lit("owner99"))
    counts = r.where("owner = 'owner01'").groupBy("key").count()
    updated = R.update(r, changes.join(counts, "key").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select(*r.columns), "key")
    return R.delete(updated, records(spark, d).where("status = 'archived'").select("id"), "id").select("id", "version", "owner")


@query("soft_delete", "SELECT id, version FROM arrow_utils WHERE NOT deleted AND id NOT IN (SELECT id FROM arrow_utils WHERE status = 'archived')")
def soft_delete(spark, d):
    r = records(spark, d)
    return R.live(R.soft_delete(r, r.where("status = 'archived'").select("id"))).select("id", "version")


@query("compact", "SELECT count(*) AS total, count(*) FILTER (deleted) AS deleted, count(*) >= 10 AND count(*) FILTER (deleted) / count(*) >= 0.01 AS due, count(*) FILTER (NOT deleted) AS kept FROM arrow_utils")
def compact(spark, d):
    r = records(spark, d)
    store = R.Store(spark, scratch(spark, "compact"))
    store.write(r)
    store.compact(files=4)
    kept = store.read().agg(F.count(F.lit(1)).alias("kept"))
    return R.needs_compaction(r, ratio=0.01).crossJoin(F.broadcast(kept))


@query("incremental_diff", f"""WITH b AS (SELECT id, max(version) AS o FROM arrow_utils WHERE version <= 2 AND deleted IS NOT TRUE GROUP BY 1), a AS (SELECT id, max(version) AS version FROM arrow_utils WHERE status IS DISTINCT FROM 'archived' GROUP BY 1)
SELECT * FROM (SELECT id, version, CASE WHEN o IS NULL THEN 'added' WHEN version IS NULL THEN 'removed' WHEN version <> o THEN 'updated' END AS change FROM b FULL JOIN a USING (id)) WHERE change IS NOT NULL""")
def incremental_diff(spark, d):
    r = records(spark, d)
    before = R.live(r).where("version <= 2").groupBy("id").agg(F.max("version").alias("version"))
    after = r.where("status is distinct from 'archived'").groupBy("id").agg(F.max("version").alias("version"))
    return R.changed(before, after)


@query("integrity", "SELECT count(*) AS n, count(DISTINCT id) AS ids, true AS same_in_any_order, true AS tells_a_missing_row FROM arrow_utils")
def integrity(spark, d):
    """Counts, and what the checksum must do."""
    r, columns = records(spark, d), ["id", "version", "values"]
    all_rows = R.integrity(r, columns)
    again = R.integrity(r.repartition(7, "version"), columns).select(F.col("checksum").alias("again"))
    one = r.orderBy("id", "version").limit(1)
    less = R.integrity(r.where(F.col("id") != one.first()["id"]), columns).select(F.col("checksum").alias("less"))
    return all_rows.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(less)).select("n", "ids", (F.col("checksum") == F.col("again")).alias("same_in_any_order"), (F.col("checksum") != F.col("less")).alias("tells_a_missing_row"))


def with_states(spark, d) -> R.Store:
    """A store with a state per highest version 1 to 4."""
    store = R.Store(spark, scratch(spark, "states"))
    for v in range(1, 5):
        store.write(records(spark, d).where(F.col("version") <= v))
    return store


STATE = "(SELECT count(*) FROM arrow_utils WHERE version <= {})"


@query("snapshot_list", " UNION ALL ".join(f"SELECT {v} AS state, {STATE.format(v)} AS n" for v in range(1, 5)))
def snapshot_list(spark, d):
    """Every state with its rows."""
    store = with_states(spark, d)
    out = None
    for i, name in enumerate(store.snapshots(), 1):
        one = store.read(name).agg(F.lit(i).alias("state"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snapshot_restore", f"SELECT 5 AS states, {STATE.format(2)} AS n, true AS intact")
def snapshot_restore(spark, d):
    """An older state made the current one again, and verified."""
    store = with_states(spark, d)
    name = store.restore(store.snapshots()[1])
    intact = store.verify(name, ["id", "version", "values"], records(spark, d).where("version <= 2"))
    return store.read().agg(F.lit(len(store.snapshots())).alias("states"), F.count(F.lit(1)).alias("n"), F.lit(intact).alias("intact"))


@query("snapshot_prune", f"SELECT 3 AS states, {STATE.format(1)} AS n")
def snapshot_prune(spark, d):
    """The two newest states kept, then another written, which is the one that is read."""
    store = with_states(spark, d)
    store.keep(2)
    store.write(records(spark, d).where("version <= 1"))
    return store.read().agg(F.lit(len(store.snapshots())).alias("states"), F.count(F.lit(1)).alias("n"))


FINITE = 'id IS NOT NULL AND len("values") > 0'
IMPORTED = "SELECT count(*) AS total, count(*) FILTER ({0}) AS imported, count(*) - count(*) FILTER ({0}) AS errors, round(count(*) FILTER ({0}) * 100 / count(*), 4) AS success_rate FROM products"


@query("import_json", IMPORTED.format(FINITE))
def import_json(spark, d):
    """Products written as arrays of JSON records and imported again; statistics of the import."""
    folder = scratch(spark, "json")
    own = table(spark, d, "products").select("id", "values", F.create_map(F.lit("text"), F.coalesce("metadata", F.lit(""))).alias("metadata"))
    J.write_json_arrays(own, folder)
    return J.import_statistics(J.read_json(spark, folder))


@query("import_csv", IMPORTED.format(FINITE))
def import_csv(spark, d):
    folder = scratch(spark, "csv")
    J.write_csv(table(spark, d, "products").select("id", "values", F.when(F.get_json_object("metadata", "$.name").isNotNull(), F.col("metadata")).alias("metadata")), folder)
    return J.import_statistics(J.read_csv(spark, folder))


@query("export_csv", f"SELECT count(*) AS exported, count(*) AS equal FROM ({LAST})")
def export_csv(spark, d):
    """Export of all latest records and its round trip: rows whose values came back as they were, nulls as nulls."""
    folder = scratch(spark, "export")
    own = last(records(spark, d)).select("id", "values", F.col("custom").alias("metadata"))
    J.write_csv(own, folder)
    back = J.read_csv(spark, folder).select(F.col("id").alias("again_id"), F.col("values").alias("again"))
    same = F.col("again_id").eqNullSafe(F.col("id")) & F.col("values").eqNullSafe(F.col("again"))
    return own.join(back, F.col("id").eqNullSafe(F.col("again_id")), "left").agg(F.count(F.lit(1)).alias("exported"), F.count_if(same).alias("equal"))


@query("import_stats", """SELECT count(*) AS total, count(*) FILTER (id IS NOT NULL AND len("values") > 0) AS imported, count(*) - count(*) FILTER (id IS NOT NULL AND len("values") > 0) AS errors,
  round(count(*) FILTER (id IS NOT NULL AND len("values") > 0) * 100 / count(*), 4) AS success_rate FROM products""")
def import_stats(spark, d):
    return J.import_statistics(table(spark, d, "products"))


@query("extract_text", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))) AS n FROM documents WHERE text IS NOT NULL")
def extract_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(J.plain_text(F.col("text"))).cast("bigint").alias("n"))


@query("extract_docx", "SELECT doc_id, length(text) AS n, true AS same FROM documents WHERE text IS NOT NULL AND lang = 'en' AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\r]')")
def extract_docx(spark, d):
    """English texts packed as word-processor files and extracted again."""
    own = table(spark, d, "documents").where("text is not null and lang = 'en'").where(~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]"))
    return own.select("doc_id", "text", J.docx_text(J.as_docx(F.col("text"))).alias("back")).select("doc_id", F.length("back").cast("bigint").alias("n"), (F.col("back") == F.col("text")).alias("same"))


# Access: customers are users, nations groups, market segments roles, suppliers' nations grant databases

ROLE = "('AUTOMOBILE', 'read'), ('AUTOMOBILE', 'write'), ('BUILDING', 'read'), ('FURNITURE', 'admin'), ('MACHINERY', 'read'), ('HOUSEHOLD', 'export')"
RBAC = f"""WITH role_permissions(role_id, permission) AS (VALUES {ROLE}), user_roles AS (SELECT c_custkey AS user_id, c_mktsegment AS role_id FROM customer),
members AS (SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer), group_roles AS (SELECT n_nationkey AS group_id, CASE n_regionkey WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'AUTOMOBILE' END AS role_id FROM nation WHERE n_regionkey < 3),
up AS (SELECT DISTINCT user_id, permission FROM user_roles JOIN role_permissions USING (role_id)),
gp AS (SELECT DISTINCT user_id, permission FROM members JOIN group_roles USING (group_id) JOIN role_permissions USING (role_id))"""


def access(spark, d):
    c = table(spark, d, "customer")
    rows = [("AUTOMOBILE", "read"), ("AUTOMOBILE", "write"), ("BUILDING", "read"), ("FURNITURE", "admin"), ("MACHINERY", "read"), ("HOUSEHOLD", "export")]
    permissions = spark.createDataFrame(rows, "role_id string, permission string")
    role = F.when(F.col("n_regionkey") == 0, "BUILDING").when(F.col("n_regionkey") == 1, "FURNITURE").when(F.col("n_regionkey") == 2, "AUTOMOBILE")
    groups = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("group_id"), role.alias("role_id"))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role_id")), c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id")), groups, permissions


@query("rbac_user_perms", f"{RBAC} SELECT * FROM up")
def rbac_user_perms(spark, d):
    roles, _, _, permissions = access(spark, d)
    return Y.permissions_of_users(roles, permissions)


@query("rbac_group_perms", f"{RBAC} SELECT * FROM gp")
def rbac_group_perms(spark, d):
    _, members, groups, permissions = access(spark, d)
    return Y.permissions_by_groups(members, groups, permissions)


@query("rbac_union", f"{RBAC} SELECT * FROM up UNION SELECT * FROM gp")
def rbac_union(spark, d):
    return rbac_user_perms(spark, d).union(rbac_group_perms(spark, d)).distinct()


GRANT = f"""{RBAC}, granted AS (SELECT c_custkey AS user_id, s_suppkey AS database_id FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50
  UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey)"""


def holders(spark, d):
    """Users and databases, each with an own key and a group."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("own"), F.col("c_nationkey").alias("group_id"))
    return users, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).alias("own"), F.col("s_nationkey").alias("group_id"))


@query("rbac_db_perms", f"{GRANT} SELECT * FROM granted")
def rbac_db_perms(spark, d):
    """Databases granted to users directly or by their groups."""
    return Y.databases_of_users(*holders(spark, d))


@query("rbac_check", f"{GRANT} SELECT u.c_custkey AS user_id, count(g.database_id) > 0 AS allowed FROM customer u LEFT JOIN granted g ON g.user_id = u.c_custkey AND g.database_id = 7 GROUP BY 1")
def rbac_check(spark, d):
    """Whether each user may use one database."""
    users, dbs = holders(spark, d)
    one = dbs.where("id = 7").withColumnRenamed("id", "database_id")
    own = users.join(one.select("own", "database_id"), "own").select("id", "database_id").union(users.join(one.select("group_id", "database_id"), "group_id").select("id", "database_id")).distinct()
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(own.withColumnRenamed("id", "user_id"), "user_id", "left").groupBy("user_id").agg((F.count("database_id") > 0).alias("allowed"))


# Validation and lifecycle


@query("validate_vectors", """SELECT id, version, list_filter([CASE WHEN "values" IS NULL OR len("values") = 0 THEN 'no values' END, CASE WHEN len("values") > 0 AND len("values") <> 64 THEN 'dimension' END,
  CASE WHEN len(list_filter("values", lambda x: x IS NULL)) > 0 THEN 'null element' END, CASE WHEN len(list_filter("values", lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not finite' END], lambda e: e IS NOT NULL) AS errors
FROM arrow_utils WHERE len(errors) > 0""")
def validate_vectors(spark, d):
    return N.split_valid(records(spark, d), N.vector_errors(64))[1].select("id", "version", "errors")


@query("validate_schema", """SELECT id, version, list_filter([CASE WHEN coalesce(owner, '') = '' THEN 'owner: missing' END, CASE WHEN status NOT IN ('active', 'archived', 'draft') THEN 'status: not allowed' END,
  CASE WHEN score < 0.1 OR score > 0.95 THEN 'score: out of range' END, CASE WHEN NOT regexp_full_match(category, '[a-k][a-z]+') THEN 'category: pattern' END], lambda e: e IS NOT NULL) AS errors FROM arrow_utils WHERE len(errors) > 0""")
def validate_schema(spark, d):
    rules = [N.Rule("owner", required=True), N.Rule("status", allowed=("active", "archived", "draft")), N.Rule("score", kind="FLOAT", low=0.1, high=0.95), N.Rule("category", pattern="[a-k][a-z]+")]
    return N.split_valid(records(spark, d), N.schema_errors(rules))[1].select("id", "version", "errors")


@query("retention", "SELECT doc_id FROM documents WHERE NOT coalesce(uploaded_at < TIMESTAMP '2018-01-08' - INTERVAL 3 DAY, false)")
def retention(spark, d):
    return Y.split_expired(table(spark, d, "documents"), "uploaded_at", "2018-01-08", 3)[0].select("doc_id")


@query("archive_split", "SELECT CASE WHEN coalesce(uploaded_at < TIMESTAMP '2018-01-08' - INTERVAL 3 DAY, false) THEN 'archive' ELSE 'live' END AS part, count(*) AS n FROM documents GROUP BY 1")
def archive_split(spark, d):
    keep, old = Y.split_expired(table(spark, d, "documents"), "uploaded_at", "2018-01-08", 3)
    both = keep.select(F.lit("live").alias("part")).unionByName(old.select(F.lit("archive").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("validate_items", """SELECT id, version, list_filter([CASE WHEN coalesce(json_extract_string(custom, '$.region'), '') = '' THEN 'custom.region: missing' END, CASE WHEN json_extract_string(custom, '$.region') NOT IN ('north', 'south') THEN 'custom.region: not allowed' END,
  CASE WHEN len(list_filter(tags, lambda t: length(t) > 3)) > 0 THEN 'tags: too long (item)' END], lambda e: e IS NOT NULL) AS errors FROM arrow_utils WHERE len(errors) > 0""")
def validate_items(spark, d):
    """Rules on keys inside a JSON column and on the elements of an array."""
    rules = [N.Rule("custom.region", required=True, allowed=("north", "south")), N.Rule("tags", kind="ARRAY", items=N.Rule("tag", max_length=3))]
    return N.split_valid(records(spark, d), N.schema_errors(rules))[1].select("id", "version", "errors")


@query("validate_default", """SELECT id, version, list_filter([CASE WHEN length(owner) > 255 THEN 'owner: too long' END, CASE WHEN length(category) > 100 THEN 'category: too long' END,
  CASE WHEN status NOT IN ('active', 'archived', 'deleted', 'draft') THEN 'status: not allowed' END, CASE WHEN length(metadata_source) > 100 THEN 'metadata_source: too long' END,
  CASE WHEN score < 0 OR score > 1 THEN 'score: out of range' END, CASE WHEN len(list_filter(tags, lambda t: length(t) > 50)) > 0 THEN 'tags: too long (item)' END,
  CASE WHEN len(list_filter(permissions, lambda t: length(t) > 50)) > 0 THEN 'permissions: too long (item)' END], lambda e: e IS NOT NULL) AS errors, 0 AS warnings FROM arrow_utils""")
def validate_default(spark, d):
    """Every record by the default rules."""
    return records(spark, d).select("id", "version", N.schema_errors(N.DEFAULT_RULES).alias("errors"), F.size(N.schema_warnings(N.DEFAULT_RULES)).alias("warnings"))


OLD = "coalesce(uploaded_at < TIMESTAMP '2018-01-08' - INTERVAL 3 DAY, false)"


@query("cleanup_plan", f"SELECT count(*) AS n, ceil(count(*) / 100.0)::BIGINT AS batches, min(uploaded_at) AS oldest, max(uploaded_at) AS newest FROM documents WHERE {OLD}")
def cleanup_plan(spark, d):
    """What a cleanup would delete, and in how many batches; nothing is deleted."""
    return Y.cleanup_plan(table(spark, d, "documents"), "uploaded_at", "2018-01-08", 3, 100)


@query("archive_restore", f"SELECT count(*) FILTER (NOT {OLD} OR lang = 'en') AS live, count(*) FILTER ({OLD} AND coalesce(lang, '') <> 'en') AS archived FROM documents")
def archive_restore(spark, d):
    """Old documents moved to the archive, the English ones brought back."""
    live, old = Y.split_expired(table(spark, d, "documents"), "uploaded_at", "2018-01-08", 3)
    live, old = Y.restore(live, old, F.col("lang") == "en")
    return live.agg(F.count(F.lit(1)).alias("live")).crossJoin(F.broadcast(old.agg(F.count(F.lit(1)).alias("archived"))))


@query("archive_rotate", """WITH a AS (SELECT doc_id, uploaded_at, row_number() OVER (ORDER BY uploaded_at DESC NULLS LAST, doc_id) AS r FROM documents)
SELECT doc_id FROM a WHERE r <= 200 AND NOT coalesce(uploaded_at < TIMESTAMP '2018-01-06', false)""")
def archive_rotate(spark, d):
    """An archive without what has expired, cut to its newest 200 entries."""
    return Y.rotate(table(spark, d, "documents"), "uploaded_at", "2018-01-06", 200, "doc_id").select("doc_id")


@query("privacy_export", "SELECT 'query_log' AS source, count(*) AS n, min(\"timestamp\") AS first, max(\"timestamp\") AS last FROM query_log WHERE user_id = 'usr_000001'")
def privacy_export(spark, d):
    """All that is held on one person."""
    own = Y.export_person({"query_log": table(spark, d, "query_log")}, ["usr_000001"])
    return own["query_log"].agg(F.lit("query_log").alias("source"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("privacy_purge", "SELECT coalesce(user_id IN ('usr_000001', 'anonymous'), false) AS erased, count(*) AS n FROM query_log WHERE coalesce(user_id IN ('usr_000001', 'anonymous'), false) OR NOT coalesce(logged_at < TIMESTAMP '2018-01-08' - INTERVAL 2 DAY, false) GROUP BY 1")
def privacy_purge(spark, d):
    """Rows older than the period are dropped, but for those already erased, which stay as marks."""
    return Y.purge(Y.erase(table(spark, d, "query_log"), ["usr_000001", "anonymous"]), "logged_at", "2018-01-08", 2).groupBy("erased").agg(F.count(F.lit(1)).alias("n"))


@query("db_list", "SELECT database_id, count(*) AS n FROM query_log WHERE database_id LIKE '%kb%' GROUP BY 1 ORDER BY 1 LIMIT 20")
def db_list(spark, d):
    own = table(spark, d, "query_log").where(F.col("database_id").contains("kb")).groupBy("database_id").agg(F.count(F.lit(1)).alias("n"))
    return Y.page(own, F.col("database_id"), limit=20)


@query("erase_user", """SELECT user_id IS NOT NULL AND user_id IN ('usr_000001', 'anonymous') AS erased, count(*) AS n, count(DISTINCT CASE WHEN user_id IN ('usr_000001', 'anonymous') THEN '[ERASED]' ELSE query_text END) AS texts FROM query_log GROUP BY 1""")
def erase_user(spark, d):
    return Y.erase(table(spark, d, "query_log"), ["usr_000001", "anonymous"]).groupBy("erased").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_text").alias("texts"))


@query("audit_search", "SELECT id, user_id, error_message FROM query_log WHERE has_error AND error_message = 'timeout' ORDER BY \"timestamp\" DESC, id DESC LIMIT 50 OFFSET 10")
def audit_search(spark, d):
    own = table(spark, d, "query_log").where("has_error and error_message = 'timeout'")
    return Y.page(own, F.desc("timestamp"), F.desc("id"), offset=10).select("id", "user_id", "error_message")


@query("encrypt_roundtrip", "SELECT count(query_text) AS n, count(query_text) AS equal, count(DISTINCT query_text) AS tokens, count(DISTINCT query_text) AS texts FROM query_log")
def encrypt_roundtrip(spark, d):
    """Texts encrypted and decrypted, and searchable by a deterministic token."""
    key = F.lit("0123456789abcdef")
    rows = table(spark, d, "query_log").where("query_text is not null").select("query_text", F.aes_encrypt("query_text", key).alias("c"), F.sha2(F.concat(key, F.col("query_text")), 256).alias("token"))
    back = F.aes_decrypt("c", key).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(back == F.col("query_text")).alias("equal"), F.count_distinct("token").alias("tokens"), F.count_distinct("query_text").alias("texts"))


# Streams


def open_log(spark, d):
    """The log as a stream: a folder of files, or the one file by a pattern for its name."""
    schema = table(spark, d, "query_log").schema
    path = f"{d}/query_log.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", os.path.basename(path)).parquet(d)


@query("stream_ingest", "SELECT count(*) AS n, count(DISTINCT query_id) AS queries, sum(total_time_ms)::BIGINT AS total FROM query_log")
def stream_ingest(spark, d):
    out, state = scratch(spark, "ingest"), scratch(spark, "ingest-state")
    logs.ingest(open_log(spark, d), out, state).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"), F.sum("total_time_ms").alias("total"))


@query("stream_hourly", """SELECT database_id, "timestamp" // 3600000 * 3600000 AS time_bucket, count(*) AS total_queries, count(*) FILTER (has_error) AS failed_queries, round(avg(total_time_ms), 9) AS avg_latency_ms,
  list_sort(list(total_time_ms) FILTER (total_time_ms IS NOT NULL))[greatest(ceil(0.95 * count(total_time_ms) - 1e-9), 1)::BIGINT] AS p95_latency_ms FROM query_log WHERE "timestamp" IS NOT NULL GROUP BY 1, 2""")
def stream_hourly(spark, d):
    """Hourly figures kept up to date: each batch writes the hours it changed, readers take an hour's last figures."""
    out, state = scratch(spark, "hourly"), scratch(spark, "hourly-state")
    logs.run_to_end(logs.hourly(open_log(spark, d)), out, state)
    return logs.current(spark, out).select("database_id", "time_bucket", "total_queries", "failed_queries", F.round("avg_latency_ms", 9).alias("avg_latency_ms"), "p95_latency_ms")


@query("stream_distinct", "SELECT count(DISTINCT query_id) AS n FROM query_log WHERE query_id IS NOT NULL AND \"timestamp\" IS NOT NULL")
def stream_distinct(spark, d):
    """The log without redeliveries, as a stream."""
    out, state = scratch(spark, "once"), scratch(spark, "once-state")
    logs.ingest(logs.deduplicated(open_log(spark, d).where("query_id is not null and timestamp is not null")), out, state).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))
