"""Queries on indexes, codecs and sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import indexes as I
from vectide.operators import quantise as Z
from vectide.operators import search as S
from vectide.operators import sharding as H
from vectide.plans.registry import query
from vectide.plans.vector_queries import L2, Q, embeddings, probe
from vectide.sources.tables import table


#: The ten nearest of every query, of which an index must find nine tenths.
ENOUGH = "SELECT 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


def pairs(spark, d):
    e = embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return e, e.where("id % 100 = 0")


def recall(spark, d, found, metric):
    e, q = pairs(spark, d)
    return S.recall(found, S.batch_search(e, q, 10, metric=metric), ["query_id", "id"]).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query("idx_flat", f"SELECT vec_id, distance FROM (SELECT vec_id, round({L2}, 6) AS distance FROM embeddings) WHERE distance <= 1.35 ORDER BY distance, vec_id LIMIT 50")
def idx_flat(spark, d):
    dist = F.round(V.euclidean(F.col("embedding"), V.literal(probe(spark, d))), 6)
    return embeddings(spark, d).select("vec_id", dist.alias("distance")).where("distance <= 1.35").orderBy("distance", "vec_id").limit(50)


EXACT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
   FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"""


@query("idx_ivf", EXACT)
def idx_ivf(spark, d):
    """All clusters probed, which must be exact; recall with fewer probes is that of recall_at_k."""
    e, q = pairs(spark, d)
    return I.ivf_search(I.ivf_build(e, clusters=16), q, 10, probes=16)


@query("idx_ivf_changed", EXACT.replace("embeddings b ON", "(SELECT * FROM embeddings WHERE vec_id % 7 <> 3) b ON"))
def idx_ivf_changed(spark, d):
    """Built on a part, the rest added, some rows updated, some removed; all clusters probed, which must be exact."""
    e, q = pairs(spark, d)
    index = I.ivf_build(e.where("id % 3 <> 0"), clusters=16).add(e.where("id % 3 = 0"))
    return I.ivf_search(index.update(e.where("id % 5 = 1")).remove(e.where("id % 7 = 3")), q, 10, probes=16)


@query("idx_contains", "SELECT i AS id, i IN (SELECT vec_id FROM embeddings) AS found FROM (SELECT unnest([1, 2, -5, 99999999]::BIGINT[]) AS i)")
def idx_contains(spark, d):
    e, _ = pairs(spark, d)
    return I.ivf_build(e, clusters=4).contains(spark.createDataFrame([(1,), (2,), (-5,), (99_999_999,)], "id bigint"))


@query("idx_catalog", "SELECT 'flat' AS name, 'flat' AS kind, count(*) AS n, true AS ready FROM embeddings UNION ALL SELECT 'clusters', 'ivf', count(*), true FROM embeddings UNION ALL SELECT 'codes', 'pq', 0, false")
def idx_catalog(spark, d):
    """The indexes of a collection, their sizes and whether they cover it."""
    e, _ = pairs(spark, d)
    catalog = I.Catalog(spark).add("flat", "flat", e).add("clusters", "ivf", I.ivf_build(e, clusters=8).rows).add("codes", "pq", e.where("false")).add("old", "flat", e)
    return catalog.drop("old").listing(e)


@query("idx_lsh", ENOUGH)
def idx_lsh(spark, d):
    e, q = pairs(spark, d)
    return recall(spark, d, I.lsh_search(I.lsh_buckets(e, 64, tables=32, projections=3, width=1.8), q, 10), "cosine")


@query("idx_pq", ENOUGH)
def idx_pq(spark, d):
    e, q = pairs(spark, d)
    books = I.pq_train(e)
    return recall(spark, d, I.pq_search(I.pq_encode(e, books), q, 10, books), "euclidean")


@query("idx_opq", ENOUGH)
def idx_opq(spark, d):
    e, q = pairs(spark, d)
    books = I.pq_train(e, rotate=True)
    return recall(spark, d, I.pq_search(I.pq_encode(e, books), q, 10, books), "euclidean")


@query("idx_hnsw", ENOUGH)
def idx_hnsw(spark, d):
    e, q = pairs(spark, d)
    return recall(spark, d, I.hnsw_search(I.hnsw_build(e), q, 10), "euclidean")


SQR = """r AS (SELECT [min(embedding[1]), min(embedding[2])]::DOUBLE[] AS l2 FROM embeddings),
u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY i)"""


@query("sq_ranges", f"WITH {SQR} SELECT i::INT AS dim, round(lo, 6) AS low, round(hi, 6) AS high FROM b")
def sq_ranges(spark, d):
    r = Z.ranges(embeddings(spark, d), "embedding", 64)
    return r.select(F.posexplode(F.arrays_zip("low", "high")).alias("p", "r")).select((F.col("p") + 1).alias("dim"), F.round("r.low", 6).alias("low"), F.round("r.high", 6).alias("high"))


@query("idx_sq", f"""WITH {SQR}, q AS (SELECT unnest({Q}) AS x, unnest(range(1, 65)) AS i),
dec AS (SELECT vec_id, i, lo + floor((u.x - lo) / (hi - lo) * 255) / 255 * (hi - lo) AS y FROM u JOIN b USING (i))
SELECT vec_id, round(sqrt(sum((y - q.x) ** 2)), 6) AS distance FROM dec JOIN q USING (i) GROUP BY vec_id ORDER BY distance, vec_id LIMIT 10""")
def idx_sq(spark, d):
    """Whole query against decoded codes."""
    e = embeddings(spark, d)
    r = Z.ranges(e, "embedding", 64).first()
    low, high = V.literal(r["low"]), V.literal(r["high"])
    decoded = e.select("vec_id", Z.scalar_codes(F.col("embedding"), low, high).alias("codes")).withColumn("y", Z.scalar_values(F.col("codes"), low, high))
    return decoded.select("vec_id", F.round(V.euclidean(F.col("y"), V.literal(probe(spark, d))), 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("covariance", """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings)
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def covariance(spark, d):
    return Z.covariance(embeddings(spark, d), "embedding", 64).select("i", "j", F.round("cov", 8).alias("cov"))


CODE = "WITH c AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi, list_transform(e, lambda x: (floor((x - list_min(e)) / (list_max(e) - list_min(e)) * 255) - 128)::INT) AS codes FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"


@query("quantize_int8", f"{CODE} SELECT vec_id, list_sum(codes)::BIGINT AS total, codes[1] AS first, round(list_sum(list_transform(codes, lambda x: lo + (x + 128) / 255 * (hi - lo))), 6) AS decoded FROM c")
def quantize_int8(spark, d):
    rows = embeddings(spark, d).select("vec_id", Z.int8(F.col("embedding")).alias("s"))
    total = F.aggregate("s.codes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    decoded = F.aggregate(Z.from_int8(F.col("s")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", total.alias("total"), F.element_at("s.codes", 1).alias("first"), F.round(decoded, 6).alias("decoded"))


@query("truncate_dims", "SELECT vec_id, 64 AS dim, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS total FROM embeddings")
def truncate_dims(spark, d):
    back = Z.padded(Z.truncate(F.col("embedding"), 16), 64)
    return embeddings(spark, d).select("vec_id", F.size(back).alias("dim"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("compression_stats", """SELECT id, version, CASE WHEN len("values") > 0 THEN round((len("values") + 16) / (len("values") * 4), 6) ELSE 0 END AS ratio,
  CASE WHEN len("values") > 0 THEN round((1 - (len("values") + 16) / (len("values") * 4)) * 100, 6) ELSE 0 END AS saved FROM arrow_utils WHERE "values" IS NOT NULL""")
def compression_stats(spark, d):
    n = F.size("values")
    s = Z.compression(n * 4, n + 16)
    return table(spark, d, "arrow_utils").where("values is not null").select("id", "version", F.round(s["ratio"], 6).alias("ratio"), F.round(s["saved"], 6).alias("saved"))


# Sharding


BYTES = "list_transform(range(1, length(id) + 1), lambda i: ord(substr(id, i, 1))::HUGEINT)"


@query("shard_hash", f"""SELECT DISTINCT id, (list_reduce(list_concat([5381::HUGEINT], {BYTES}), lambda h, b: (h * 33 + b) % 18446744073709551616) % 8)::INT AS djb2,
  (list_reduce(list_concat([14695981039346656037::HUGEINT], {BYTES}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 8)::INT AS fnv1a FROM arrow_utils WHERE id IS NOT NULL""")
def shard_hash(spark, d):
    """Placement by two hashes that other systems use."""
    return table(spark, d, "arrow_utils").where("id is not null").select("id", H.djb2("id", 8).alias("djb2"), H.fnv1a("id", 8).alias("fnv1a")).distinct()


@query("shard_own", "SELECT true AS spread, count(DISTINCT id) AS n FROM arrow_utils WHERE id IS NOT NULL")
def shard_own(spark, d):
    """The engine's own placement: every shard within a fifth of its part of the ids."""
    ids = table(spark, d, "arrow_utils").where("id is not null").select("id").distinct().select(H.hash_shard("id", 8).alias("shard"))
    sizes = ids.groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg((F.max("c") <= 1.4 * F.avg("c")).alias("spread"), F.sum("c").alias("n"))


@query("shard_range", "SELECT vec_id, ntile(8) OVER (ORDER BY vec_id) AS shard FROM embeddings")
def shard_range(spark, d):
    return H.range_shard(embeddings(spark, d).select("vec_id"), "vec_id", 8)


@query("shard_balance", """WITH s AS (SELECT shard, count(*) AS n FROM arrow_utils GROUP BY 1) SELECT count(*) AS shards, min(n) AS least, max(n) AS most, round((max(n) - min(n)) / avg(n), 6) AS imbalance, (max(n) - min(n)) / avg(n) <= 0.1 AS balanced FROM s""")
def shard_balance(spark, d):
    return H.balance(table(spark, d, "arrow_utils"), "shard")
