"""Queries on vector functions and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.functions.geo import haversine_m
from vectide.operators import search as S
from vectide.plans.registry import query
from vectide.sources.tables import table


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def probe(spark, d, vec_id: int = 0) -> list[float]:
    """The query vector: one row of the table."""
    row = embeddings(spark, d).where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
E = "embedding::DOUBLE[]"
COS = f"round(list_cosine_similarity({E}, {Q}), 6)"
L2 = f"list_distance({E}, {Q})"
EUC = f"round(1 / (1 + {L2}), 6)"
DOT = f"round(list_inner_product({E}, {Q}), 6)"
#: Usable records: 64 elements without null, NaN and not all zero.
REC = """rec AS (SELECT *, "values"::DOUBLE[] AS v FROM arrow_utils WHERE len("values") = 64
  AND len(list_filter("values", lambda x: x IS NULL OR isnan(x))) = 0 AND NOT deleted)"""


def records(spark, d) -> DataFrame:
    """Live records of arrow_utils with whole vectors."""
    whole = (F.size("values") == 64) & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x))
    return table(spark, d, "arrow_utils").where(~F.col("deleted") & whole)


def pairwise(name: str, f, sql: str) -> None:
    @query(name, f"SELECT vec_id, round({sql}, 6) AS value FROM embeddings")
    def run(spark, d):
        return embeddings(spark, d).select("vec_id", F.round(f(F.col("embedding"), V.literal(probe(spark, d))), 6).alias("value"))


pairwise("vec_cosine", V.cosine, f"list_cosine_similarity({E}, {Q})")
pairwise("vec_euclidean", V.euclidean, L2)
pairwise("vec_dot", V.dot, f"list_inner_product({E}, {Q})")


@query("vec_norm", f"SELECT vec_id, round(sqrt(list_inner_product({E}, {E})), 6) AS value FROM embeddings")
def vec_norm(spark, d):
    return embeddings(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("value"))


@query("vec_normalize", f"""SELECT vec_id, round(list_sum(u), 6) AS total, round(u[1], 6) AS first, round(u[64], 6) AS last FROM
  (SELECT vec_id, list_transform({E}, lambda x: x * 3 / sqrt(9 * list_inner_product({E}, {E}))) AS u FROM embeddings)""")
def vec_normalize(spark, d):
    u = V.normalize(V.scale(F.col("embedding"), 3))
    rows = embeddings(spark, d).select("vec_id", u.alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


def batch(name: str, metric: str, sql: str) -> None:
    @query(name, f"""SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {sql} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  WHERE similarity >= 0.4""")
    def run(spark, d):
        e = embeddings(spark, d)
        return S.batch_range(e, e.where("vec_id % 100 = 0"), 0.4, metric, "vec_id", "embedding")


batch("vec_batch_cosine", "cosine", "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)")
batch("vec_batch_euclidean", "euclidean", "round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)")


@query("vec_arith", f"""SELECT vec_id, round(e[1] + q[1], 6) AS plus, round(e[2] - q[2], 6) AS minus, round(e[3] * 2.5, 6) AS times,
  round(list_sum(e) + list_sum(q), 6) AS total FROM (SELECT vec_id, {E} AS e, {Q} AS q FROM embeddings)""")
def vec_arith(spark, d):
    e, q = F.col("embedding"), V.literal(probe(spark, d))
    plus = V.add(e, q)
    return embeddings(spark, d).select(
        "vec_id", F.round(F.element_at(plus, 1), 6).alias("plus"), F.round(F.element_at(V.subtract(e, q), 2), 6).alias("minus"),
        F.round(F.element_at(V.scale(e, 2.5), 3), 6).alias("times"), F.round(F.aggregate(plus, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query("vec_matvec", f"""SELECT vec_id, round(list_sum(e), 6) AS y1, round(list_sum(list_transform(e, lambda x, i: x * (i % 3))), 6) AS y2 FROM
  (SELECT vec_id, {E} AS e FROM embeddings)""")
def vec_matvec(spark, d):
    y = V.matvec([[1.0] * 64, [float(i % 3) for i in range(1, 65)]], F.col("embedding"))
    return embeddings(spark, d).select("vec_id", F.round(F.element_at(y, 1), 6).alias("y1"), F.round(F.element_at(y, 2), 6).alias("y2"))


@query("hash_embedding", """WITH raw AS (SELECT vec_id, list_transform(range(0, 64), lambda i: (('0x' || substr(md5('vector ' || vec_id || ':' || i), 1, 8))::BIGINT % 10000) / 5000.0 - 1) AS r FROM embeddings)
SELECT vec_id, round(r[1] / sqrt(list_inner_product(r, r)), 6) AS first, round(r[64] / sqrt(list_inner_product(r, r)), 6) AS last FROM raw""")
def hash_embedding(spark, d):
    u = V.hash_embedding(F.concat(F.lit("vector "), F.col("vec_id").cast("string")), 64)
    rows = embeddings(spark, d).select("vec_id", u.alias("u"))
    return rows.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


def knn(name: str, metric: str, sql: str, threshold: float = 0.0) -> None:
    @query(name, f"SELECT vec_id, similarity FROM (SELECT vec_id, {sql} AS similarity FROM embeddings) WHERE similarity >= {threshold} ORDER BY similarity DESC, vec_id LIMIT 10")
    def run(spark, d):
        return S.search(embeddings(spark, d), probe(spark, d), S.SearchOptions(metric=metric, threshold=threshold), "vec_id", "embedding")


knn("knn_cosine", "cosine", COS)
knn("knn_euclidean", "euclidean", EUC)
knn("knn_dot", "dot", DOT)
knn("knn_heap", "cosine", COS, 0.1)

RQ = "(SELECT v FROM rec ORDER BY id, version LIMIT 1)"


@query("knn_filtered", f"""WITH {REC} SELECT id, version, category, similarity FROM (SELECT *, CASE WHEN isnan(list_cosine_similarity(v, {RQ})) THEN 0 ELSE round(list_cosine_similarity(v, {RQ}), 6) END AS similarity FROM rec
  WHERE category = 'laptop' AND score BETWEEN 0.2 AND 0.9 AND list_has_any(tags, ['hot', 'new'])) WHERE similarity >= 0 ORDER BY similarity DESC, id, version LIMIT 20""")
def knn_filtered(spark, d):
    r = records(spark, d)
    q = [float(x) for x in r.orderBy("id", "version").select("values").first()["values"]]
    options = S.SearchOptions(top_k=20, category="laptop", min_score=0.2, max_score=0.9, tags=("hot", "new"))
    rows = S.score(r.where(S.metadata_predicate(options)), q).where(F.col("similarity") >= options.threshold)
    return rows.select("id", "version", "category", "similarity").orderBy(F.desc("similarity"), "id", "version").limit(options.top_k)


@query("range_search", f"SELECT vec_id, similarity FROM (SELECT vec_id, {COS} AS similarity FROM embeddings) WHERE similarity >= 0.15")
def range_search(spark, d):
    return S.range_search(embeddings(spark, d), probe(spark, d), 0.15, "vec_id", "embedding")


@query("knn_batch", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
   FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def knn_batch(spark, d):
    e = embeddings(spark, d)
    return S.batch_search(e, e.where("vec_id % 100 = 0"), 10, id_column="vec_id", values="embedding")


@query("knn_project", f"SELECT vec_id, similarity, label, len(embedding) AS dim FROM (SELECT *, {COS} AS similarity FROM embeddings) ORDER BY similarity DESC, vec_id LIMIT 10")
def knn_project(spark, d):
    o = S.SearchOptions(keep=("label", "embedding"))
    return S.search(embeddings(spark, d), probe(spark, d), o, "vec_id", "embedding").select("vec_id", "similarity", "label", F.size("embedding").alias("dim"))


@query("knn_sharded", f"SELECT vec_id, vec_id % 7 AS shard, similarity FROM (SELECT vec_id, {COS} AS similarity FROM embeddings) ORDER BY similarity DESC, vec_id LIMIT 10")
def knn_sharded(spark, d):
    return S.sharded(embeddings(spark, d), probe(spark, d), 10, F.col("vec_id") % 7, "vec_id", "embedding")


@query("recall_at_k", "SELECT 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def recall_at_k(spark, d):
    """Recall of the clustered index against the full scan."""
    from vectide.operators.indexes import ivf_build, ivf_search

    e = embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    queries = e.where("id % 100 = 0")
    exact = S.batch_search(e, queries, 10)
    index = ivf_build(e, clusters=16, seed=100)
    return S.recall(ivf_search(index, queries, 10, probes=12), exact, ["query_id", "id"]).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query("geo_knn", """WITH p AS (SELECT c_custkey, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lon FROM customer),
h AS (SELECT c_custkey, pow(sin(radians(lat - 37.7749) / 2), 2) + cos(radians(37.7749)) * cos(radians(lat)) * pow(sin(radians(lon + 122.4194) / 2), 2) AS a FROM p)
SELECT c_custkey, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 2) AS metres FROM h ORDER BY metres, c_custkey LIMIT 10""")
def geo_knn(spark, d):
    rows = places(spark, d).select("c_custkey", F.round(haversine_m(F.lit(37.7749), F.lit(-122.4194), F.col("lat"), F.col("lon")), 2).alias("metres"))
    return rows.orderBy("metres", "c_custkey").limit(10)


def places(spark, d) -> DataFrame:
    """Customers at made-up coordinates that follow from their keys."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", ((key * 37 % 18000) / 100.0 - 90).alias("lat"), ((key * 91 % 36000) / 100.0 - 180).alias("lon"))


@query("embed_provider", "SELECT doc_id, length(text)::DOUBLE AS first, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS last FROM documents WHERE text IS NOT NULL")
def embed_provider(spark, d):
    """Vectors by a model that each task loads once; here one that counts characters."""

    def load():
        return lambda texts: [(len(t), t.count("e")) for t in texts]

    rows = table(spark, d, "documents").where("text is not null").select("doc_id", V.embedder(load, 2)("text").alias("v"))
    return rows.select("doc_id", F.element_at("v", 1).alias("first"), F.element_at("v", 2).alias("last"))


@query("knn_own_metric", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS similarity
   FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def knn_own_metric(spark, d):
    """A metric of one's own: the sum of absolute differences."""

    def block(q, x):
        import numpy as np

        return np.stack([1 / (1 + np.abs(x - row).sum(axis=1)) for row in q]) if len(q) else np.zeros((0, len(x)))

    V.register_metric("manhattan", lambda a, b: V.similarity_of_distance(V.folded(a, b, lambda x, y: F.abs(x - y))), block)
    e = embeddings(spark, d)
    return S.batch_search(e, e.where("vec_id % 100 = 0"), 10, metric="manhattan", id_column="vec_id", values="embedding")
