"""Queries on words, keyword search, fusion, hybrid search, reranking and retrieval context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectide.functions.text import NORMALISER_STOP_WORDS, normalize_query
from vectide.functions.words import SEARCH_STOP_WORDS, preprocess, tokens
from vectide.operators import bm25 as B
from vectide.operators import chunks as K
from vectide.operators import fusion as U
from vectide.operators import search as S
from vectide.plans.registry import query
from vectide.plans.vector_queries import COS, L2, embeddings, probe
from vectide.sources.storage import scratch
from vectide.sources.tables import spread, table

LOWER = {c: c + 32 for c in range(65, 91)}
ASK = "payslip notice period for the referral bonus payslip"
STOP = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS) + ")"
NORMALISER_STOP = "(" + ", ".join(f"'{w}'" for w in NORMALISER_STOP_WORDS) + ")"
TOK = f"list_filter(string_split_regex(translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN {STOP})"
WORDS = f"w AS (SELECT doc_id, coalesce({TOK.format('text')}, []) AS t FROM documents)"
POST = f"{WORDS}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY ALL), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w)"
BM25 = f"""{POST}, q AS (SELECT unnest({TOK.format(f"'{ASK}'")}) AS term), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
kw AS (SELECT p.doc_id, sum(ln((c.n - dfs.df + 0.5) / (dfs.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(w.t) / c.avgdl))) AS score
  FROM q JOIN p USING (term) JOIN dfs USING (term) JOIN w ON w.doc_id = p.doc_id CROSS JOIN c GROUP BY p.doc_id),
bm AS (SELECT doc_id, round(score, 6) AS score FROM kw ORDER BY 2 DESC, 1 LIMIT 100),
ve AS (SELECT vec_id AS doc_id, {COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY 2 DESC, 1 LIMIT 100),
rv AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ve), rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm),
mv AS (SELECT doc_id, 0.01 + 0.99 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM ve),
mb AS (SELECT doc_id, 0.01 + 0.99 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM bm)"""


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


_INDEXES: dict[tuple[str, str], B.Index] = {}


def index_of(spark, d, fresh: bool = False) -> B.Index:
    """The stored index of a folder's documents, built when it is first asked for in a session."""
    key = (spark.sparkContext.applicationId, d)
    if fresh or key not in _INDEXES:
        _INDEXES[key] = B.Index(spark, scratch(spark, "bm25"), buckets=8).add(documents(spark, d))
    return _INDEXES[key]


def short(scored, k: int):
    """The k best rows of a list as a local table, as fusion reads it more than once."""
    schema = scored.select("doc_id", "score").schema
    return scored.sparkSession.createDataFrame(scored.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k).collect(), schema)


def keyword(spark, d, k: int = 100):
    """The k best documents for the query."""
    return short(index_of(spark, d).score(ASK).select("doc_id", F.round("score", 6).alias("score")), k)


def nearest(spark, d, k: int = 100):
    """Vector candidates among the documents that have a vector."""
    own = embeddings(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return short(S.search(own, probe(spark, d), S.SearchOptions(top_k=k, threshold=0.0), "vec_id", "embedding").select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score")), k)


@query("tokenize", f"SELECT doc_id, len({TOK.format('text')}) AS n, md5(array_to_string({TOK.format('text')}, ' ')) AS words FROM documents")
def tokenize(spark, d):
    t = tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.when(F.col("text").isNotNull(), F.size(t)).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("words"))


@query("bm25_idf", f"WITH {POST} SELECT term, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p CROSS JOIN c GROUP BY term")
def bm25_idf(spark, d):
    docs = documents(spark, d)
    df = B.inverted(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(B.corpus(B.doc_lengths(docs)))).select("term", F.round(B.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("bm25_score", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM kw")
def bm25_score(spark, d):
    return index_of(spark, d).score(ASK).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return keyword(spark, d, 10)


@query("inverted_index", f"WITH {WORDS}, e AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM w) SELECT term, doc_id, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM e GROUP BY ALL")
def inverted_index(spark, d):
    return B.inverted(documents(spark, d)).select("term", "doc_id", "tf", F.element_at("positions", 1).cast("bigint").alias("first"), F.element_at("positions", -1).cast("bigint").alias("last"))


@query("bm25_index", f"WITH {POST} SELECT (SELECT count(*) FROM p) AS postings, (SELECT sum(tf)::BIGINT FROM p) AS occurrences, n, round(avgdl, 6) AS avgdl FROM c")
def bm25_index(spark, d):
    """The index written and read again."""
    index = index_of(spark, d, fresh=True)
    n, avgdl = index.totals()
    postings = index.postings().agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences"))
    return postings.select("postings", "occurrences", F.lit(n).cast("bigint").alias("n"), F.lit(round(avgdl, 6)).alias("avgdl"))


CHANGED = f"""{WORDS.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'payslip payslip gasket' ELSE text END AS text FROM documents WHERE status <> 'failed' OR status IS NULL)")}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY ALL), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),
q AS (SELECT unnest(['payslip', 'gasket', 'payslip']) AS term), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def changed_index(spark, d) -> B.Index:
    """Built in two steps, some documents removed, others given new texts."""
    docs, all_rows = table(spark, d, "documents").select("doc_id", "text", "status"), F.col("doc_id") % 2
    index = B.Index(spark, scratch(spark, "changed"), buckets=8).add(docs.where(all_rows == 0)).add(docs.where(all_rows == 1))
    index.update(docs.where("doc_id % 10 = 3").withColumn("text", F.lit("payslip payslip gasket")))
    return index.remove(docs.where("status = 'failed'"))


@query("bm25_changed", f"""WITH {CHANGED} SELECT p.doc_id, round(sum(ln((c.n - dfs.df + 0.5) / (dfs.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(w.t) / c.avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN dfs USING (term) JOIN w ON w.doc_id = p.doc_id CROSS JOIN c GROUP BY p.doc_id""")
def bm25_changed(spark, d):
    """Scores from an index after additions, updates and removals."""
    return changed_index(spark, d).score("payslip gasket payslip").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_document", f"WITH {BM25} SELECT round(coalesce((SELECT score FROM kw WHERE doc_id = 7), 0), 6) AS there, 0.0::DOUBLE AS missing")
def bm25_document(spark, d):
    """The scores of two documents, one of which does not exist."""
    index = index_of(spark, d)
    return spark.createDataFrame([(round(index.score_document(ASK, 7), 6), index.score_document(ASK, -1))], "there double, missing double")


@query("index_lookup", f"WITH {POST} SELECT t.term, count(p.term) AS df, count(p.term) > 0 AS held FROM (SELECT unnest(['payslip', 'gasket', 'nosuchword']) AS term) t LEFT JOIN p ON p.term = t.term GROUP BY 1")
def index_lookup(spark, d):
    """Document frequencies of terms, and whether the index holds them."""
    return index_of(spark, d).frequency(["payslip", "gasket", "nosuchword"]).withColumn("held", F.col("df") > 0)


@query("index_all", f"WITH {POST} SELECT (SELECT count(DISTINCT term) FROM p) AS terms, n AS documents FROM c")
def index_all(spark, d):
    """All terms and all documents, counted."""
    index = index_of(spark, d)
    return index.terms().agg(F.count(F.lit(1)).alias("terms")).crossJoin(F.broadcast(index.documents().agg(F.count(F.lit(1)).alias("documents"))))


@query("bm25_stats", f"WITH {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term")
def bm25_stats(spark, d):
    return B.inverted(documents(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query("inverted_stats", f"WITH {POST}, s AS (SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS terms, count(*) AS postings FROM p) SELECT *, round(postings / terms, 6) AS postings_per_term FROM s")
def inverted_stats(spark, d):
    per_term = B.inverted(documents(spark, d))
    s = per_term.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))
    return s.withColumn("postings_per_term", F.round(F.col("postings") / F.col("terms"), 6))


@query("postings_lookup", f"WITH {POST} SELECT term, doc_id, tf FROM p WHERE term IN ('payslip', 'gasket')")
def postings_lookup(spark, d):
    return index_of(spark, d).postings(["payslip", "gasket"]).select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"))


@query("index_remove", f"WITH {POST} SELECT term, count(*) AS df FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE status = 'failed') GROUP BY term")
def index_remove(spark, d):
    """The index without some documents; terms that only they held are gone."""
    gone = table(spark, d, "documents").where("status = 'failed'").select("doc_id")
    return B.inverted(documents(spark, d)).join(gone, "doc_id", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("normalize_text", """SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(query_text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'),
  lambda x: x <> '' AND x NOT IN __STOP__), ' ') AS normalized FROM query_log""".replace("__STOP__", NORMALISER_STOP))
def normalize_text(spark, d):
    return table(spark, d, "query_log").select("id", normalize_query(F.col("query_text")).alias("normalized"))


PRE = "trim(regexp_replace(regexp_replace(lower(query_text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g'))"


@query("preprocess_text", f"""SELECT id, CASE WHEN length(p) <= 15 THEN p ELSE left(p, 15) END AS head, CASE WHEN length(p) <= 15 THEN p ELSE right(p, 15) END AS tail,
  CASE WHEN length(p) <= 15 THEN p ELSE left(p, 8) || right(p, 7) END AS both_ends, rpad(p, 15, '.') AS padded FROM (SELECT id, {PRE} AS p FROM query_log)""")
def preprocess_text(spark, d):
    t = F.col("query_text")
    return table(spark, d, "query_log").select("id", preprocess(t, max_length=15).alias("head"), preprocess(t, max_length=15, truncate="start").alias("tail"), preprocess(t, max_length=15, truncate="middle").alias("both_ends"), preprocess(t, max_length=15, pad=".").alias("padded"))


# Fusion


def pair(spark, d):
    return nearest(spark, d), keyword(spark, d)


@query("norm_minmax", f"WITH {BM25} SELECT doc_id, round(s, 6) AS value FROM mb")
def norm_minmax(spark, d):
    return keyword(spark, d).select("doc_id", F.round(U.min_max(F.col("score")), 6).alias("value"))


@query("norm_zscore", f"WITH {BM25} SELECT doc_id, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6) AS value FROM bm")
def norm_zscore(spark, d):
    return keyword(spark, d).select("doc_id", F.round(U.z_score(F.col("score")), 6).alias("value"))


RRF = "(SELECT doc_id, sum(1 / (60 + r)) AS score FROM (SELECT * FROM rv UNION ALL SELECT * FROM rb) GROUP BY doc_id)"
LIN = "(SELECT doc_id, 0.7 * coalesce(mv.s, 0) + 0.3 * coalesce(mb.s, 0) AS score FROM mv FULL JOIN mb USING (doc_id))"


@query("fuse_rrf", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM {RRF}")
def fuse_rrf(spark, d):
    return U.rrf(pair(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@query("fuse_linear", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM {LIN}")
def fuse_linear(spark, d):
    return U.linear(*pair(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@query("fuse_max", f"WITH {BM25} SELECT doc_id, max(score) AS score FROM (SELECT * FROM ve UNION ALL SELECT * FROM bm) GROUP BY doc_id")
def fuse_max(spark, d):
    return U.maximum(pair(spark, d))


def fused_sql(source: str) -> str:
    return f"WITH {BM25} SELECT doc_id, round(f.score, 6) AS score, ve.score AS vector_score, bm.score AS keyword_score FROM {source} f LEFT JOIN ve USING (doc_id) LEFT JOIN bm USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10"


@query("hybrid_rrf", fused_sql(RRF))
def hybrid_rrf(spark, d):
    return U.hybrid(*pair(spark, d), k=10)


@query("hybrid_linear", fused_sql(LIN))
def hybrid_linear(spark, d):
    return U.hybrid(*pair(spark, d), k=10, method="linear")


@query("hybrid_bm25_only", f"WITH {BM25} SELECT doc_id, round(1 / (60 + r), 6) AS score, NULL::DOUBLE AS vector_score, score AS keyword_score FROM rb ORDER BY r LIMIT 10")
def hybrid_bm25_only(spark, d):
    vector, words = pair(spark, d)
    return U.hybrid(vector.where("false"), words, k=10)


DIST = f"da AS (SELECT vec_id AS doc_id, round({L2}, 6) AS score FROM embeddings ORDER BY 2, 1 LIMIT 50), db AS (SELECT vec_id AS doc_id, round(list_distance(embedding[1:32]::DOUBLE[], (SELECT embedding[1:32]::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY 2, 1 LIMIT 50)"


def distance_lists(spark, d):
    """Two distance lists: of whole vectors, and of their first halves."""
    from vectide.functions import vectors as V

    q = probe(spark, d)
    out = []
    for n in (64, 32):
        s = F.round(V.euclidean(F.slice("embedding", 1, n), V.literal(q[:n])), 6)
        out.append(embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), s.alias("score")).orderBy("score", "doc_id").limit(50))
    return out


@query("composite_rrf", f"WITH {DIST}, r AS (SELECT doc_id, 0.6 / (60 + row_number() OVER (ORDER BY score, doc_id) - 1) AS s FROM da UNION ALL SELECT doc_id, 0.4 / (60 + row_number() OVER (ORDER BY score, doc_id) - 1) FROM db) SELECT doc_id, round(sum(s), 6) AS score FROM r GROUP BY doc_id")
def composite_rrf(spark, d):
    lists = [x.withColumn("score", -F.col("score")) for x in distance_lists(spark, d)]
    return U.rrf(lists, first_rank=0, weights=[0.6, 0.4]).select("doc_id", F.round("score", 6).alias("score"))


@query("composite_weighted", f"WITH {DIST} SELECT doc_id, round(1 / sum(s), 8) AS distance FROM (SELECT doc_id, 0.6 / (score + 1e-6) AS s FROM da UNION ALL SELECT doc_id, 0.4 / (score + 1e-6) FROM db) GROUP BY doc_id")
def composite_weighted(spark, d):
    return U.composite_weighted(distance_lists(spark, d), [0.6, 0.4]).select("doc_id", F.round("distance", 8).alias("distance"))


@query("composite_simple", f"WITH {DIST} SELECT doc_id, round(avg(score), 7) AS distance FROM (SELECT * FROM da UNION ALL SELECT * FROM db) GROUP BY doc_id")
def composite_simple(spark, d):
    return U.composite_mean(distance_lists(spark, d)).select("doc_id", F.round("distance", 7).alias("distance"))


# Reranking

OVER = f"len(list_intersect(list_distinct({TOK.format(f'''{chr(39)}{ASK}{chr(39)}''')}), {TOK.format('text')})) / len(list_distinct({TOK.format(f'''{chr(39)}{ASK}{chr(39)}''')}))"


def texts_of(spark, d, scored):
    """A short list with its texts; the ids reach the scan."""
    ids = [r["doc_id"] for r in scored.select("doc_id").collect()]
    return scored.join(table(spark, d, "documents").select("doc_id", "text").where(F.col("doc_id").isin(*ids)), "doc_id")


@query("rerank_blend", f"""WITH {BM25} SELECT doc_id, score, round(0.7 * {OVER} + 0.3 * score, 6) AS combined FROM mbx JOIN documents USING (doc_id) WHERE round(0.7 * {OVER} + 0.3 * score, 6) >= 0.3 ORDER BY combined DESC, doc_id LIMIT 20""".replace(" SELECT doc_id, score, round(0.7", ", mbx AS (SELECT doc_id, round(s, 6) AS score FROM mb) SELECT doc_id, score, round(0.7", 1))
def rerank_blend(spark, d):
    listed = keyword(spark, d).select("doc_id", F.round(U.min_max(F.col("score")), 6).alias("score"))
    return U.rerank(texts_of(spark, d, listed), F.lit(ASK), threshold=0.3, k=20).select("doc_id", "score", "combined")


METRICS = f"""WITH {BM25}, g AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score / sum(score) OVER () AS p FROM bm),
m AS (SELECT round(var_pop(score), 6) AS variance, round(max(score) - min(score), 6) AS spread, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS top_gap, round(-sum(p * log2(p)), 6) AS entropy FROM g)"""


@query("rerank_model", f"SELECT doc_id, round({OVER}, 6) AS combined FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM ({{}}))".replace("({})", f"(WITH {BM25} SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 20)"))
def rerank_model(spark, d):
    """Reranking by a model that each task loads once; here one that counts the query's words in the text."""

    def load():
        import re

        words = lambda x: {w for w in re.split("[^a-z0-9]+", x.translate(LOWER)) if w and w not in SEARCH_STOP_WORDS}
        return lambda queries, texts: [len(words(q) & words(t)) / max(len(words(q)), 1) for q, t in zip(queries, texts)]

    return U.rerank(texts_of(spark, d, keyword(spark, d, 20)), F.lit(ASK), U.model_scorer(load), weight=1.0).select("doc_id", "combined")


@query("rerank_metrics", f"{METRICS} SELECT * FROM m")
def rerank_metrics(spark, d):
    m = U.rerank_metrics(keyword(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("rerank_adaptive", f"{METRICS} SELECT unnest(['variance', 'spread', 'top_gap', 'entropy']) AS metric, unnest([variance >= 0.1, spread >= 0.1, top_gap >= 0.1, entropy >= 0.1]) AS rerank FROM m")
def rerank_adaptive(spark, d):
    """Whether each measure of the result list asks for reranking."""
    m = rerank_metrics(spark, d)
    return m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(c) >= 0.1).alias("rerank")) for c in m.columns])))


@query("rerank_standalone", f"SELECT doc_id, round({OVER}, 6) AS combined FROM documents WHERE text IS NOT NULL")
def rerank_standalone(spark, d):
    """Texts posted without scores are ordered by the scorer alone."""
    posted = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.lit(0.0).alias("score"))
    return U.rerank(posted, F.lit(ASK), weight=1.0).select("doc_id", "combined")


# Chunks and context


@query("chunk_fixed", """SELECT doc_id, i AS chunk, substr(text, (i * 462 + 1)::BIGINT, 512) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 50) / 462.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, d):
    return K.fixed(documents(spark, d), "doc_id", "text", 512, 50)


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return K.recursive(documents(spark, d), "doc_id", "text", 512, 50)


@query("chunk_meta", """WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x, ' ' || chr(9) || chr(13))) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(nullif(regexp_extract(text, '\\[Page ([0-9]+)\\]', 1), ''), 'unknown') AS page,
  coalesce(list_filter(lines, lambda x: (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND regexp_full_match(x, '[ -~]*') AND length(x) BETWEEN 4 AND 79) OR regexp_matches(x, '^[0-9][^.]{0,8}\\.'))[1], '') AS section FROM l""")
def chunk_meta(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", K.page(F.col("text")).alias("page"), K.section(F.col("text")).alias("section"))


@query("rag_enrich", f"""WITH {BM25} SELECT doc_id, score, filename, category, left(text, 200) AS excerpt FROM bm LEFT JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def rag_enrich(spark, d):
    """Late materialisation: the texts of the best rows only."""
    top = keyword(spark, d, 20)
    return top.join(table(spark, d, "documents"), "doc_id", "left").select("doc_id", "score", "filename", "category", F.left("text", F.lit(200)).alias("excerpt"))


@query("dedup_sources", f"""WITH {BM25} SELECT file_path, doc_id, score FROM (SELECT coalesce(file_path, 'doc ' || doc_id) AS file_path, doc_id, score, row_number() OVER (PARTITION BY coalesce(file_path, 'doc ' || doc_id) ORDER BY score DESC, doc_id) AS rn FROM bm JOIN documents USING (doc_id)) WHERE rn = 1""")
def dedup_sources(spark, d):
    path = F.coalesce("file_path", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    rows = keyword(spark, d).join(table(spark, d, "documents").select("doc_id", "file_path"), "doc_id").withColumn("file_path", path)
    first = Window.partitionBy("file_path").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("file_path", "doc_id", "score")


@query("rag_context", f"""WITH {BM25} SELECT string_agg('[Source ' || r || ' - Page ' || coalesce(nullif(regexp_extract(text, '\\[Page ([0-9]+)\\]', 1), ''), 'unknown') || ']' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY r) AS context FROM rb JOIN documents USING (doc_id) WHERE r <= 5""")
def rag_context(spark, d):
    top = texts_of(spark, d, U.ranked(keyword(spark, d, 5)))
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" - Page "), K.page(F.col("text")), F.lit("]\n"), F.col("text"), F.lit("\n"))
    # five rows
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return top.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n---\n").alias("context"))


@query("rag_confidence", f"WITH {BM25} SELECT round(avg(score), 2) AS confidence FROM rv WHERE r <= 3")
def rag_confidence(spark, d):
    return nearest(spark, d, 3).agg(F.round(F.avg("score"), 2).alias("confidence"))
