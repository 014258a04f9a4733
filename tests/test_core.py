"""Operators of the core on small hand-made inputs, and properties of the vector functions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import geo
from vectide.functions import vectors as V
from vectide.functions.text import normalize_query
from vectide.functions.timebuckets import day_start, week_start
from vectide.functions.words import preprocess, tokens
from vectide.operators import analytics, bm25, chunks, filters, fusion, indexes, lifecycle, quantise, search, sharding, store, validation
from vectide.operators.filters import Condition as C
from vectide.operators.filters import Group as G
from vectide.sources import importers
from vectide.sources.storage import scratch
from vectide.streaming import logs


def values(df):
    return sorted(map(tuple, df.collect()))


# Vectors


def test_metric_axioms_on_random_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(v.tolist() for v in rng.uniform(-10, 10, (3, 8))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, c array<double>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(V.euclidean(a, b).alias("ab"), V.euclidean(b, a).alias("ba"), V.euclidean(a, a).alias("aa"), V.euclidean(b, c).alias("bc"), V.euclidean(a, c).alias("ac"), V.cosine(a, b).alias("cos"), V.norm(V.normalize(a)).alias("unit")).collect()
    for r in got:
        assert r.ab >= 0 and r.ab == pytest.approx(r.ba) and r.aa == pytest.approx(0) and r.ac <= r.ab + r.bc + 1e-6
        assert -1 - 1e-12 <= r.cos <= 1 + 1e-12 and r.unit == pytest.approx(1)


def test_vector_functions_on_zero_empty_null_and_uneven_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 2.0]), (2, [], [1.0]), (3, None, [1.0]), (4, [3.0], [3.0, 4.0])], "n int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = {r.n: r for r in df.select("n", V.cosine(a, b).alias("cos"), V.euclidean(a, b).alias("d"), V.dot(a, b).alias("dot"), V.normalize(a).alias("u")).collect()}
    assert got[1].cos == 0 and got[1].u == [0, 0] and got[2].cos == 0 and got[3].cos is None
    assert got[4].d == 4 and got[4].dot == 9


def test_hash_embedding_is_deterministic_and_of_unit_length(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(V.hash_embedding(F.col("t"), 32).alias("v"))
    x, y, z = (r.v for r in df.collect())
    assert x == y != z and len(z) == 32 and sum(e * e for e in z) == pytest.approx(1)


# Search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    rows = [(i, x[i].tolist(), f"owner{i % 3}", "even" if i % 2 == 0 else "odd", (i % 10) / 10, ["hot"] if i % 5 == 0 else ["cold"]) for i in range(300)] + [(900, [1.0], "owner0", "even", 0.5, ["hot"]), (901, None, "owner0", "even", 0.5, None)]
    return x, spark.createDataFrame(rows, "id int, values array<double>, owner string, category string, score double, tags array<string>").cache()


def cos(a, b):
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def test_search_with_filters_and_threshold(corpus):
    x, df = corpus
    o = search.SearchOptions(top_k=5, threshold=0.1, category="even", owner="owner0", min_score=0.2, max_score=0.9, tags=("hot", "x"))
    got = [(r.id, r.similarity) for r in search.search(df, x[0].tolist(), o).collect()]
    own = [i for i in range(300) if i % 2 == 0 and i % 3 == 0 and i % 5 == 0 and 0.2 <= (i % 10) / 10 <= 0.9]
    assert got == sorted([(i, s) for i in own if (s := cos(x[0], x[i])) >= 0.1], key=lambda p: (-p[1], p[0]))[:5]


def test_batch_search_agrees_with_single_searches_in_any_number_of_blocks(corpus, monkeypatch):
    x, df = corpus
    for block in (4096, 2):
        monkeypatch.setattr(search, "BLOCK", block)
        got = search.batch_search(df, df.where("id % 50 = 0"), 4).collect()
        for q in range(0, 300, 50):
            want = sorted([(i, cos(x[q], x[i])) for i in range(300) if i != q], key=lambda p: (-p[1], p[0]))[:4]
            assert [(r.id, r.similarity) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_invalid_search_options():
    for bad in ({"top_k": 0}, {"threshold": 1.5}, {"min_score": 0.8, "max_score": 0.2}, {"metric": "other"}):
        with pytest.raises(ValueError):
            search.SearchOptions(**bad).validate()
    assert search.parse_filters({"owner": "me", "tags": "a, b,", "other": "x"}) == {"owner": "me", "tags": ("a", "b")}


def test_indexes_reach_their_recall(corpus):
    _, df = corpus
    df = df.where("size(values) = 16").select("id", "values")
    q = df.where("id % 20 = 0")
    exact = {m: search.batch_search(df, q, 5, metric=m) for m in ("cosine", "euclidean")}
    books = indexes.pq_train(df, sub=4, centroids=64)
    found = {
        "ivf": (indexes.ivf_search(indexes.ivf_build(df, 8), q, 5, probes=6), "cosine"), "lsh": (indexes.lsh_search(indexes.lsh_buckets(df, 16, tables=24, projections=2, width=3.0), q, 5), "cosine"),
        "pq": (indexes.pq_search(indexes.pq_encode(df, books), q, 5, books), "euclidean"), "hnsw": (indexes.hnsw_search(indexes.hnsw_build(df, rows_per_graph=150), q, 5), "euclidean"),
    }
    for name, (got, metric) in found.items():
        assert search.recall(got, exact[metric], ["query_id", "id"]).first().recall >= 0.9, name


# Filters


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        ("vector_1", "finance", 0.95, ["banking", "investment"], '{"region": "north_america", "n": 5}'), ("vector_2", "technology", 0.75, ["ai", "ml"], '{"region": "europe", "n": "x"}'),
        ("vector_3", "finance", 0.82, ["trading", "cryptocurrency"], '{"region": "north_america"}'), ("vector_4", "healthcare", 0.65, ["research", "clinical"], "broken"), ("vector_5", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id string, category string, score double, tags array<string>, custom string")


@pytest.mark.parametrize("f, want", [
    (C("category", "EQUALS", "finance"), "13"), (C("category", "NOT_EQUALS", "finance"), "245"), (C("score", "GREATER_THAN_OR_EQUAL", 0.8), "13"), (C("score", "LESS_THAN", "x"), ""),
    (C("tags", "IN", values=("ai", "research")), "24"), (C("tags", "NOT_IN", values=("ai", "research")), "135"), (C("tags", "CONTAINS_ALL", values=("ai", "ml")), "2"), (C("tags", "CONTAINS", "ml"), "2"),
    (C("category", "EXISTS"), "1234"), (C("tags", "NOT_EXISTS"), "5"), (C("nothing", "EXISTS"), ""), (C("nothing", "EQUALS", ""), "12345"), (C("custom.region", "EQUALS", "europe"), "2"),
    (C("metadata.custom.n", "GREATER_THAN", 1), "1"), (C("id", "MATCHES_REGEX", "vector_[12]"), "12"), (C("id", "MATCHES_REGEX", "vector"), ""), (C("id", "MATCHES_REGEX", "("), ""),
    (G("AND", (C("category", "EQUALS", "finance"), C("score", "GREATER_THAN_OR_EQUAL", 0.9))), "1"), (G("OR", (C("category", "EQUALS", "healthcare"), G("AND", (C("score", "LESS_THAN", 0.8), C("tags", "CONTAINS", "ai"))))), "24"),
    (G("AND", ()), "12345"), (filters.parse_text("category = 'finance' AND score >= 0.9 OR tags CONTAINS ml"), "12"), (filters.parse_text("category IN (finance, healthcare) AND NOT_USED = ''"), "134"),
    (filters.parse_json('{"combination": "or", "conditions": [{"field": "score", "op": ">", "value": 0.9}, {"field": "category", "op": "in", "values": ["technology"]}]}'), "12"),
])
def test_filters(four, f, want):
    assert {r.id[-1] for r in filters.apply(four, f).collect()} == set(want)


def test_invalid_filters(four):
    for bad in (C("", "EQUALS", "x"), C("a", "IN"), C("a", "EQUALS"), C("a", "LIKE", "x")):
        with pytest.raises(ValueError):
            filters.apply(four, bad)
        assert filters.apply(four, bad, strict=False).count() == 0
    for text in ("a =", "a = b AND", "(a = b", "a IN b", "a = b c"):
        with pytest.raises(ValueError):
            filters.parse_text(text)


def test_filters_reach_the_scan(spark, four):
    folder = scratch(spark, "pushed")
    four.write.parquet(folder)
    plan = filters.apply(spark.read.parquet(folder), C("score", "GREATER_THAN", 0.8))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(score,0.8)" in plan


def test_places(spark):
    df = spark.createDataFrame([("37.7749,-122.4194",), ("37.78,-122.41",), ("junk",), ("1",), (None,)], "p string")
    lat, lon = geo.parse_point(F.col("p"))
    near = lambda m: df.where(geo.within_radius(lat, lon, (37.7749, -122.4194), m)).count()
    assert near(10) == 1 and near(2000) == 2
    assert df.where(geo.within_box(lat, lon, (37.7, -122.5), (37.8, -122.4))).count() == 2


def test_times(spark):
    texts = ["2025-01-01T12:00:00Z", "2025-01-01T12:00:00", "2025-01-01 12:00:00", "2025-01-01 12:00:00.123456", "2025-01-01T14:00:00+02:00", "2025-01-01", "01/02/2025", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(filters.parse_time(F.col("t")), "MMdd HH")).collect()]
    assert got == ["0101 12"] * 5 + ["0101 00", None, None, None]


def test_text_matches(spark):
    df = spark.createDataFrame([("Quick brown Fox",), ("lazy dog",), (None,)], "t string")
    t = F.col("t")
    count = lambda c: df.where(c).count()
    assert count(filters.has_all_terms(t, "fox quick")) == 1 and count(filters.has_any_term(t, "dog fox")) == 2 and count(filters.has_phrase(t, "BROWN fox")) == 1
    assert count(filters.has_phrase(t, "BROWN", case_sensitive=True)) == 0 and count(filters.fuzzy(t, "lasy", 1)) == 1 and count(filters.fuzzy(t, "quick", 0)) == 0


# Words and keyword search


def test_tokens_and_normaliser(spark):
    df = spark.createDataFrame([("Product-A configuration, and THE setup!",), ("do you have reset  worn??",), ("",), (None,)], "t string")
    got = df.select(tokens(F.col("t")).alias("a"), normalize_query(F.col("t")).alias("b")).collect()
    assert got[0].a == ["product", "configuration", "setup"] and got[1].b == "reset worn" and got[2].a == [] and got[2].b == "" and got[3].a is None and got[3].b is None


def test_preprocessing(spark):
    df = spark.createDataFrame([("  Hello,\n  WORLD and more ",)], "t string")
    t = F.col("t")
    assert df.select(preprocess(t), preprocess(t, max_length=5), preprocess(t, max_length=5, truncate="start"), preprocess(t, max_length=5, truncate="middle")).first()[:] == ("hello world and more", "hello", " more", "helre")


def brute_bm25(docs, query):
    words = {i: bm25.query_terms(t) for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    out = {}
    for i, own in words.items():
        s = 0.0
        for q in bm25.query_terms(query):
            df, tf = sum(q in w for w in words.values()), own.count(q)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / avg))
        if s > 0:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["Product-A configuration", "brown quick brown", "the", "", "unknown"])
def test_keyword_scores_from_the_index(spark, tmp_path, query):
    docs = [("doc1", "Product-A configuration and setup procedure"), ("doc2", "Product-B installation manual"), ("doc3", "Product-A troubleshooting guide for configuration"), ("doc4", "quick brown fox, brown"), ("doc5", "")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    want = brute_bm25(docs, query)
    stored = bm25.Index(spark, str(tmp_path / "index"), "string").add(df)
    assert {r.doc_id: r.score for r in stored.score(query).collect()} == pytest.approx(want)
    assert {r.doc_id: r.score for r in bm25.score_index(bm25.inverted(df), bm25.doc_lengths(df), query).collect()} == pytest.approx(want)


@pytest.fixture(scope="module")
def lists(spark):
    a = spark.createDataFrame([("doc1", 0.9), ("doc2", 0.8), ("doc3", 0.7)], "doc_id string, score double")
    return a, spark.createDataFrame([("doc2", 5.0), ("doc3", 4.0), ("doc1", 3.0)], "doc_id string, score double")


def test_fusion(spark, lists):
    a, b = lists
    got = {r.doc_id: r.score for r in fusion.rrf([a, b]).collect()}
    assert got == pytest.approx({"doc2": 1 / 62 + 1 / 61, "doc1": 1 / 61 + 1 / 63, "doc3": 1 / 63 + 1 / 62})
    scores = spark.createDataFrame([("x", 10.0), ("y", 5.0), ("z", 2.0)], "doc_id string, score double")
    assert [r[0] for r in scores.orderBy("doc_id").select(fusion.min_max(F.col("score"))).collect()] == pytest.approx([1.0, 0.38125, 0.01])
    z = [r[0] for r in scores.select(fusion.z_score(F.col("score"))).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    same = spark.createDataFrame([("x", 5.0), ("y", 5.0)], "doc_id string, score double")
    assert {r[0] for r in same.select(fusion.min_max(F.col("score"))).collect()} == {1.0} and {r[0] for r in same.select(fusion.z_score(F.col("score"))).collect()} == {0.0}
    assert all(0 <= r.score <= 1 for r in fusion.linear(a, b, 5.0).collect())
    assert {r.doc_id: r.score for r in fusion.maximum([a, b]).collect()} == {"doc1": 3, "doc2": 5, "doc3": 4}
    empty = a.where("false")
    assert fusion.hybrid(empty, empty).count() == 0 and [r.doc_id for r in fusion.hybrid(empty, b, 2).collect()] == ["doc2", "doc3"]


def test_reranking(spark):
    df = spark.createDataFrame([("a", 0.2, "machine learning models"), ("b", 0.9, "cooking"), ("c", 0.1, "machine tools")], "doc_id string, score double, text string")
    got = fusion.rerank(df, F.lit("machine learning"), threshold=0.2).collect()
    assert [(r.doc_id, r.combined) for r in got] == [("a", 0.76), ("c", 0.38), ("b", 0.27)]
    m = fusion.rerank_metrics(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "doc_id string, score double")).first()
    assert (m.variance, m.spread, m.top_gap, m.entropy) == (0, 0, 0, 1)


# Chunks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_recursive_chunks_hold_every_word_within_the_size(text):
    pieces = chunks.split(text, 40, 8)
    assert all(0 < len(p) <= 40 for p in pieces)
    assert "".join("".join(pieces).split()).startswith("".join(text.split())[:8])
    if len(text) <= 40:
        assert pieces == ([text.strip()] if text.strip() else [])


def test_fixed_chunks_and_marks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "doc_id int, text string")
    assert values(chunks.fixed(df, "doc_id", "text", 4, 1)) == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (4, 0, "ab")]
    marks = spark.createDataFrame([("INTRODUCTION\n[Page 7]\ntext",), ("2.1 Setup\nbody",), ("plain",)], "t string")
    assert [tuple(r) for r in marks.select(chunks.page(F.col("t")), chunks.section(F.col("t"))).collect()] == [("7", "INTRODUCTION"), ("unknown", "2.1 Setup"), ("unknown", "")]


# Log analytics


@pytest.fixture(scope="module")
def log(spark):
    t0 = 1_515_024_000_000
    rows = [(i, "db", f"search query {i % 3}", "vector", 100 + 20 * i, 5, 0.5, f"u{i % 3}", f"s{i % 2}", t0 + i * 360_000, False, False) for i in range(10)]
    rows += [(10 + i, "db", "bad", "hybrid", 10, 0, 0.0, "u9", "s9", t0 + 3_700_000, True, False) for i in range(2)]
    rows += [(12 + i, "db", "no results query", "bm25", 50, 0, 0.0, "u8", "s8", t0 + 3_800_000, False, True) for i in range(3)]
    rows += [(15 + i, "db", "slow query", "vector", 2000, 3, 0.4, "u7", "s7", t0 + 3_900_000, False, None) for i in range(2)]
    return spark.createDataFrame(rows, "id int, database_id string, query_text string, query_type string, total_time_ms bigint, num_results int, avg_similarity_score double, user_id string, session_id string, timestamp bigint, has_error boolean, used_reranking boolean")


def test_statistics_of_the_log(log):
    r = analytics.statistics(log, "daily").first()
    assert (r.total_queries, r.failed_queries, r.zero_result_queries, r.unique_users, r.users_in_range, r.reranked_queries) == (17, 2, 5, 6, 6, 3)
    assert r.p50_latency_ms <= r.p95_latency_ms <= r.p99_latency_ms <= r.max_latency_ms == 2000
    assert sum(h.total_queries for h in analytics.statistics(log, "hourly").collect()) == 17


def test_reports_of_the_log(log):
    assert [(r.pattern, r.n) for r in analytics.patterns(log, 3).collect()] == [("search query 0", 4), ("no results query", 3), ("search query 1", 3), ("search query 2", 3)]
    assert analytics.slow(log).count() == 2 and [(r.pattern, r.n) for r in analytics.zero_results(log).collect()] == [("no results query", 3)]
    t0 = 1_515_024_000_000
    got = {r.pattern: r.growth for r in analytics.trending(log, t0 + 1_800_000, t0 + 3_600_000, min_growth=-100).collect()}
    assert got == {"search query 0": 0.0, "search query 1": -50.0, "search query 2": 100.0}
    reports = analytics.insights(log, t0, t0 + 7_200_000)
    assert reports["summary"].first().n == 17 and reports["trending"].first().growth == 100


def test_forecasts(spark):
    points = spark.createDataFrame([("up", float(i), 2.0 * i + 1) for i in range(9)] + [("flat", float(i), 5.0) for i in range(9)], "g string, x double, y double")
    up = {r.g: r for r in analytics.linear_fit(points, "g", "x", "y", 2.0).collect()}
    assert (up["up"].slope, up["up"].forecast, up["up"].confidence) == (2.0, 21.0, "HIGH")
    assert {r.g: r.level for r in analytics.smoothed(points, "g", "x", "y").collect()}["flat"] == pytest.approx(5)
    assert {r.g: r.trend for r in analytics.third_trend(points, "g", "x", "y").collect()} == {"up": 12.0, "flat": 0.0}


def test_buckets_of_time(spark):
    r = spark.createDataFrame([(1_515_369_601_000,), (-1,)], "t bigint").select(day_start(F.col("t")), week_start(F.col("t"))).collect()
    assert tuple(r[0]) == (1_515_369_600_000, 1_515_369_600_000) and tuple(r[1]) == (-86_400_000, -3 * 86_400_000)


# Codecs and shards


def test_codecs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(x.tolist(),) for x in rng.normal(size=(40, 12))] + [([2.0] * 12,)], "values array<double>")
    v = F.col("values")
    for r in df.select(v.alias("v"), quantise.from_int8(quantise.int8(v)).alias("d")).collect():
        step = (max(r.v) - min(r.v)) / 255
        assert all(-1e-9 <= a - b <= step + 1e-9 for a, b in zip(r.v, r.d))
    b = quantise.ranges(df, "values", 12).first()
    low, high = V.literal(b.low), V.literal(b.high)
    for r in df.select(v.alias("v"), quantise.scalar_values(quantise.scalar_codes(v, low, high), low, high).alias("d")).collect():
        assert max(abs(a - c) for a, c in zip(r.v, r.d)) <= max(h - l for h, l in zip(b.high, b.low)) / 255 + 1e-9
    cov = np.zeros((12, 12))
    for r in quantise.covariance(df, "values", 12).collect():
        cov[r.i, r.j] = cov[r.j, r.i] = r["cov"]
    assert np.allclose(cov, np.cov(np.array([r[0] for r in df.collect()]).T))


def test_shards(spark):
    df = spark.createDataFrame([(i, f"id{i}") for i in range(103)], "n int, id string")
    sizes = [r["count"] for r in sharding.range_shard(df, "n", 8).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [13] * 7 + [12]
    h = 5381
    for c in b"id7":
        h = (h * 33 + c) % 2**64
    assert df.where("n = 7").select(sharding.djb2("id", 8)).first()[0] == h % 8


# Store, imports, validation, lifecycle, streams


def test_store_states(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True), ("c", 1, False)], "id string, version int, deleted boolean")
    s = store.Store(spark, scratch(spark, "states"))
    with pytest.raises(FileNotFoundError):
        s.read()
    first = s.write(rows)
    s.compact()
    assert s.read().count() == 3 and s.read(first).count() == 4
    s.restore(first)
    assert s.read().count() == 4 and len(s.keep(1)) == 2 and len(s.snapshots()) == 1


def test_upsert_update_delete_and_differences(spark):
    schema = "id string, version int, x string"
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], schema)
    changes = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 1, "added")], schema)
    assert values(store.upsert(base, changes)) == [("a", 2, "new"), ("b", 5, "kept"), ("c", 1, "added")]
    assert values(store.update(base, changes)) == [("a", 2, "new"), ("b", 4, "late")]
    assert values(store.delete(base, changes.where("id = 'a'"))) == [("b", 5, "kept")]
    assert values(store.changed(base, changes.where("id <> 'b'")).select("id", "change")) == [("a", "updated"), ("b", "removed"), ("c", "added")]


def test_imports(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.5], '{"k": "v, \\"q\\""}'), ("b", [], None)], "id string, values array<float>, metadata string")
    importers.write_csv(df, str(tmp_path / "csv"))
    (tmp_path / "csv" / "bad.csv").write_text('id,values,metadata\nc,"[1.0, oops",\n')
    back = {r.id: r for r in importers.read_csv(spark, str(tmp_path / "csv")).collect()}
    assert back["a"]["values"] == [1.0, 2.5] and back["a"].metadata == {"k": 'v, "q"'} and back["c"]._corrupt_record == "[1.0, oops"
    assert tuple(importers.import_statistics(importers.read_csv(spark, str(tmp_path / "csv"))).first()) == (3, 1, 2, 33.3333)
    (tmp_path / "x.json").write_text('[{"id": "a", "values": [1, 2], "metadata": {"k": "v"}}, {"id": "b"}]')
    assert tuple(importers.import_statistics(importers.read_json(spark, str(tmp_path / "x.json"))).first()) == (2, 1, 1, 50.0)
    assert tuple(importers.import_statistics(df.where("false")).first()) == (0, 0, 0, 0.0)


def test_validation(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], "me", 0.5), ("", [1.0], None, 1.5), (None, None, "", None), ("d", [float("nan"), None], "x" * 200, -1.0)], "id string, values array<double>, owner string, score double")
    good, bad = validation.split_valid(df, validation.vector_errors(2))
    assert [r.id for r in good.collect()] == ["a"] and {tuple(r.errors) for r in bad.collect()} == {("no id", "dimension"), ("no id", "no values"), ("null element", "not finite")}
    rules = [validation.Rule("owner", required=True, max_length=100), validation.Rule("score", kind="FLOAT", high=1.0)]
    assert [tuple(r[0]) for r in df.select(validation.schema_errors(rules)).collect()] == [(), ("owner: missing", "score: out of range"), ("owner: missing",), ("owner: too long", "score: out of range")]


def test_lifecycle(spark):
    df = spark.createDataFrame([("u1", "q", "2018-01-01 00:00:00"), ("u2", "r", "2018-01-09 00:00:00"), (None, "s", None)], "user_id string, query_text string, t string").withColumn("t", F.to_timestamp("t"))
    keep, old = lifecycle.split_expired(df, "t", "2018-01-10", 5)
    assert keep.count() == 2 and old.count() == 1
    assert sorted(r.query_text for r in lifecycle.erase(df, ["u1"]).collect()) == ["[ERASED]", "r", "s"]


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"q{i % 180}", f"db{i % 3}", 1_515_024_000_000 + (i % 180) * 60_000, rng.randrange(500), i % 7 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id string, database_id string, timestamp bigint, total_time_ms bigint, has_error boolean")
    source = str(tmp_path / "log")
    df.repartition(4).write.parquet(source)
    logs.run_to_end(logs.hourly(logs.read_stream(spark, source, 1)), str(tmp_path / "hourly"), str(tmp_path / "c1"))
    batch = df.groupBy("database_id", (F.col("timestamp") - F.col("timestamp") % 3_600_000).alias("b")).count()
    assert values(logs.current(spark, str(tmp_path / "hourly")).select("database_id", "time_bucket", "total_queries")) == values(batch)
    logs.ingest(logs.deduplicated(logs.read_stream(spark, source, 1)), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 180


def test_export_takes_every_latest_record(spark, tmp_path):
    from datetime import datetime

    from vectide.plans.storage_queries import export_csv

    values = [[0.5] * 64, None, [], [1.0], [None, 0.0, 2.0], [float("nan"), float("inf")]]
    data = [(f"r{i}", v, 1, datetime(2024, 1, 1), "tablet", None) for i, v in enumerate(values)]
    spark.createDataFrame(data, "id string, values array<float>, version int, updated_at timestamp, category string, custom string").write.parquet(f"{tmp_path}/arrow_utils.parquet")
    assert tuple(export_csv(spark, str(tmp_path)).first()) == (6, 6)


def test_a_store_goes_on_counting_after_old_states_are_dropped(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    for i in range(5):
        s.write(spark.createDataFrame([(i,)], "id int"))
    assert len(s.keep(2)) == 3
    s.write(spark.createDataFrame([(9,)], "id int"))
    assert [r.id for r in s.read().collect()] == [9] and [n[:14] for n in s.snapshots()] == ["state-00000003", "state-00000004", "state-00000005"]
    s.keep(1)
    s.write(spark.createDataFrame([(10,)], "id int"))
    assert [r.id for r in s.read().collect()] == [10]
    assert s.verify(s.snapshots()[-1], ["id"], spark.createDataFrame([(10,)], "id int"))


def test_a_stored_index_after_changes_equals_a_new_one(spark, tmp_path):
    texts = {1: "red apple pie", 2: "green apple", 3: None, 4: "", 5: "pie pie pie crust", 6: "nothing here"}
    docs = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    index = bm25.Index(spark, str(tmp_path / "a")).add(docs({k: texts[k] for k in (1, 2, 3)})).add(docs({k: texts[k] for k in (4, 5, 6)}))
    index.update(docs({2: "apple apple pie", 7: "apple crust"})).remove(docs({6: None}))
    fresh = bm25.Index(spark, str(tmp_path / "b")).add(docs({**{k: v for k, v in texts.items() if k != 6}, 2: "apple apple pie", 7: "apple crust"}))
    for ask in ("apple pie", "crust crust", "here", "", "the"):
        a, b = ({r.doc_id: round(r.score, 9) for r in i.score(ask).collect()} for i in (index, fresh))
        assert a == b
    assert index.totals() == fresh.totals() and index.score_document("apple", 99) == 0.0 and index.score_document("apple", 7) > 0
    assert {(r.term, r.df) for r in index.frequency(["apple", "here"]).collect()} == {("apple", 3), ("here", 0)}
    assert bm25.Index(spark, str(tmp_path / "c")).score("apple").collect() == []


def test_late_rows_and_changed_hours_of_the_stream(spark, tmp_path):
    from vectide.streaming import logs

    hour, day = 3_600_000, 86_400_000
    schema = "database_id string, timestamp bigint, total_time_ms bigint, has_error boolean"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[("a", 10 * day, 5, False), ("a", 10 * day + 1, 7, True)], [("a", 10 * day + 2, 9, False), ("b", 20 * day, 1, None)], [("c", 20 * day + hour, 1, False)], [("a", 10 * day + 3, 11, False), ("b", 20 * day + 1, 3, False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        logs.run_to_end(logs.hourly(stream), out, state)
    got = {(r.database_id, r.time_bucket): (r.total_queries, r.failed_queries, r.p95_latency_ms) for r in logs.current(spark, out).collect()}
    # the row for hour 10 x 24 of the last batch is later than the watermark of three days
    assert got == {("a", 10 * day): (3, 1, 9), ("b", 20 * day): (2, 0, 3), ("c", 20 * day + hour): (1, 0, 1)}


def test_metrics_are_exposed_with_their_values(spark):
    df = spark.createDataFrame([("m", "a", 1.5), ("m", "b", None), ("k", "a", 2.0)], "name string, db string, v double")
    assert sorted(r.line for r in analytics.exposition(df, "name", {"database": "db"}, "v").collect()) == ["# TYPE k gauge", "# TYPE m gauge", 'k{database="a"} 2.000', 'm{database="a"} 1.500']


def test_many_queries_meet_the_rows_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0])], "id string, values array<double>")
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "ROWS", 60)
    got = {(r.query_id, r.rank): r.id for r in search.batch_search(df, df.where("id like 'r%'"), 3).collect()}
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    np.fill_diagonal(s, -2)
    for i, row in enumerate(np.argsort(-np.round(s, 6), axis=1, kind="stable")[:, :3]):
        assert [got[f"r{i:03d}", r] for r in (1, 2, 3)] == [f"r{j:03d}" for j in row]
    assert search.batch_search(df.where("false"), df, 3).collect() == [] and search.batch_search(df, df.where("false"), 3).collect() == []


def test_nested_values_and_paths(spark):
    df = spark.createDataFrame([('{"a": {"k": "x", "n": 3, "e": ""}, "l": ["p", 1]}',), ("broken",), (None,)], "j string")
    j = F.col("j")
    assert [r[0] for r in df.select(filters.path_exists(j, "$.a.k")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(filters.path_exists(j, "$.a.e")).collect()] == [False, False, False]
    assert [r[0] for r in df.select(filters.subpath_matches(j, "$.a", "k", '"x"') & filters.subpath_matches(j, "$.a", "n", "3")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(filters.nested_values(j, "$.l")).collect()] == [["p", "1"], [], []]
    assert [r[0] for r in df.select(filters.nested_values(j, "$.a.n")).collect()] == [["3"], [], []]


def test_texts_of_word_processor_files(spark):
    from vectide.sources import importers

    df = spark.createDataFrame([("one\ntwo & <three>",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(importers.docx_text(importers.as_docx(F.col("t")))).collect()] == ["one\ntwo & <three>", "", None]
    assert df.select(importers.docx_text(F.lit(b"no file"))).first()[0] is None


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from vectide import session as own

    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class None_:
        def isDefined(self):
            return False

    class Fake:
        sparkContext, conf = Context(), spark.conf

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: None_()})()})())
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            own.shared_folder(Fake())


def access_tables(spark, folder, users, dbs):
    spark.createDataFrame(users, "c_custkey bigint, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(dbs, "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")


def test_granted_databases_with_repeated_missing_and_negative_ids(spark, tmp_path):
    from collections import Counter

    from vectide.plans.storage_queries import rbac_check, rbac_db_perms

    rng = random.Random(5)
    users, dbs = ([(rng.choice([None, *range(-60, 140)]), rng.choice([None, 0, 1, 2, 3, 7])) for _ in range(n)] for n in (400, 150))
    access_tables(spark, tmp_path, users, dbs)
    want = {(u, d) for u, g in users for d, h in dbs if (None not in (u, d) and math.fmod(u, 50) == math.fmod(d, 50)) or (g is not None and g == h)}
    got = [tuple(r) for r in rbac_db_perms(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and len(got) > 5000
    assert {tuple(r) for r in rbac_check(spark, str(tmp_path)).collect()} == {(u, u is not None and (u, 7) in want) for u, _ in users}


def test_granted_pairs_are_not_exchanged(spark, tmp_path):
    from vectide.plans.storage_queries import rbac_db_perms

    access_tables(spark, tmp_path, [(i, i % 2) for i in range(1500)], [(i, i % 2) for i in range(200)])

    def exchanged():
        sc = spark.sparkContext
        jvm, no = sc._jvm, sc._gateway.new_array(sc._jvm.double, 0)
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, no, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = exchanged()
    rbac_db_perms(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    written = sum(n for k, n in exchanged().items() if k not in before)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1500 * 100 and written < 20_000
