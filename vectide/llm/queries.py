"""Queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.text import normalize_query, trimmed_lower
from vectide.functions.timebuckets import DAY_MS, day_start, week_start
from vectide.llm import curve_neighbours, distinct, heavy_hitters, logtables, mixing, packing, quantiles, segments, subjects
from vectide.llm.tokens import n_tokens
from vectide.session import durable
from vectide.sources.tables import spread, table

JUDGED = 60
QUERY_TYPES = ("vector", "hybrid", "bm25", "rerank")
SMALL_JOIN_ROWS = 100_000


# Problem 1: most similar vectors


def vector_collection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, values) of products and arrow_utils, and (id, p, h) of the row that counts for each id: for arrow_utils
    that of the highest version, and none if it is deleted or its vector not usable."""
    good = curve_neighbours.usable(F.col("values"), 64)
    own = [F.col("id"), *curve_neighbours.prints(F.col("values"))]
    products = table(spark, folder, "products").where("id is not null")
    arrow = table(spark, folder, "arrow_utils").where("id is not null")
    state = (~F.coalesce("deleted", F.lit(False)) & good).alias("good")
    newest = F.struct(F.coalesce("version", F.lit(-(2**31))).alias("version"), "updated_at", "p", "h", "good")
    last = arrow.select(*own, "version", "updated_at", state).groupBy("id").agg(F.max(newest).alias("r")).where("r.good").select("id", "r.p", "r.h")
    current = products.where(good).select(*own).distinct().unionByName(last)
    return products.select("id", "values").unionByName(arrow.select("id", "values")), current


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of every vector, however similar they are."""
    vectors, current = vector_collection(spark, folder)
    return curve_neighbours.most_similar(vectors, k=5, current=current, n_curves=6, window=1000)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similarity 0.85 or more of which one is among the other's 5 most similar."""
    vectors, current = vector_collection(spark, folder)
    near = curve_neighbours.most_similar(vectors, k=5, min_similarity=0.85, current=current)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# Problem 2: percentiles


def log_times(spark: SparkSession, folder: str) -> DataFrame:
    """(database_id, day, metric, value): two times of each counted row, and metric 'rows' with 0 to count it."""
    rows = logtables.counted(spark, folder, "database_id", "total_time_ms", "retrieval_time_ms")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value")) for m, v in (("total", F.col("total_time_ms")), ("retrieval", F.col("retrieval_time_ms")), ("rows", F.lit(0)))])
    return rows.select("database_id", day_start(F.col("timestamp")).alias("day"), F.inline(each))


def rolled_up(daily: DataFrame) -> DataFrame:
    """Each daily row for its day and week, of its database and of all."""
    day, week, one = F.col("day"), week_start(F.col("day")), F.col("database_id")
    each = [F.struct(d.alias("db"), F.lit(b).alias("bucket_type"), t.alias("time_bucket")) for d in (one, F.lit("all")) for b, t in (("daily", day), ("weekly", week))]
    return daily.select(*[c for c in daily.columns if c not in ("database_id", "day")], F.inline(F.array(*each)))


BUCKET = ["metric", "db", "bucket_type", "time_bucket"]


def log_percentiles(spark: SparkSession, folder: str, probabilities: tuple[float, ...]) -> DataFrame:
    """Percentiles of both times per database and all, day and week, from digests per database and day."""
    keys = ["metric", "database_id", "day"]
    daily = quantiles.compress(quantiles.leaf_counts(log_times(spark, folder), keys, "value"), keys)
    return quantiles.percentiles(quantiles.merge(rolled_up(daily), BUCKET), BUCKET, probabilities)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and other percentiles with their certain bounds for every bucket."""
    out = log_percentiles(spark, folder, (0.5, 0.9, 0.95, 0.99))
    return out.where("metric <> 'rows'").withColumnRenamed("db", "database_id")


def ruled_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The judged stored percentiles with what the digests' bounds say of them: found (more than 20 % off), right or open."""
    asked = spark.createDataFrame([("p95_latency_ms", "total", 0.95), ("retrieval_p50_ms", "retrieval", 0.5), ("retrieval_p95_ms", "retrieval", 0.95)], "stat_name string, metric string, p double")
    other = logtables.metrics(spark, folder).where("stat_name in ('retrieval_p50_ms', 'retrieval_p95_ms') or stat_name = 'p95_latency_ms' and database_id = 'all'")
    stored = logtables.current_stats(spark, folder, "p95_latency_ms").unionByName(other).join(F.broadcast(asked), "stat_name").withColumnRenamed("database_id", "db")
    true = log_percentiles(spark, folder, (0.5, 0.95))
    keys = ["db", "bucket_type", "time_bucket"]
    judged = true.where((F.col("metric") == "rows") & (F.col("p") == 0.5) & (F.col("n") >= JUDGED)).select(*keys)
    low, high = F.col("stored") / 1.2, F.col("stored") / 0.8
    verdict = F.when((F.col("value_hi") < low) | (F.col("value_lo") > high), "found").when((F.col("value_lo") >= low) & (F.col("value_hi") <= high), "right").otherwise("open")
    return stored.join(true, [*BUCKET, "p"]).join(judged, keys, "left_semi").select("stat_name", *BUCKET, "p", "n", "stored", verdict.alias("verdict"))


def p2_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the judged figures the digests decide, and how many they leave to a count of the rows."""
    return ruled_figures(spark, folder).groupBy("stat_name", "verdict").agg(F.count(F.lit(1)).alias("n_figures"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored percentiles that are more than 20 % off. The digests' bounds decide; a figure that the bounds leave
    open is decided by counting the rows below and above the two limits, without sorting them."""
    ruled = durable(ruled_figures(spark, folder).where("verdict <> 'right'"))
    low, high = F.col("stored") / 1.2, F.col("stored") / 0.8
    found, doubtful = ruled.where("verdict = 'found'"), ruled.where("verdict = 'open'")
    n_doubtful = doubtful.count()
    if n_doubtful:
        few = F.broadcast(doubtful) if n_doubtful <= SMALL_JOIN_ROWS else doubtful
        values = rolled_up(log_times(spark, folder).where("value >= 0")).join(few, BUCKET)
        sums = values.groupBy("stat_name", *BUCKET, "p", "n", "stored").agg(F.count_if(F.col("value") < low).alias("under"), F.count_if(F.col("value") <= high).alias("upto"))
        rank = F.greatest(F.ceil(F.col("p") * F.col("n") - 1e-9), F.lit(1))
        found = found.unionByName(sums.where((F.col("under") >= rank) | (F.col("upto") < rank)).select(*[c for c in ruled.columns if c != "verdict"], F.lit("found").alias("verdict")))
    return found.select("stat_name", F.col("db").alias("database_id"), "bucket_type", "time_bucket").distinct()


# Problem 3: frequent texts


def frequent_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the log, one per counted row, and of search_patterns, weighted, as hash-partitioned streams."""
    log = logtables.counted(spark, folder, "query_text").select(F.lit("log").alias("scope"), week_start(F.col("timestamp")).alias("time_bucket"), normalize_query(F.col("query_text")).alias("text"), F.lit(1).cast("long").alias("w"))
    own = table(spark, folder, "search_patterns").where("first_seen is not null").withColumn("time_bucket", week_start(F.col("first_seen")))
    last = own.groupBy("database_id", "normalized_text", "time_bucket").agg(F.max(F.struct("updated_at", "id", "query_count")).alias("r"))
    patterns = last.select(F.lit("patterns").alias("scope"), "time_bucket", F.col("normalized_text").alias("text"), F.col("r.query_count").alias("w"))
    return heavy_hitters.streams(log.where("text <> ''").unionByName(patterns), ["scope", "time_bucket"], "text", "w")


def frequent_texts(spark: SparkSession, folder: str, share: float = 0.005) -> DataFrame:
    keys = ["scope", "time_bucket"]
    stream = frequent_streams(spark, folder)
    return heavy_hitters.verified(stream, heavy_hitters.candidates(stream, keys, share), keys, share)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with at least 0.5 % of a week."""
    return frequent_texts(spark, folder).select("scope", "time_bucket", F.col("item").alias("normalized_text"))


def p3_frequent(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate counts of the frequent texts as the sketches give them, with their exact counts beside them."""
    return frequent_texts(spark, folder).withColumnRenamed("item", "normalized_text")


# Problem 4: distinct counts


def identifier_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Users, sessions and queries (the counted rows) by database and week, with a bit per day and query type."""
    log = table(spark, folder, "query_log").where("timestamp is not null")

    def cleaned(name: str):
        c = trimmed_lower(F.col(name))
        return F.when((c != "") & (c != "anonymous"), c)

    day = F.pmod(F.floor(F.col("timestamp") / DAY_MS) + 3, F.lit(7)).cast("int")
    number = F.coalesce(*[F.when(F.col("query_type") == t, F.lit(i)) for i, t in enumerate(QUERY_TYPES)], F.lit(len(QUERY_TYPES)))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), i.alias("identifier")) for k, i in (("user", cleaned("user_id")), ("session", cleaned("session_id")), ("query", logtables.query_key()))])
    rows = log.select("database_id", week_start(F.col("timestamp")).alias("week"), (day * (len(QUERY_TYPES) + 1) + number).alias("slot"), F.inline(each))
    return distinct.pairs(rows, "kind", "identifier", "database_id", "week", "slot")


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, database_id, bucket_type, time_bucket, query_type, n) for every database and all, day and week, each as a
    whole (query_type '') and by query type."""
    own = identifier_pairs(spark, folder)
    types = [*QUERY_TYPES, "other"]
    width = len(types)
    days = {f"{d}|": [d * width + t for t in range(width)] for d in range(7)}
    by_type = {f"{d}|{name}": [d * width + t] for d in range(7) for t, name in enumerate(types)} | {f"w|{name}": [d * width + t for d in range(7)] for t, name in enumerate(types)}
    both = distinct.counts(distinct.with_all_groups(own), {"w|": None} | days | by_type)
    when, kind = F.split_part("slice", F.lit("|"), F.lit(1)), F.split_part("slice", F.lit("|"), F.lit(2))
    return both.select(
        "kind", F.col("grp").alias("database_id"), F.when(when == "w", "weekly").otherwise("daily").alias("bucket_type"),
        (F.col("period") + F.coalesce(F.expr("try_cast(split_part(slice, '|', 1) as bigint)"), F.lit(0)) * DAY_MS).alias("time_bucket"), kind.alias("query_type"), "n",
    )


def p4_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Exact distinct users and sessions of every bucket."""
    return distinct_counts(spark, folder).where("kind <> 'query'").withColumnRenamed("n", "n_distinct")


def p4_group_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Exact distinct users and sessions of every week over sets of databases taken together."""
    support = F.contains("grp", F.lit("support"))
    sets = distinct.with_groups(identifier_pairs(spark, folder), {"set: support": support, "set: other": ~support})
    counted = distinct.counts(sets.where("grp like 'set: %'"), {"week": None})
    return counted.where("kind <> 'query'").select("kind", F.substr("grp", F.lit(6)).alias("databases"), F.col("period").alias("time_bucket"), F.col("n").alias("n_distinct"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored distinct counts that are more than 15 % off."""
    keys = ["database_id", "bucket_type", "time_bucket", "query_type"]
    found = distinct_counts(spark, folder).groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("user", "session", "query")])
    name = F.col("stat_name")
    other = logtables.metrics(spark, folder).where("database_id = 'all' and (stat_name = 'unique_sessions' or stat_name like 'unique_users%')")
    stored = logtables.current_stats(spark, folder, "unique_users", "unique_sessions").unionByName(other)
    stored = stored.withColumn("query_type", F.when(name.startswith("unique_users_"), F.substr(name, F.lit(14))).otherwise(""))
    stored = stored.where(F.col("query_type").isin("", *QUERY_TYPES))
    true = F.when(name == "unique_sessions", F.col("session")).otherwise(F.col("user"))
    off = stored.join(found, keys).where((F.col("query") >= JUDGED) & (F.abs(F.col("stored") - true) > 0.15 * true))
    return off.select("stat_name", "database_id", "bucket_type", "time_bucket").distinct()


# Problem 5: oversized documents


def size_limit(spark: SparkSession, folder: str, profile: str) -> tuple[int, int]:
    """Size and overlap of a profile of size_limits (5 rows)."""
    row = table(spark, folder, "size_limits").where(F.col("profile") == profile).first()
    return row["max_size"], row["overlap"]


def current_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, status, chunk_count) of the upload of each file_path that is the latest (ties: larger doc_id); a null
    path stands alone."""
    own = table(spark, folder, "documents")
    path = F.coalesce(F.concat(F.lit("p"), "file_path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return own.groupBy(path.alias("path")).agg(F.max(F.struct("uploaded_at", "doc_id", "status", "chunk_count")).alias("r")).select("r.doc_id", "r.status", "r.chunk_count")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Where each current document is cut: offsets, boundary and counts of its pieces."""
    limit, overlap = size_limit(spark, folder, "chunk")
    cut = segments.pieces(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", limit, overlap)
    return cut.join(current_documents(spark, folder).select("doc_id"), "doc_id", "left_semi")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current documents that must be split, that have a stretch without boundary, or that count too few chunks."""
    limit, overlap = size_limit(spark, folder, "chunk")
    cut = segments.pieces(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", limit, overlap).where("piece = 0")
    both = cut.select("doc_id", "n_pieces", "length", "unbroken").join(current_documents(spark, folder), "doc_id")
    least = F.when(F.col("n_pieces") == 1, F.lit(1)).otherwise(F.ceil((F.col("length") - overlap) / (limit - overlap)))
    findings = {"must_split": F.col("n_pieces") > 1, "no_boundary": F.col("unbroken") > limit, "undercount": (F.col("status") == "complete") & (F.col("chunk_count") < least)}
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in findings.items()]))
    return both.select("doc_id", F.explode(named).alias("finding"))


# Problem 6: containers


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): cluster is that of documents with the same words."""
    own = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    words = F.lower(F.btrim(F.regexp_replace("text", r"\s+", " ")))
    return own.select("doc_id", trimmed_lower(F.col("source")).alias("source"), F.hex(F.xxhash64(words)).alias("cluster"), n_tokens(F.col("text")).alias("n_tokens"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the containers; no container holds two copies of one text."""
    capacity, _ = size_limit(spark, folder, "container")
    return packing.pack(sized_documents(spark, folder), "doc_id", "n_tokens", capacity, "source", "cluster")


#: Sources whose documents the conflict query keeps apart: what customers wrote from what the company publishes.
APART = (("chat_export", "policies"), ("tickets", "policies"))


def p6_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Containers in which no document of a source meets one of a source it is kept apart from."""
    capacity, _ = size_limit(spark, folder, "container")
    return packing.pack(sized_documents(spark, folder), "doc_id", "n_tokens", capacity, "source", "cluster", apart=APART)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing cut."""
    return p6_containers(spark, folder).where("n_parts > 1").select(F.col("item_id").alias("doc_id")).distinct()


# Problem 7: mixes


def mixes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(sized_documents(spark, folder).select("doc_id", "source", "n_tokens"), table(spark, folder, "mix_targets"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """How often each mix uses each document."""
    return mixes(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached."""
    return mixes(spark, folder)[1]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that stay below their target in the mix although it uses every document max_uses times."""
    exhausted = F.col("tokens") == F.col("available") * F.col("max_uses")
    return p7_report(spark, folder).where(exhausted & (F.col("tokens") < F.col("wanted"))).select("mix_id", "source")


# Problem 8: subjects


def subject_model(spark: SparkSession, folder: str) -> tuple[DataFrame, subjects.Model | None]:
    """The documents' sentences, and the model fitted on them."""
    bags = subjects.bags(spread(table(spark, folder, "documents").select("doc_id", "text")))
    names = [r["subject"] for r in table(spark, folder, "subject_areas").select("subject").distinct().collect()]
    return bags, subjects.fit(bags, table(spark, folder, "doc_labels"), names)


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of each document with the part of its sentences that are about them."""
    return subjects.assign(*subject_model(spark, folder))


def p8_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How well the posteriors agree with labels that the model has not seen."""
    return subjects.reliability(subject_model(spark, folder)[1], spark)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects that at least a quarter of a document's sentences are about."""
    return p8_subjects(spark, folder).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents and characters (a document with two subjects counts in both)."""
    sizes = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    return p8_subjects(spark, folder).join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("characters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_verdicts": p2_verdicts,
    "p3_found": p3_found,
    "p3_frequent": p3_frequent,
    "p4_found": p4_found,
    "p4_distinct": p4_distinct,
    "p4_group_sets": p4_group_sets,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_conflicts": p6_conflicts,
    "p7_found": p7_found,
    "p7_selection": p7_selection,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
    "p8_composition": p8_composition,
    "p8_calibration": p8_calibration,
}
