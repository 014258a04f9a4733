"""Normalising, fusing and reranking of ranked lists (doc_id, score).

A list is a short result, at most some thousand rows; ties go by doc_id everywhere. Empty lists give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

RRF_K = 60
ALPHA = 0.7
FLOOR = 0.01
TINY = 1e-9


def whole() -> WindowSpec:
    """All rows of a short list."""
    return Window.partitionBy(F.lit(0))


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """With `rank` from 1; cut to k first, so that the ranking window holds k rows."""
    order = [F.desc("score"), F.col("doc_id")]
    top = scored.orderBy(*order).limit(k) if k else scored
    return top.withColumn("rank", F.row_number().over(whole().orderBy(*order)))


def min_max(score: Column) -> Column:
    low, high = F.min(score).over(whole()), F.max(score).over(whole())
    return F.when(high - low < TINY, F.lit(1.0)).otherwise(FLOOR + (1 - FLOOR) * (score - low) / (high - low))


def z_score(score: Column) -> Column:
    sd = F.when(F.count(score).over(whole()) <= 1, F.lit(1.0)).otherwise(F.stddev_pop(score).over(whole()))
    return F.when(sd < TINY, F.lit(0.0)).otherwise((score - F.avg(score).over(whole())) / sd)


def rrf(lists: Sequence[DataFrame], k: int = RRF_K, first_rank: int = 1, weights: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, score): sum of weight / (k + rank) over the lists a document is in."""
    out = None
    for w, scored in zip(weights or [1.0] * len(lists), lists):
        part = ranked(scored).select("doc_id", (F.lit(float(w)) / (k + F.col("rank") - 1 + first_rank)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg(F.sum("part").alias("score"))


def linear(a: DataFrame, b: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, score): alpha of the first list's and the rest of the second's min-max scores; a missing one is 0."""
    alpha = alpha if 0 <= alpha <= 1 else ALPHA
    x, y = (s.select("doc_id", min_max(F.col("score")).alias(n)) for s, n in ((a, "x"), (b, "y")))
    joined = x.join(y, "doc_id", "full_outer")
    return joined.select("doc_id", (alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))).alias("score"))


def maximum(lists: Sequence[DataFrame]) -> DataFrame:
    out = lists[0].select("doc_id", "score")
    for other in lists[1:]:
        out = out.unionByName(other.select("doc_id", "score"))
    return out.groupBy("doc_id").agg(F.max("score").alias("score"))


def composite_weighted(lists: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """(doc_id, distance): one over the sum of weight / distance; the lists hold distances as scores."""
    out = None
    for w, scored in zip(weights, lists):
        part = scored.select("doc_id", (F.lit(float(w)) / (F.col("score") + 1e-6)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg((1 / F.sum("part")).alias("distance"))


def composite_mean(lists: Sequence[DataFrame]) -> DataFrame:
    out = lists[0].select("doc_id", "score")
    for other in lists[1:]:
        out = out.unionByName(other.select("doc_id", "score"))
    return out.groupBy("doc_id").agg(F.avg("score").alias("distance"))


def hybrid(vector: DataFrame, keyword: DataFrame, k: int = 10, method: str = "rrf", alpha: float = ALPHA) -> DataFrame:
    """The k best of two candidate lists, with the raw scores beside the fused one."""
    fused = rrf([vector, keyword]) if method == "rrf" else linear(vector, keyword, alpha)
    top = fused.select("doc_id", F.round("score", 6).alias("score"))
    both = top.join(vector.select("doc_id", F.col("score").alias("vector_score")), "doc_id", "left").join(keyword.select("doc_id", F.col("score").alias("keyword_score")), "doc_id", "left")
    return both.orderBy(F.desc("score"), "doc_id").limit(k)


# Reranking


def overlap_scorer(query: Column, text: Column) -> Column:
    """Default scorer: the part of the query's distinct words that the text holds."""
    from vectide.functions.words import tokens

    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def model_scorer(load):
    """A scorer by a model: load() gives it once per task, a function of lists of queries and texts to scores. A null text
    scores 0."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            known = texts.notna()
            out = pd.Series(0.0, index=texts.index)
            if known.any():
                out[known] = model(queries[known].tolist(), texts[known].tolist())
            yield out

    return score


def blend(rerank: Column, original: Column, weight: float = 0.7) -> Column:
    return weight * rerank + (1 - weight) * original


def rerank(results: DataFrame, query: Column, scorer=overlap_scorer, weight: float = 0.7, threshold: float = 0.0, k: int | None = None) -> DataFrame:
    """results: doc_id, score, text. With rerank_score and the blended score; below the threshold they are dropped.

    scorer: a function of two columns, which may be an iterator pandas UDF that loads its model once.
    """
    scored = results.withColumn("rerank_score", scorer(query, F.col("text"))).withColumn("combined", F.round(blend(F.col("rerank_score"), F.col("score"), weight), 6))
    kept = scored.where(F.col("combined") >= threshold).orderBy(F.desc("combined"), "doc_id")
    return kept.limit(k) if k else kept


def rerank_metrics(scored: DataFrame) -> DataFrame:
    """One row on a result list: population variance, spread, gap between the two best, entropy of the shares (bits)."""
    r = ranked(scored).withColumn("share", F.col("score") / F.nullif(F.sum("score").over(whole()), F.lit(0.0)))
    best = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    entropy = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log2("share")))
    return r.agg(F.var_pop("score").alias("variance"), (F.max("score") - F.min("score")).alias("spread"), F.coalesce(best(1) - best(2), F.lit(0.0)).alias("top_gap"), entropy.alias("entropy"))
