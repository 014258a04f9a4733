"""Keyword search: an inverted index as tables, and BM25 scores by joins on it.

postings(term, doc_id, tf, positions), doc_stats(doc_id, doc_length), corpus_stats(n, avgdl). Index keeps the postings in
a folder, by buckets of terms: a query reads only the row groups of its terms. A hot term has as many rows as documents,
spread over files by document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.words import SEARCH_STOP_WORDS, tokens


@dataclass(frozen=True)
class Parameters:
    """Fixed values by default."""

    k1: float = 1.5
    b: float = 0.75


def query_terms(text: str, stop_words: tuple[str, ...] = SEARCH_STOP_WORDS) -> list[str]:
    """The query's tokens; repeated ones count as often as they come."""
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t and t not in stop_words]


def inverted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, positions): one shuffle, on the document and term."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    grouped = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_length): documents without tokens have length 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("doc_length"))


def corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_length").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_score(tf: Column, df: Column, length: Column, n: Column, avgdl: Column, p: Parameters = Parameters()) -> Column:
    return idf(n, df) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / avgdl))


def score_index(postings: DataFrame, lengths: DataFrame, query: str, p: Parameters = Parameters()) -> DataFrame:
    """The same from a stored index: only the postings of the query's terms are read."""
    terms = query_terms(query)
    if not terms:
        return postings.select("doc_id", F.lit(0.0).alias("score")).where("false")
    weight = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.lit(float(terms.count(t))))])
    own = postings.where(F.col("term").isin(*terms))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # df has a row per query term, the corpus statistics are one row
    joined = own.join(F.broadcast(df), "term").join(lengths, "doc_id").crossJoin(F.broadcast(corpus(lengths)))
    part = F.try_element_at(weight, F.col("term")) * term_score(F.col("tf"), F.col("df"), F.col("doc_length"), F.col("n"), F.col("avgdl"), p)
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score")).where("score > 0")


BUCKETS = 64


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


class Index:
    """A stored inverted index that documents are added to and removed from.

    Each addition is a segment with a generation of its own; removing writes the documents and the generation up to which
    they are gone. Readers see whole segments only. Ids of one segment are distinct; null ids are left out; null texts
    count as documents without tokens.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", buckets: int = BUCKETS) -> None:
        """buckets: of terms, each a folder of a segment; about a file's worth of postings each is a good number."""
        self.spark, self.folder, self.id_type, self.buckets = spark, folder.rstrip("/"), id_type, buckets
        self.generation = 0
        self.segments: list[int] = []
        self.removals: list[int] = []
        self._totals: tuple[int, float] | None = None

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        self.generation += 1
        at = f"{self.folder}/segment-{self.generation}"
        terms = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), terms.alias("terms"))
        sized = rows.select("doc_id", F.size("terms").alias("doc_length"), "terms")
        sized.select("doc_id", "doc_length").write.parquet(f"{at}/lengths")
        # one shuffle: where a file's rows are put together, they are counted as well
        place = [F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("slice")]
        each = sized.select("doc_id", "doc_length", F.explode("terms").alias("term")).select("*", *place)
        files = each.repartition(max(self.spark.sparkContext.defaultParallelism, 8), "bucket", "slice")
        posts = files.groupBy("bucket", "slice", "term", "doc_id", "doc_length").agg(F.count(F.lit(1)).cast("int").alias("tf")).drop("slice")
        posts.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        self.segments.append(self.generation)
        self._totals = None
        return self

    def remove(self, ids: DataFrame, doc_id: str = "doc_id") -> Index:
        self.generation += 1
        ids.select(F.col(doc_id).cast(self.id_type).alias("doc_id")).where("doc_id is not null").distinct().write.parquet(f"{self.folder}/removed-{self.generation}")
        self.removals.append(self.generation)
        self._totals = None
        return self

    def update(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """New texts of documents; those that are not there are added."""
        return self.remove(docs, doc_id).add(docs, doc_id, text)

    def _live(self, rows: DataFrame, generation: int) -> DataFrame:
        for g in self.removals:
            if g > generation:
                rows = rows.join(self.spark.read.parquet(f"{self.folder}/removed-{g}"), "doc_id", "left_anti")
        return rows

    def _table(self, name: str, schema: str, wanted: Column | None = None) -> DataFrame:
        out = None
        for g in self.segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/segment-{g}/{name}")
            rows = self._live(rows if wanted is None else rows.where(wanted), g)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, doc_id, tf, doc_length, bucket) of all or of some terms."""
        schema = f"doc_id {self.id_type}, doc_length int, term string, tf int, bucket int"
        wanted = None if terms is None else F.col("bucket").isin(*{bucket_of(t, self.buckets) for t in terms}) & F.col("term").isin(*terms) if terms else F.lit(False)
        return self._table("postings", schema, wanted)

    def lengths(self) -> DataFrame:
        return self._table("lengths", f"doc_id {self.id_type}, doc_length int")

    def totals(self) -> tuple[int, float]:
        """Documents and their mean length; known until the index changes."""
        if self._totals is None:
            row = corpus(self.lengths()).first()
            self._totals = (row["n"], row["avgdl"] or 0.0)
        return self._totals

    def score(self, query: str, p: Parameters = Parameters()) -> DataFrame:
        """(doc_id, score) of the documents that hold a query term, from the terms' postings alone."""
        terms = query_terms(query)
        own = self.postings(list(dict.fromkeys(terms)))
        if not terms:
            return own.select("doc_id", F.lit(0.0).alias("score"))
        n, avgdl = self.totals()
        weight = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.lit(float(terms.count(t))))])
        # a row per query term
        df = F.broadcast(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        part = F.try_element_at(weight, F.col("term")) * term_score(F.col("tf"), F.col("df"), F.col("doc_length"), F.lit(float(n)), F.lit(float(avgdl)), p)
        return own.join(df, "term").groupBy("doc_id").agg(F.sum(part).alias("score")).where("score > 0")

    def score_document(self, query: str, doc_id) -> float:
        """Of one document; 0 for one that is not there or an empty query."""
        row = self.score(query).where(F.col("doc_id") == doc_id).first()
        return row["score"] if row else 0.0

    def frequency(self, terms: Sequence[str]) -> DataFrame:
        """(term, df) of every given term, 0 for those that no document holds."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return asked.join(self.postings(list(terms)).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))

    def terms(self) -> DataFrame:
        return self.postings().select("term").distinct()

    def documents(self) -> DataFrame:
        return self.lengths().select("doc_id")
