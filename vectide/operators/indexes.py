"""Approximate indexes of vectors (id, values) as tables, searched for many queries at once.

Training reads a bounded sample (`sample` rows by hash of the id, a parameter); every row is indexed. Buckets have no
cap: a bucket's rows and queries meet in a grid of groups, whose number follows its size.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vectors as V
from vectide.operators.search import best_of, grid, matrix, pair_schema, scorer
from vectide.session import durable

SAMPLE = 20_000


def training_rows(df: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    rows = df.where("values is not null").orderBy(F.xxhash64("id")).limit(sample).select("values").toPandas()["values"]
    return np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Lloyd's rounds from k-means++ seeds, on a bounded sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = near / near.sum() if near.sum() > 0 else None
        centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        sums = np.stack([np.bincount(own, x[:, i], k) for i in range(x.shape[1])], 1)
        n = np.bincount(own, minlength=k)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.abs(new - centres).max() < 1e-4:
            break
        centres = new
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


class Ivf:
    """Inverted file: rows with the number of their nearest centroid. Rows can be added and removed; the centroids stay."""

    def __init__(self, rows: DataFrame, centres: np.ndarray) -> None:
        self.rows, self.centres = rows, centres

    def add(self, df: DataFrame) -> Ivf:
        return Ivf(self.rows.unionByName(_assign(df.select("id", "values"), self.centres, 1, "cluster")), self.centres)

    def remove(self, ids: DataFrame) -> Ivf:
        return Ivf(self.rows.join(ids.select("id"), "id", "left_anti"), self.centres)

    def update(self, df: DataFrame) -> Ivf:
        """Rows whose ids are there get new vectors; others are not added."""
        known = df.select("id", "values").join(self.rows.select("id"), "id", "left_semi")
        return self.remove(known).add(known)

    def contains(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").distinct().join(self.rows.select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def _assign(df: DataFrame, centres: np.ndarray, n: int, name: str) -> DataFrame:
    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        good = [i for i, x in enumerate(v) if x is not None and len(x) == centres.shape[1]]
        out: list = [[] for _ in v]
        if good:
            for i, c in zip(good, nearest(np.stack([v.iloc[i] for i in good]).astype(float), centres, n).tolist()):
                out[i] = c
        return pd.Series(out)

    return df.withColumn(name, F.explode(near("values")))


def ivf_build(df: DataFrame, clusters: int = 1000, seed: int = 100, sample: int = SAMPLE) -> Ivf:
    x = training_rows(df, sample)
    centres = kmeans(x, clusters, seed) if len(x) else np.zeros((1, 1))
    return Ivf(_assign(df.select("id", "values"), centres, 1, "cluster"), centres)


def ivf_search(index: Ivf, queries: DataFrame, k: int, probes: int = 10, metric: str = "cosine") -> DataFrame:
    """Queries meet only the rows of their nearest clusters, in a grid of blocks per cluster."""
    asked = _assign(queries.select("id", "values"), index.centres, min(probes, len(index.centres)), "cluster")
    return best_of(grid(index.rows, asked, ["cluster"], k, scorer(metric)), k)


def lsh_buckets(df: DataFrame, dim: int, tables: int = 10, projections: int = 4, width: float = 1.0, seed: int = 100) -> DataFrame:
    """(id, values, table, bucket): floor((a.x + b) / width) of each table's projections."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(tables, projections, dim)), rng.random((tables, projections)) * width

    @F.pandas_udf("array<string>")
    def buckets(v: pd.Series) -> pd.Series:
        good = [i for i, x in enumerate(v) if x is not None and len(x) == dim]
        out: list = [[] for _ in v]
        if good:
            x = np.stack([v.iloc[i] for i in good]).astype(float)
            cells = np.floor((np.einsum("tpd,nd->ntp", a, x) + b) / width).astype(int)
            for i, row in zip(good, cells):
                out[i] = [",".join(map(str, t)) for t in row]
        return pd.Series(out)

    return df.select("id", "values", F.posexplode(buckets("values")).alias("table", "bucket"))


def lsh_search(buckets: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Queries meet the rows of their buckets; a pair met in several tables counts once."""
    asked = buckets.join(queries.select("id"), "id", "left_semi")
    return best_of(grid(buckets, asked, ["table", "bucket"], k, scorer(metric)).distinct(), k)


# Product quantisation


class Codebooks:
    """Centroids of each subspace of width sub, after a rotation."""

    def __init__(self, books: list[np.ndarray], rotation: np.ndarray) -> None:
        self.books, self.rotation = books, rotation

    @property
    def sub(self) -> int:
        return self.books[0].shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = x @ self.rotation
        return np.stack([nearest(x[:, i * self.sub : (i + 1) * self.sub], b, 1)[:, 0] for i, b in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace (queries, centroids): squared distances of the parts of the queries."""
        q = q @ self.rotation
        parts = [q[:, i * self.sub : (i + 1) * self.sub] for i in range(len(self.books))]
        return [((p * p).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * p @ b.T) for p, b in zip(parts, self.books)]


def pq_train(df: DataFrame, sub: int = 8, centroids: int = 256, seed: int = 100, sample: int = SAMPLE, rotate: bool = False) -> Codebooks:
    """rotate: principal axes first, dealt to the subspaces in turn so that each has its part of the variance."""
    x = training_rows(df, sample)
    dim = x.shape[1]
    rotation = np.eye(dim)
    if rotate:
        axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
        rotation = axes[:, np.argsort(np.arange(dim) % (dim // sub), kind="stable")]
        x = x @ rotation
    return Codebooks([kmeans(x[:, i : i + sub], min(centroids, max(1, len(x) // 2)), seed + i, 10) for i in range(0, dim, sub)], rotation)


def pq_encode(df: DataFrame, books: Codebooks) -> DataFrame:
    """(id, values, codes)."""

    @F.pandas_udf("array<short>")
    def codes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(books.encode(np.stack(v.to_numpy()).astype(float)).astype(np.int16)))

    return df.where(F.size("values") == books.rotation.shape[0]).select("id", "values", codes("values").alias("codes"))


def pq_search(encoded: DataFrame, queries: DataFrame, k: int, books: Codebooks, refine: int = 10) -> DataFrame:
    """Table lookups give k x refine candidates per query and group; the survivors are reranked by exact distance."""
    keep = k * refine
    sent = encoded.sparkSession.sparkContext.broadcast(books)

    def make(q: np.ndarray, column):
        tables = sent.value.tables(q)
        usable, codes = matrix(column, len(tables))
        codes = codes.astype(np.int64)
        return usable, lambda a, b: -sum(t[:, codes[a:b, i]] for i, t in enumerate(tables))

    one = F.lit(0).alias("key")
    rough = grid(encoded.select("id", "codes", one), queries.select("id", "values", one), ["key"], keep, make, column="codes")
    few = best_of(rough, keep).select("query_id", "id")
    exact = few.join(encoded.select("id", "values"), "id").join(queries.select(F.col("id").alias("query_id"), F.col("values").alias("q")), "query_id")
    scored = exact.select("query_id", "id", F.round(V.similarity_of_distance(V.euclidean(F.col("q"), F.col("values"))), 6).alias("similarity"))
    return best_of(scored, k)


# Graph


class Hnsw:
    """Navigable graphs of parts of the rows, built once and kept: (part, graph), and the centre of each part."""

    def __init__(self, graphs: DataFrame, centres: np.ndarray, salts: int) -> None:
        self.graphs, self.centres, self.salts = graphs, centres, salts


def hnsw_build(df: DataFrame, m: int = 16, rows_per_graph: int = 5000, seed: int = 100, sample: int = SAMPLE) -> Hnsw:
    """A part is a cluster of neighbours, cut by hash where it holds more than rows_per_graph rows."""
    x = training_rows(df, sample)
    n = df.where("values is not null").count()
    centres = kmeans(x, max(1, round(n / rows_per_graph)), seed) if len(x) else np.zeros((1, 1))
    rows = _assign(df.select("id", "values"), centres, 1, "cluster")
    # a row per cluster
    most = rows.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(most / (2 * rows_per_graph)))
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("graph", T.BinaryType())])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["values"].to_numpy()).astype(np.float32)
        graph = Graph(x, m, seed)
        return pd.DataFrame({"cluster": [group["cluster"].iloc[0]], "salt": [group["salt"].iloc[0]], "graph": [pickle.dumps((group["id"].to_numpy(), graph))]})

    parts = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return Hnsw(durable(parts.groupBy("cluster", "salt").applyInPandas(build, schema)), centres, salts)


def hnsw_search(index: Hnsw, queries: DataFrame, k: int, ef: int = 64, probes: int = 4) -> DataFrame:
    """Every query searches the graphs of its `probes` nearest parts."""
    schema = pair_schema(queries.schema["id"].dataType, "similarity")
    asked = _assign(queries.select("id", "values"), index.centres, min(probes, len(index.centres)), "cluster")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(index.salts - 1))))

    def run(graphs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        for blob in graphs["graph"]:
            ids, graph = pickle.loads(blob)
            for name, q in zip(block["id"], block["values"]):
                found += [(name, ids[i], round(1 / (1 + d), 6)) for d, i in graph.search(np.asarray(q, np.float32), ef) if ids[i] != name][:k]
        return pd.DataFrame(found, columns=schema.names)

    return best_of(index.graphs.groupBy("cluster", "salt").cogroup(asked.groupBy("cluster", "salt")).applyInPandas(run, schema), k)


class Graph:
    """Hierarchical navigable graph: a node's level is geometric; each level links a node to its m nearest of the
    candidates that a beam search finds."""

    def __init__(self, x: np.ndarray, m: int, seed: int, ef: int = 100) -> None:
        rng = np.random.default_rng(seed)
        self.x = x
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(m)).astype(int)
        self.links: list[list[list[int]]] = [[[] for _ in range(l + 1)] for l in level]
        self.entry = 0
        for i in range(1, len(x)):
            at, top = self.entry, len(self.links[self.entry]) - 1
            for l in range(top, level[i], -1):
                at = self.beam(x[i], at, 1, l)[0][1]
            for l in range(min(top, level[i]), -1, -1):
                near = self.beam(x[i], at, ef if l == 0 else m, l)
                at = near[0][1]
                chosen = [j for _, j in near[:m]]
                self.links[i][l] = chosen
                for j in chosen:
                    own = self.links[j][l]
                    own.append(i)
                    if len(own) > 2 * m:
                        d = ((x[own] - x[j]) ** 2).sum(1)
                        self.links[j][l] = [own[p] for p in np.argsort(d, kind="stable")[: 2 * m]]
            if level[i] > top:
                self.entry = i

    def beam(self, q: np.ndarray, start: int, width: int, level: int) -> list[tuple[float, int]]:
        import heapq

        d = float(((self.x[start] - q) ** 2).sum())
        seen, todo, best = {start}, [(d, start)], [(-d, start)]
        while todo:
            d, at = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            fresh = [j for j in self.links[at][level] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(((self.x[fresh] - q) ** 2).sum(1).tolist(), fresh):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, j) for d, j in best)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        at = self.entry
        for l in range(len(self.links[at]) - 1, 0, -1):
            at = self.beam(q, at, 1, l)[0][1]
        return [(d**0.5, j) for d, j in self.beam(q, at, ef, 0)]


# Catalog


class Catalog:
    """The indexes of a collection by name. An index is ready when it holds every id of the collection."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.entries: dict[str, tuple[str, DataFrame]] = {}

    def add(self, name: str, kind: str, rows: DataFrame) -> Catalog:
        if name in self.entries:
            raise ValueError(f"index {name} exists")
        self.entries[name] = (kind, rows.select("id"))
        return self

    def drop(self, name: str) -> Catalog:
        del self.entries[name]
        return self

    def listing(self, collection: DataFrame) -> DataFrame:
        """(name, kind, n, ready); n: distinct ids."""
        all_ids = collection.where("id is not null").select("id").distinct()
        out = None
        for name, (kind, rows) in self.entries.items():
            own = rows.distinct().withColumn("here", F.lit(1))
            both = all_ids.join(own, "id", "left").agg(F.count("here").alias("n"), (F.count("here") == F.count(F.lit(1))).alias("ready"))
            row = both.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n", "ready")
            out = row if out is None else out.unionByName(row)
        return self.spark.createDataFrame([], "name string, kind string, n bigint, ready boolean") if out is None else out
