"""Similarity search: scan, filter, score, threshold, top-k, as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vectors as V


@dataclass(frozen=True)
class SearchOptions:
    """One request. Names of metadata columns are those of the records table."""

    top_k: int = 10
    threshold: float = 0.0
    metric: str = "cosine"
    tags: tuple[str, ...] = ()
    owner: str = ""
    category: str = ""
    min_score: float = 0.0
    max_score: float = 1.0
    extra: Column | None = None
    keep: tuple[str, ...] = field(default=())

    def validate(self) -> None:
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if not all(0 <= x <= 1 for x in (self.threshold, self.min_score, self.max_score)):
            raise ValueError("threshold, min_score and max_score must lie in [0, 1]")
        if self.min_score > self.max_score:
            raise ValueError("min_score exceeds max_score")
        if self.metric not in V.METRICS:
            raise ValueError(f"unknown metric {self.metric}")


def metadata_predicate(o: SearchOptions) -> Column | None:
    """Any of the tags, equal owner and category, score within bounds; None where nothing is asked."""
    parts = []
    if o.owner:
        parts.append(F.col("owner") == o.owner)
    if o.category:
        parts.append(F.col("category") == o.category)
    if (o.min_score, o.max_score) != (0.0, 1.0):
        parts.append(F.col("score").between(o.min_score, o.max_score))
    if o.tags:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, o.tags))))
    if o.extra is not None:
        parts.append(o.extra)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def parse_filters(raw: dict[str, str]) -> dict:
    """Owner, category and comma-separated tags of a wire request, as SearchOptions arguments."""
    out = {k: raw[k] for k in ("owner", "category") if raw.get(k)}
    if raw.get("tags"):
        out["tags"] = tuple(t.strip() for t in raw["tags"].split(",") if t.strip())
    return out


def score(df: DataFrame, query: Sequence[float], values: str = "values", metric: str = "cosine") -> DataFrame:
    """df with `similarity` to the query; rows of another dimension are left out. Rounded to 6 digits, so that ties
    are the same on every engine."""
    similarity = V.METRICS[metric](F.col(values), V.literal(query))
    return df.where(F.size(values) == len(query)).withColumn("similarity", F.round(similarity, 6))


def search(df: DataFrame, query: Sequence[float], options: SearchOptions = SearchOptions(), id_column: str = "id", values: str = "values") -> DataFrame:
    """The top_k rows by similarity, ties by id: a bounded heap in each task and one merge."""
    options.validate()
    wanted = metadata_predicate(options)
    rows = df if wanted is None else df.where(wanted)
    scored = score(rows, query, values, options.metric).where(F.col("similarity") >= options.threshold)
    return scored.select(id_column, "similarity", *options.keep).orderBy(F.desc("similarity"), id_column).limit(options.top_k)


def range_search(df: DataFrame, query: Sequence[float], threshold: float, id_column: str = "id", values: str = "values", metric: str = "cosine") -> DataFrame:
    return score(df, query, values, metric).where(F.col("similarity") >= threshold).select(id_column, "similarity")


def sharded(df: DataFrame, query: Sequence[float], k: int, shard: Column, id_column: str = "id", values: str = "values") -> DataFrame:
    """Top k of each shard, then the best k of these: no shard sends more than k rows."""
    own = Window.partitionBy("shard").orderBy(F.desc("similarity"), id_column)
    best = score(df, query, values).withColumn("shard", shard).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)
    return best.select(id_column, "shard", "similarity").orderBy(F.desc("similarity"), id_column).limit(k)


#: Queries, and rows, that one task compares at once.
BLOCK, ROWS = 4096, 50_000


def pair_schema(id_type: T.DataType, score: str) -> T.StructType:
    return T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField(score, T.DoubleType())])


def similarities(q: np.ndarray, x: np.ndarray, metric) -> np.ndarray:
    """(queries, rows), rounded to 6 digits. metric: a name, or a function of two blocks."""
    if metric == "euclidean":
        d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
        return np.round(1 / (1 + np.sqrt(d)), 6)
    if metric == "cosine":
        q, x = _unit(q), _unit(x)
    elif metric != "dot":
        return np.round(metric(q, x), 6)
    return np.round(q @ x.T, 6)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def matrix(column: pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors of `dim` elements (of the first vector's where not given), and these vectors."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    size = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(size[size > 0][0]) if (size > 0).any() else 0
    own = np.nonzero(size == dim)[0]
    flat = rows.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float)
    return own, flat.reshape(-1, dim) if dim else np.zeros((0, 0))


class Best:
    """The k best rows of every query so far, ties by id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.least = k, np.full(n_queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, s: np.ndarray, ids: np.ndarray) -> None:
        if s.shape[1] > self.k:
            self.least = np.maximum(self.least, np.partition(s, -self.k, axis=1)[:, -self.k])
        j, c = np.nonzero((s >= self.least[:, None]) & (s > -np.inf))
        self.held.append((j, ids[c], s[j, c]))
        self.size += len(j)
        if self.size > 4 * self.k * len(self.least) + 100_000:
            self.held = [self.take()]
            self.size = len(self.held[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        j, ids, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -s, j))
        j, ids, s = j[order], ids[order], s[order]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < self.k
        return j[keep], ids[keep], s[keep]


def names_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that can be sorted."""
    out = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return out.astype(str) if out.dtype == object else out


def score_blocks(names: np.ndarray, q: np.ndarray, ids: np.ndarray, score, k: int | None, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, similarity) of one block of queries and rows; a query's own id is left out. score(a, b): the
    similarities to rows a to b. k: only the best; None: all that reach the threshold."""
    best, all_found = Best(len(names), k or 1), []
    own = np.isin(ids, names)
    order = np.argsort(names, kind="stable")
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        s = score(at, at + len(part))
        for c in np.nonzero(own[at : at + BLOCK])[0]:
            lo, hi = np.searchsorted(names, part[c], "left", sorter=order), np.searchsorted(names, part[c], "right", sorter=order)
            s[order[lo:hi], c] = -np.inf
        if k:
            best.offer(s, part)
        else:
            j, c = np.nonzero(s >= threshold)
            all_found.append((j, part[c], s[j, c]))
    if k:
        j, i, s = best.take()
        keep = s >= (-np.inf if threshold is None else threshold)
        return j[keep], i[keep], s[keep]
    return tuple(np.concatenate(x) for x in zip(*all_found)) if all_found else best.take()


def grid(rows: DataFrame, asked: DataFrame, keys: Sequence[str], k: int | None, make_score, column: str = "values", threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity): queries meet the rows with the same keys. rows: id, `column`, keys; asked: id, values, keys.

    Each key's rows are cut into parts of about ROWS and its queries into blocks of about BLOCK, by hash; each pair of
    part and block is one group, in which the k best of each query are found by matrix products (None: all above the
    threshold). Nothing goes through the driver; a hot key has as many groups as its rows and queries need.
    make_score(q, column of the rows) gives positions of usable rows and a function of row bounds to similarities.
    """
    names = list(keys)
    size = rows.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
    wide = asked.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    both = size.join(wide, names)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("id", column, *names).join(both, names).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", spread("blocks"))
    right = asked.select(F.col("id").alias("query_id"), F.col("values").alias("q"), *names).where("q is not null").join(both, names).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", spread("parts"))
    schema = pair_schema(rows.schema["id"].dataType, "similarity")
    arrow = T_ARROW(rows.schema["id"].dataType)

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], arrow), "id": pa.array([], arrow), "similarity": pa.array([], pa.float64())})
        if not own.num_rows or not block.num_rows:
            return empty
        at, q = matrix(block["q"])
        if not len(at):
            return empty
        asked_ids = names_of(block["query_id"])[at]
        usable, score = make_score(q, own[column])
        j, i, s = score_blocks(asked_ids, q, names_of(own["id"])[usable], score, k, threshold)
        return pa.table({"query_id": pa.array(asked_ids[j], arrow), "id": pa.array(i, arrow), "similarity": pa.array(s, pa.float64())})

    group = [*names, "part", "block"]
    # other names, as both sides know the sizes by the same columns
    right = right.select("query_id", "q", *[F.col(c).alias(f"of_{c}") for c in group])
    return left.select("id", column, *group).groupBy(*group).cogroup(right.groupBy(*[f"of_{c}" for c in group])).applyInArrow(run, schema)


def scorer(metric: str):
    """make_score of grid for vectors."""
    own = V.BLOCK_METRICS.get(metric)

    def make(q: np.ndarray, column: pa.ChunkedArray):
        usable, x = matrix(column, q.shape[1])
        return usable, lambda a, b: similarities(q, x[a:b], own or metric)

    return make


def _held(corpus: DataFrame, queries: DataFrame, k: int | None, metric: str, threshold: float | None) -> DataFrame:
    """One pass over corpus (id, values) with at most BLOCK queries, which every task holds."""
    found = queries.where("values is not null").select("id", "values").toArrow()
    id_type = corpus.schema["id"].dataType
    schema, arrow = pair_schema(id_type, "similarity"), T_ARROW(id_type)
    at, q = matrix(found["values"])
    if not len(at):
        return corpus.sparkSession.createDataFrame([], schema)
    names = names_of(found["id"])[at]
    sent, own = corpus.sparkSession.sparkContext.broadcast((names, q)), V.BLOCK_METRICS.get(metric, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for table in _tables(batches):
            usable, x = matrix(table["values"], q.shape[1])
            j, i, s = score_blocks(names, q, names_of(table["id"])[usable], lambda a, b: similarities(q, x[a:b], own), k, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(names[j], arrow), pa.array(i, arrow), pa.array(s, pa.float64())], names=schema.names)

    return corpus.select("id", "values").mapInArrow(run, schema)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _batch(corpus: DataFrame, queries: DataFrame, k: int | None, metric: str, id_column: str, values: str, threshold: float | None) -> DataFrame:
    rows, asked = (x.select(F.col(id_column).alias("id"), F.col(values).alias("values")) for x in (corpus, queries))
    if asked.limit(BLOCK + 1).count() <= BLOCK:
        return _held(rows, asked, k, metric, threshold)
    one = F.lit(0).alias("key")
    return grid(rows.select("*", one), asked.select("*", one), ["key"], k, scorer(metric), threshold=threshold)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k best of each query over all groups."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def batch_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "id", values: str = "values", threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k best rows of corpus for every query, the query's own id left out.

    Up to BLOCK queries are held by every task of one pass over the corpus; more of them meet the corpus in a grid of
    blocks (see grid). A task sends k rows per query to the merge. Null vectors and other dimensions are left out.
    """
    return best_of(_batch(corpus, queries, k, metric, id_column, values, threshold), k)


def batch_range(corpus: DataFrame, queries: DataFrame, threshold: float, metric: str = "cosine", id_column: str = "id", values: str = "values") -> DataFrame:
    """(query_id, id, similarity) of all rows that reach the threshold for a query."""
    return _batch(corpus, queries, None, metric, id_column, values, threshold)


def T_ARROW(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def recall(approximate: DataFrame, exact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: found, wanted, recall. Rows are compared by their keys."""
    a = approximate.select(*keys).distinct().withColumn("hit", F.lit(1))
    joined = exact.select(*keys).distinct().join(a, list(keys), "left")
    return joined.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.col("found") / F.nullif(F.col("wanted"), F.lit(0)))
