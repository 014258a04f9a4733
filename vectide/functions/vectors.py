"""Vector functions as column expressions, in double precision whatever the element type.

Null vectors give null; an empty or all-zero vector has similarity 0 to everything; elements beyond the shorter of two
vectors count as 0 for distances and products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A constant vector: a query needs no join to meet every row."""
    return F.array(*[F.lit(float(x)) for x in vector])


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    zero = F.lit(0.0)
    return F.zip_with(doubles(a), doubles(b), lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def folded(a: Column, b: Column, f) -> Column:
    """The sum of f(x, y) over the elements of two vectors."""
    return _sum(_pairs(a, b, f))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalize(v: Column) -> Column:
    size = norm(v)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / size))


def add(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def scale(v: Column, factor: float) -> Column:
    return F.transform(doubles(v), lambda x: x * F.lit(float(factor)))


def matvec(matrix: Sequence[Sequence[float]], v: Column) -> Column:
    """A constant matrix times a vector column."""
    return F.array(*[dot(literal(row), v) for row in matrix])


def similarity_of_distance(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


METRICS = {
    "cosine": cosine,
    "dot": dot,
    "euclidean": lambda a, b: similarity_of_distance(euclidean(a, b)),
}


#: The same metrics over blocks, (queries, dim) x (rows, dim) -> (queries, rows), for those registered by register_metric.
BLOCK_METRICS: dict = {}


def register_metric(name: str, column_metric, block_metric) -> None:
    """A similarity of one's own (larger is nearer): as a function of two columns, and of two blocks of vectors."""
    METRICS[name] = column_metric
    BLOCK_METRICS[name] = block_metric


def embedder(load, dim: int):
    """A function of a text column to array<double>: load() gives the model once per task, a function of a list of texts
    to an array (texts, dim). Null texts give null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts.notna().to_numpy()
            out = pd.Series([None] * len(texts), dtype=object)
            if known.any():
                vectors = np.asarray(model(texts[known].tolist()), float).reshape(-1, dim)
                for at, v in zip(np.nonzero(known)[0], vectors):
                    out.iat[at] = v
            yield out

    return embed


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """A deterministic unit vector of a text: each element from a digest of the text and its position."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(part(i), F.lit(10000.0)) / 5000.0 - 1.0))
