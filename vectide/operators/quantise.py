"""Codecs of vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import doubles


def int8(v: Column) -> Column:
    """struct(low, high, codes): codes from -128 to 127, cut down; a constant vector decodes to its value."""
    x = doubles(v)
    low, high = F.array_min(x), F.array_max(x)
    code = lambda e: F.when(high == low, F.lit(-128)).otherwise((((e - low) / (high - low)) * 255.0).cast("int") - 128)
    return F.struct(low.alias("low"), high.alias("high"), F.transform(x, code).alias("codes"))


def from_int8(s: Column) -> Column:
    return F.transform(s["codes"], lambda c: s["low"] + (c + 128) / 255.0 * (s["high"] - s["low"]))


def truncate(v: Column, d: int) -> Column:
    """The first d elements."""
    return F.slice(doubles(v), 1, d)


def padded(v: Column, dim: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))


def compression(original: Column, compressed: Column) -> Column:
    """struct(ratio, saved): saved in percent; nothing stored gives (0, 0)."""
    ratio = F.when(original == 0, F.lit(0.0)).otherwise(compressed / original)
    return F.struct(ratio.alias("ratio"), F.when(original == 0, F.lit(0.0)).otherwise((1 - ratio) * 100).alias("saved"))


def ranges(df: DataFrame, values: str, dim: int) -> DataFrame:
    """One row: arrays low and high, the smallest and largest element of each dimension. One pass without exploding:
    two aggregates per dimension, combined in the map tasks."""
    each = [f(F.try_element_at(values, F.lit(i + 1)).cast("double")) for f in (F.min, F.max) for i in range(dim)]
    return df.agg(F.array(*each[:dim]).alias("low"), F.array(*each[dim:]).alias("high"))


def scalar_codes(v: Column, low: Column, high: Column, levels: int = 256) -> Column:
    """One code per dimension within its range, cut down and clamped."""
    part = F.transform(F.arrays_zip(doubles(v).alias("x"), low.alias("l"), high.alias("h")), lambda e: F.when(e["h"] == e["l"], F.lit(0.0)).otherwise((e["x"] - e["l"]) / (e["h"] - e["l"])))
    return F.transform(part, lambda p: F.least(F.greatest((p * (levels - 1)).cast("int"), F.lit(0)), F.lit(levels - 1)))


def scalar_values(codes: Column, low: Column, high: Column, levels: int = 256) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), low.alias("l"), high.alias("h")), lambda e: e["l"] + e["c"] / float(levels - 1) * (e["h"] - e["l"]))


def covariance(df: DataFrame, values: str, dim: int) -> DataFrame:
    """(i, j, cov) of the sample covariance, i <= j: sums of products per partition by matrix products, added up."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            rows = [r for r in batch.column("v").to_pylist() if r is not None and len(r) == dim and None not in r]
            if rows:
                x = np.array(rows, float)
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(s[i]), pa.array(s[j]), pa.array(p[i, j])], names=["i", "j", "n", "si", "sj", "p"])

    parts = df.select(F.col(values).alias("v")).mapInArrow(run, "i int, j int, n bigint, si double, sj double, p double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    return total.select("i", "j", ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))
