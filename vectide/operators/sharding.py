"""Placing rows in shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_shard(column: str, n: int) -> Column:
    """The engine's own placement, in the JVM."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _folded(column: str, n: int, start: int, step) -> Column:
    """h modulo n of a 64-bit hash that takes in one byte after the other, all texts of a batch at once: step(h, bytes)."""

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        texts = pa.array(ids, pa.string()).fill_null("").cast(pa.binary())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        size, h = np.diff(at), np.full(len(texts), start, np.uint64)
        for i in range(int(size.max(initial=0))):
            rows = np.nonzero(size > i)[0]
            h[rows] = step(h[rows], data[at[rows] + i].astype(np.uint64))
        return pd.Series(np.where(ids.isna(), 0, (h % np.uint64(n)).astype(np.int64)), dtype="int32")

    return shard(column)


def djb2(column: str, n: int) -> Column:
    """Placement by the 64-bit hash h = 33 h + byte from 5381, for exchange with systems that use it. Null: shard 0."""
    return _folded(column, n, 5381, lambda h, b: h * np.uint64(33) + b)


def fnv1a(column: str, n: int) -> Column:
    """Placement by the 64-bit FNV-1a hash. Null: shard 0."""
    return _folded(column, n, 0xCBF29CE484222325, lambda h, b: (h ^ b) * np.uint64(0x100000001B3))


def range_shard(df: DataFrame, column: str, n: int) -> DataFrame:
    """Shards of equal size along the order of a unique key, sizes differing by at most one, the larger ones first.

    Ranks come from the counts of range partitions, so that no task sorts the whole table.
    """
    parts = df.repartitionByRange(F.col(column)).select("*", F.spark_partition_id().alias("part"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    # one row per partition
    before = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(column))).join(F.broadcast(before), "part")
    at, small, more = F.col("start") + F.col("r") - 1, F.floor(F.col("total") / n), F.col("total") % n
    shard = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return ranked.select(*df.columns, shard.cast("int").alias("shard"))


def balance(df: DataFrame, shard: str, tolerance: float = 0.1) -> DataFrame:
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    spread = (F.max("n") - F.min("n")) / F.avg("n")
    return sizes.agg(F.count(F.lit(1)).alias("shards"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(spread, 6).alias("imbalance"), (spread <= tolerance).alias("balanced"))
