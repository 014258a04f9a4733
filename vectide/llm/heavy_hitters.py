"""Most frequent items of a weighted stream in bounded memory: count-min sketches with conservative update.

The values are hash-partitioned, so that all occurrences of a value meet in one stream. Map tasks first add up equal
values of some 200,000 rows, so a hot value crosses the shuffle a few times per task, not once per row. Each stream keeps,
for the group it is reading, one count-min sketch (depth x width counters, conservative update: a counter rises only
to the new estimate) and a bounded list of the candidates with the largest estimates. Streams hold disjoint values, so
their lists merge by union.

Bounds: an estimate is never below the true weight, and above it by more than e / width of the stream's weight with
probability at most exp(-depth). A value with at least `share` of a group's weight is in some list, because at most
1 / (share - e / width) values of a stream can have an estimate as large, fewer than `capacity` = 2 / share.

Null values and rows with a null group are left out; null or non-positive weights count as nothing; ties in the list go to the smaller value.
A group without values gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.batches import changes, gathered
from vectide.session import durable

SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class Sketch:
    """A count-min sketch over 64-bit hashes with conservative update of whole batches."""

    def __init__(self, width: int, depth: int) -> None:
        self.shift = np.uint64(64 - int(math.log2(width)))
        self.seeds = np.array(SEEDS[:depth], np.uint64)
        self.table = np.zeros((depth, 1 << int(math.log2(width))), np.int64)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Add distinct values; gives the new estimates. All values of the batch are raised from the state before it:
        each counter ends at the largest of the new estimates that meet in it, so it stays an upper bound."""
        h = hashes.astype(np.uint64)
        slots = [((h ^ (h >> np.uint64(29))) * s) >> self.shift for s in self.seeds]
        old = np.min([row[at] for row, at in zip(self.table, slots)], axis=0)
        new = old + weights
        for row, at in zip(self.table, slots):
            np.maximum.at(row, at, new)
        return new


def combine(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Equal (groups, item) added up over some 200,000 rows of a task at a time: (groups, item, weight)."""
    keys = [*groups, "item"]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            out = table.group_by(keys, use_threads=False).aggregate([("weight", "sum")]).rename_columns([*keys, "weight"])
            yield from out.combine_chunks().to_batches()

    return df.select(*keys, "weight").mapInArrow(run, schema)


def streams(df: DataFrame, groups: Sequence[str], item: str, weight: str | None = None) -> DataFrame:
    """(groups, item, weight, h), combined in the map tasks and hash-partitioned by item: one value, one stream. Kept, as
    the candidates and their exact counts are two readings of it."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.select(*groups, F.col(item).alias("item"), w.alias("weight")).where("item is not null and weight > 0").dropna(subset=list(groups))
    return durable(combine(rows, groups).withColumn("h", F.xxhash64("item")).repartition("h"))


def candidates(stream: DataFrame, groups: Sequence[str], share: float, width: int = 1 << 14, depth: int = 4) -> DataFrame:
    """(groups, item, estimate, total): per group the values whose estimate reaches share of the group's weight."""
    names, capacity = list(groups), math.ceil(2 / share)
    schema = T.StructType([*[stream.schema[g] for g in names], T.StructField("item", T.StringType()), T.StructField("estimate", T.LongType()), T.StructField("part", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.Table | None = None
        sketch, heap, total = Sketch(width, depth), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if head is not None:
                items = [None, *heap]
                out = head.take(pa.array([0] * len(items)))
                out = out.append_column("item", pa.array(items, pa.string())).append_column("estimate", pa.array([None, *heap.values()], pa.int64()))
                yield from out.append_column("part", pa.array([total, *[0] * len(heap)], pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = [*changes(table, names), table.num_rows]
            for a, b in zip(starts, starts[1:]):
                part = table.slice(a, b - a)
                own = part.select(names).slice(0, 1)
                if head is None or own.to_pylist() != head.to_pylist():
                    yield from flush()
                    head, heap, total = own, {}, 0
                    sketch.table[:] = 0
                added = part.select(["item", "h", "weight"]).group_by(["item", "h"], use_threads=False).aggregate([("weight", "sum")])
                weights = added["weight_sum"].to_numpy()
                new = sketch.add(added["h"].to_numpy(), weights)
                total += int(weights.sum())
                best = np.argpartition(-new, capacity)[:capacity] if len(new) > capacity else np.arange(len(new))
                heap.update(zip(added["item"].take(pa.array(best)).to_pylist(), new[best].tolist()))
                if len(heap) > capacity:
                    heap = dict(sorted(heap.items(), key=lambda x: (-x[1], x[0]))[:capacity])
        yield from flush()

    from pyspark.sql import Window

    listed = stream.sortWithinPartitions(*names).mapInArrow(run, schema)
    merged = listed.withColumn("total", F.sum("part").over(Window.partitionBy(*names)))
    return merged.where((F.col("item").isNotNull()) & (F.col("estimate") >= F.lit(share) * F.col("total"))).select(*names, "item", "estimate", "total")


def verified(stream: DataFrame, found: DataFrame, groups: Sequence[str], share: float) -> DataFrame:
    """(groups, item, estimate, total, weight) of the candidates whose true weight reaches share of the total: a second
    reading of the same streams that counts only the candidates."""
    keys = [*groups, "item"]
    true = stream.select(*keys, "weight").join(found.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("weight").alias("weight"))
    return found.join(true, keys).where(F.col("weight") >= F.lit(share) * F.col("total"))
