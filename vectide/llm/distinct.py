"""Exact distinct counts over huge identifier sets by hash-range decomposition.

Pairs of identifier and group are deduplicated: one row per (identifier, group, period) with a bit mask of the small
dimensions in which it occurred (slot = sub-period x type). The hash range of the identifiers is cut into disjoint
buckets, Spark's hash partitions. Whatever is counted (a group, a set of groups, all groups, a sub-period, a type, any
combination) is counted exactly inside each bucket, without another shuffle of pairs, and the counts of the buckets
are added, because no identifier lies in two buckets. The error is 0 by construction. The deduplicated pairs are the
combinable partial result: those of two files, days or runs merge by `merge` (bitwise or of the masks of equal pairs).

Skew: a hot identifier or group is collapsed in the map tasks before the only shuffle of pairs, and afterwards has one
row per group and period it occurs in. Nulls are not identifiers; empty inputs give no rows; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.batches import gathered


KEYS = ["kind", "identifier", "grp", "period"]


def pairs(df: DataFrame, kind: str, identifier: str, group: str, period: str, slot: str) -> DataFrame:
    """(kind, identifier, grp, period, mask): slot is a number from 0 to 62, null for none of them."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(slot).cast("int"))
    picked = df.select(F.col(kind).alias("kind"), F.col(identifier).alias("identifier"), F.col(group).alias("grp"), F.col(period).alias("period"), F.coalesce(bit, F.lit(0).cast("long")).alias("mask"))
    return merge([combined(picked.where("identifier is not null and period is not null"))])


def combined(rows: DataFrame) -> DataFrame:
    """Equal rows once among some 200,000 of a task at a time, before any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            yield from table.group_by(table.column_names, use_threads=False).aggregate([]).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """The pairs of several parts as those of one, in disjoint hash buckets of the identifiers: one exchange."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition("kind", "identifier").groupBy(*KEYS).agg(F.bit_or("mask").alias("mask"))


def with_groups(buckets: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """The pairs of every group and of sets of groups taken together, each set given by a condition on grp; still exact,
    as each identifier is in one bucket, and nothing is shuffled again."""
    named = F.array_compact(F.array(F.col("grp"), *[F.when(c, F.lit(name)) for name, c in sets.items()]))
    both = buckets.select("kind", "identifier", F.explode(named).alias("grp"), "period", "mask")
    return both.groupBy(*KEYS).agg(F.bit_or("mask").alias("mask"))


def with_all_groups(buckets: DataFrame) -> DataFrame:
    """The pairs of every group and of all groups taken together (grp 'all')."""
    return with_groups(buckets, {"all": F.lit(True)})


def any_of(slots: Sequence[int]) -> Column:
    """Whether a pair occurred in one of the slots."""
    wanted = sum(1 << s for s in slots)
    return F.col("mask").bitwiseAND(F.lit(wanted).cast("long")) != 0


def counts(buckets: DataFrame, slices: dict[str, Sequence[int] | None]) -> DataFrame:
    """(kind, grp, period, slice, n): distinct identifiers of each slice, a set of slots (None: the whole period).

    The partial aggregation counts in each bucket; the final one adds the counts of the buckets.
    """
    named = [(F.count(F.lit(1)) if s is None else F.count_if(any_of(s))).alias(f"c{i}") for i, s in enumerate(slices.values())]
    added = buckets.groupBy("kind", "grp", "period").agg(*named)
    rows = F.array(*[F.struct(F.lit(name).alias("slice"), F.col(f"c{i}").alias("n")) for i, name in enumerate(slices)])
    return added.select("kind", "grp", "period", F.inline(rows)).where("n > 0")
