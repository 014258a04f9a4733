"""Percentiles of very large numeric columns: dyadic-tree digests that merge by adding node counts.

A value is quantised to one of 2**16 ordered leaves: whole numbers below 2**11 exactly, larger ones to 11
significant bits (relative width 2**-10 at most), so that every non-negative long has a leaf. A digest is a set of
rows (group, node, count); node 1 is the root, 2n and 2n+1 are the children of n, leaf i is node 2**16 + i.
Compression moves the counts of two siblings to their parent while the three together hold at most n / k of the
group's n values. Digests of any parts of a group (files, partitions, days) merge by adding the counts of equal
nodes. A count above the leaves never exceeds n / k, so a rank is wrong by at most 16 n / k, whatever the order of
merges; groups of fewer than k values stay exact up to the leaf. Every answer comes as an interval that holds the
true nearest-rank percentile for certain.

Nulls, NaN and negative values are not counted. A group without values gives no row. Equal values share a leaf, so
repeated rows only add to a count: a group's leaf counts are at most 2**16 rows however many values it has, and they
are combined before the shuffle, so a hot group costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.batches import changes, whole_groups

DEPTH = 16
EXACT_BITS = 11
LEAVES = 1 << DEPTH


def leaf(value: Column, scale: float = 1.0) -> Column:
    """Leaf of a number, null if it has none (null, NaN, negative). scale: leaves per unit for small values."""
    number = value.cast("double") if scale != 1.0 else value
    v = (number * F.lit(scale) if scale != 1.0 else number).cast("long")
    bits = F.length(F.bin(v)) - F.lit(EXACT_BITS)
    long = F.call_function("shiftright", v, bits) + F.call_function("shiftleft", bits, F.lit(EXACT_BITS - 1))
    small = v < F.lit(1 << EXACT_BITS)
    return F.when((number >= 0) & ~F.isnan(number.cast("double")), F.when(small, v).otherwise(long)).cast("int")


def leaf_bounds(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole number of each leaf; leaves beyond that of the largest long count as that one."""
    half = 1 << (EXACT_BITS - 1)
    leaves = np.minimum(leaves, (63 - EXACT_BITS) * half + 2 * half - 1)
    shift = np.maximum(leaves // half - 1, 0).astype(np.int64)
    mantissa = np.where(shift > 0, leaves - shift * half, leaves).astype(np.int64)
    low = mantissa << shift
    return low, low + (np.int64(1) << shift) - 1


def leaf_counts(df: DataFrame, groups: Sequence[str], value: str, scale: float = 1.0, weight: str | None = None) -> DataFrame:
    """An uncompressed digest: (groups, node, cnt). Combined in each map task before its only shuffle."""
    node = leaf(F.col(value), scale) + F.lit(LEAVES)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.select(*groups, node.alias("node"), *([weight] if weight else [])).where("node is not null").groupBy(*groups, "node").agg(n.cast("long").alias("cnt"))


def merge(digest: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add the counts of equal nodes; groups may be coarser than those the digests were made for."""
    return digest.groupBy(*groups, "node").agg(F.sum("cnt").alias("cnt"))


def squeeze(gid: np.ndarray, node: np.ndarray, cnt: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress the digests of many groups at once, from the leaves up. limit: n // k of each group."""
    hot = limit[gid] > 0
    keep = [(gid[~hot], node[~hot], cnt[~hot])]
    gid, node, cnt = gid[hot], node[hot], cnt[hot]
    level = np.frexp(node.astype(float))[1] - 1
    up_key = np.zeros(0, np.int64)
    up_cnt = np.zeros(0, np.int64)
    for depth in range(DEPTH, -1, -1):
        here = level == depth
        key = np.concatenate([gid[here].astype(np.int64) << (DEPTH + 1) | node[here], up_key])
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, np.concatenate([cnt[here], up_cnt]), len(key)).astype(np.int64)
        if depth == 0:
            keep.append((key >> (DEPTH + 1), key & (2 * LEAVES - 1), count))
            break
        g, parent = key >> (DEPTH + 1), (key & (2 * LEAVES - 1)) >> 1
        pkey = g << (DEPTH + 1) | parent
        first = np.r_[True, pkey[1:] != pkey[:-1]] if len(pkey) else np.zeros(0, bool)
        family = np.cumsum(first) - 1
        fkey = pkey[first]
        total = np.bincount(family, count, len(fkey)).astype(np.int64)
        above = level == depth - 1
        akey, acnt = gid[above].astype(np.int64) << (DEPTH + 1) | node[above], cnt[above]
        order = np.argsort(akey, kind="stable")
        akey, acnt = akey[order], acnt[order]
        at = np.searchsorted(akey, fkey)
        same = (at < len(akey)) & (akey[np.minimum(at, max(len(akey) - 1, 0))] == fkey) if len(akey) else np.zeros(len(fkey), bool)
        with_parent = total + np.where(same, acnt[np.minimum(at, max(len(akey) - 1, 0))] if len(akey) else 0, 0)
        moves = with_parent <= limit[fkey >> (DEPTH + 1)]
        stay = ~moves[family]
        keep.append((g[stay], key[stay] & (2 * LEAVES - 1), count[stay]))
        up_key, up_cnt = fkey[moves], total[moves]
    return tuple(np.concatenate(x) for x in zip(*keep))


def interval(gid: np.ndarray, node: np.ndarray, cnt: np.ndarray, n: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaves between which the value of rank ceil(p n) of each group lies."""
    up = DEPTH - (np.frexp(node.astype(float))[1] - 1)
    low = (node << up) - LEAVES
    high = low + (np.int64(1) << up) - 1
    rank = np.maximum(np.ceil(p * n - 1e-9), 1)

    def first(edge: np.ndarray) -> np.ndarray:
        order = np.lexsort((edge, gid))
        g, running = gid[order], np.cumsum(cnt[order])
        base = np.r_[0, np.cumsum(n)[:-1]]
        enough = running - base[g] >= rank[g]
        out = np.zeros(len(n), np.int64)
        rows = np.nonzero(enough)[0]
        at, start = np.unique(g[rows], return_index=True)
        out[at] = edge[order][rows[start]]
        return out

    return first(low), first(high)


def _columns(table: pa.Table, groups: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = changes(table, groups)
    sizes = np.diff(np.r_[starts, table.num_rows])
    gid = np.repeat(np.arange(len(starts)), sizes)
    node, cnt = table["node"].to_numpy().astype(np.int64), table["cnt"].to_numpy().astype(np.int64)
    n = np.bincount(gid, cnt, len(starts)).astype(np.int64)
    return starts, gid, node, cnt, n


def _by_group(digest: DataFrame, groups: Sequence[str]) -> DataFrame:
    return digest.repartition(*groups).sortWithinPartitions(*groups)


def compress(digest: DataFrame, groups: Sequence[str], k: int = 4096) -> DataFrame:
    """The digest with at most about 3 k nodes a group: rank error at most 16 / k of the group's values."""
    names = list(groups)
    schema = T.StructType([digest.schema[g] for g in names] + [T.StructField("node", T.IntegerType()), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names):
            starts, gid, node, cnt, n = _columns(table, names)
            gid, node, cnt = squeeze(gid, node, cnt, n // k)
            heads = table.select(names).take(pa.array(starts[gid]))
            out = heads.append_column("node", pa.array(node.astype(np.int32))).append_column("cnt", pa.array(cnt))
            yield from out.combine_chunks().to_batches()

    return _by_group(digest.select(*names, "node", "cnt"), names).mapInArrow(run, schema)


def percentiles(digest: DataFrame, groups: Sequence[str], probabilities: Sequence[float], k: int = 4096) -> DataFrame:
    """(groups, p, n, value_lo, value_hi, value): the true nearest-rank percentile is in [value_lo, value_hi], in
    units of the quantised number; value is the middle, less than one leaf from the truth for exact digests."""
    names, wanted = list(groups), list(probabilities)
    added = [("p", T.DoubleType()), ("n", T.LongType()), ("value_lo", T.LongType()), ("value_hi", T.LongType()), ("value", T.DoubleType())]
    schema = T.StructType([digest.schema[g] for g in names] + [T.StructField(*x) for x in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names):
            starts, gid, node, cnt, n = _columns(table, names)
            gid, node, cnt = squeeze(gid, node, cnt, n // k)
            heads = table.select(names).take(pa.array(starts))
            for p in wanted:
                lo, hi = interval(gid, node, cnt, n, p)
                lo, hi = leaf_bounds(lo)[0], leaf_bounds(hi)[1]
                out = heads
                for name, column in zip(("p", "n", "value_lo", "value_hi", "value"), (np.full(len(n), p), n, lo, hi, (lo + hi) / 2.0)):
                    out = out.append_column(name, pa.array(column))
                yield from out.combine_chunks().to_batches()

    return _by_group(digest.select(*names, "node", "cnt"), names).mapInArrow(run, schema)
