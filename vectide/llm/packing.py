"""Filling containers of fixed capacity: conflict-constrained best fit, largest items first.

Items are spread over shards by a hash of the id and, where rows repeat, their number (so the result does not depend on
partitions); a shard holds about `shard_containers` containers' worth and at
most about SHARD_ITEMS items, so a shard's size does not grow with the data, and a hot source, cluster or id is spread
over all shards. Within a shard the open bins are ordered by what is left in them. Each bin carries a bitmap of the
sources and a bitmap of the duplicate clusters in it. An item goes to the tightest bin that can take it: the search
starts at the successor of its size and goes on while the bin holds a member of the item's duplicate cluster or a source
that must not share a container with the item's. If there is none, a new bin is opened.

Only items larger than a container are cut: into full containers and a rest, which is packed like an item.
Defined cases: null and non-positive sizes are not packed; a null source or cluster conflicts with nothing; ties in
size go by cluster, source and id; repeated rows are items of their own; empty input gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.session import durable

#: Items of a shard at most, about, however small they are.
SHARD_ITEMS = 200_000


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], forbidden: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item, and what is left in each bin. sources and clusters: bit numbers, -1 for none; forbidden:
    for each source the bitmap of those it must not meet. The items come largest first, copies in one run."""
    left: list[tuple[int, int]] = []
    in_bin: list[list[int]] = []
    where: list[int] = []
    before, resume = None, (0, -1)
    for size, source, cluster in zip(sizes, sources, clusters):
        own_source, own_cluster = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        bad = forbidden[source] if source >= 0 else 0
        # a run of copies goes on where the last one's search ended: the bins before hold the cluster already
        kind = (size, source, cluster) if cluster >= 0 else None
        at = bisect_left(left, resume if kind and kind == before else (size, -1))
        while at < len(left) and (in_bin[left[at][1]][0] & bad or in_bin[left[at][1]][1] & own_cluster):
            at += 1
        if at < len(left):
            resume = left.pop(at)
            rest, number = resume
        else:
            rest, number = capacity, len(in_bin)
            resume = (capacity + 1, -1)
            in_bin.append([0, 0])
        before = kind
        in_bin[number][0] |= own_source
        in_bin[number][1] |= own_cluster
        insort(left, (rest - size, number))
        where.append(number)
    rests = [0] * len(in_bin)
    for rest, number in left:
        rests[number] = rest
    return where, rests


def pack(items: DataFrame, item_id: str, size: str, capacity: int, source: str | None = None, cluster: str | None = None, apart: Sequence[tuple[str, str]] = (), shard_containers: int = 2000) -> DataFrame:
    """(shard, container, item_id, part, n_parts, part_size, used): every part of every item, once.

    apart: pairs of sources that must not share a container.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    none = F.lit(None).cast("string")
    keys = ["item_id", "size", "source", "cluster"]
    named = items.select(
        F.col(item_id).alias("item_id"), F.col(size).cast("long").alias("size"), (F.col(source).cast("string") if source else none).alias("source"),
        (F.col(cluster).cast("string") if cluster else none).alias("cluster"),
    ).where("size > 0")
    rows = durable(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    total, number = rows.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)), F.sum("copies")).first()
    shards = max(1, math.ceil(total / (capacity * shard_containers)), math.ceil((number or 0) / SHARD_ITEMS))
    whole = F.floor((F.col("size") - 1) / capacity)
    rest = F.col("size") - whole * capacity
    # repeated rows are numbered, so that an item's shard depends on nothing but the items
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    tagged = each.select(*keys, F.pmod(F.xxhash64("item_id", "copy"), F.lit(shards)).cast("int").alias("shard"), whole.cast("int").alias("full"), rest.alias("rest"))
    fields = [("shard", T.IntegerType()), ("container", T.LongType()), ("item_id", rows.schema["item_id"].dataType), ("part", T.IntegerType()), ("n_parts", T.IntegerType()), ("part_size", T.LongType()), ("used", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    pairs = [tuple(p) for p in apart]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rest", "cluster", "source", "item_id"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        names = {s: i for i, s in enumerate(sorted(group["source"].dropna().unique()))}
        forbidden = [0] * len(names)
        for a, b in pairs:
            if a in names and b in names:
                forbidden[names[a]] |= 1 << names[b]
                forbidden[names[b]] |= 1 << names[a]
        repeated = group["cluster"].value_counts()
        bits = {c: i for i, c in enumerate(repeated.index[repeated > 1])}
        where, rests = best_fit(group["rest"].tolist(), [names.get(s, -1) for s in group["source"]], [bits.get(c, -1) for c in group["cluster"]], forbidden, capacity)
        out = pd.DataFrame({"shard": group["shard"], "container": where, "item_id": group["item_id"], "part": group["full"], "n_parts": group["full"] + 1, "part_size": group["rest"]})
        out["used"] = [capacity - rests[w] for w in where]
        big = group[group["full"] > 0]
        if len(big):
            cut = big.loc[big.index.repeat(big["full"])]
            part = cut.groupby(level=0, sort=False).cumcount()
            own = pd.DataFrame({"shard": cut["shard"], "container": range(len(rests), len(rests) + len(cut)), "item_id": cut["item_id"], "part": part, "n_parts": cut["full"] + 1, "part_size": capacity, "used": capacity})
            out = pd.concat([out, own])
        return out[schema.names]

    return tagged.select("shard", "item_id", "rest", "full", "source", "cluster").groupBy("shard").applyInPandas(run, schema)
