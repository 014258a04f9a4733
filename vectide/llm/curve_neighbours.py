"""Most similar vectors for every vector, by shifted Hilbert orderings of projected vectors.

1. Usable vectors with equal values become one vector (the rest of the group is kept as a list of ids), so copies
   cost nothing and ties among them are exact.
2. Each vector is projected `n_curves` times to `dims` directions (random rotations of the principal axes of a bounded
   sample), shifted by a random offset and given its position on a Hilbert curve. Each curve is cut into parts of about
   PART_ROWS vectors at quantiles of the sample; equal positions are cut by a hash, and a part begins with the last window
   of the one before, so no pair is lost at a cut. One exchange carries all curves, two bytes an element.
   Crowds (groups of near copies too large for a window, of at least LEAST_SAMPLED in SAMPLE vectors) get curves of
   their own on the differences from their centre; their number grows with the crowd, up to MOST_CURVES.
3. In each part, every vector is compared with its neighbours in a window of `window` to 2 x `window` positions on both
   sides (matrix products), first along the curve, then along orders - 1 further Hilbert curves on the part's own axes,
   which cost no exchange; then, `rounds` times, with its neighbours' neighbours in the part. Each keeps a list of its
   best k + slack, of which the k best and those that the quantisation cannot tell from them leave the part.
   Vectors that differ in magnitude only are exact ties: the first ids of each direction are candidates as well.
4. The lists of all parts merge per vector. Where a rank or min_similarity hangs on less than the quantisation's error,
   the pair is reranked by the exact cosine in double precision.

Loss: a pair is missed only if it is apart in every order of every part that holds both, or if more than `slack` others
are nearer to one than the quantisation tells. Work and shuffle are proportional to vectors x curves. Crowds beyond
about 25 x 3 windows x orders, or too small a part of the table for the sample, are covered less.
Defined cases: a vector that is null, of another length, with a null, NaN or infinite element, or all zero is not
usable; ties go to the smaller id (similarities are compared after rounding to 9 digits); an empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.session import durable

#: A similarity of vectors of two bytes an element is off by less than QUANTISED_ERROR times the sine of their angle (five
#: standard deviations), and by less than ALWAYS_OFF more.
QUANTISED_ERROR, ALWAYS_OFF = 0.00003, 3e-9
#: Above this similarity the cosines of a window are computed in double precision.
CLOSE = 0.999
BITS, TIE_BITS = 6, 14
SALTS = 16
#: Vectors of a part that is searched as a whole, about; twice as many at most.
PART_ROWS = 60_000
#: Vectors of a crowd have this cosine or more; crowds and axes are found in SAMPLE vectors; a crowd has so many of them at
#: least, and is covered so many times by the windows of its own curves, of which there are so many at most.
CROWD, SAMPLE, LEAST_SAMPLED, COVER, MOST_CURVES = 0.7, 4096, 20, 2.5, 64
#: Cuts into parts come from 32 vectors a part, and this many at most; beyond that, parts are read in chunks of PART_ROWS.
MOST_SAMPLED = 1 << 18


class Crowd(NamedTuple):
    """A group of near copies: its centre, the usual distance from it, and how many curves of its own it gets."""

    centre: np.ndarray
    spread: float
    n_curves: int


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of points (n, d) with whole coordinates below 2**bits on the d-dimensional Hilbert curve, d * bits <= 63.

    The coordinates are turned into the transposed index (undo the excess work from the highest bit down, then Gray
    code), and its bits are interleaved.
    """
    x = [c.astype(np.uint32) for c in cells.T]
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(bit)) & np.uint32(1), np.uint32((1 << bit) - 1), np.uint32(0))
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (((c ^ flip) >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return key


def usable(values: Column, dim: int) -> Column:
    """Whether an array has dim finite elements that are not all zero."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(values) == dim) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def _floats(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([a.flatten().to_numpy(zero_copy_only=False) for a in arrays] or [np.zeros(0)]).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def crowds(sample: np.ndarray, n: int, window: int) -> list[Crowd]:
    """Groups of near copies that no window holds, found in a sample (unit vectors) of n vectors, largest first."""
    sample = sample[:SAMPLE]
    alike = sample @ sample.T >= CROWD
    free = np.ones(len(sample), bool)
    found = []
    while free.any():
        sizes = np.where(free, alike[:, free].sum(axis=1), 0)
        own = alike[sizes.argmax()] & free
        size = own.sum() / len(sample) * n
        if own.sum() < LEAST_SAMPLED or size <= 2 * window:
            break
        centre = sample[own].mean(axis=0)
        spread = np.sqrt(((sample[own] - centre) ** 2).sum(axis=1).mean())
        if spread > 0:
            found.append(Crowd(centre, spread, min(MOST_CURVES, int(np.ceil(COVER * size / (3 * window))))))
        free &= ~own
    return found


def axes_of(sample: np.ndarray, dims: int) -> np.ndarray:
    """Principal axes of a sample (in the columns) that hold more than the average variance, at least 3 dims / 2."""
    dim = sample.shape[1]
    if len(sample) < 2 * dim:
        return np.eye(dim)
    size, axes = np.linalg.eigh(np.cov(sample.T))
    return axes[:, ::-1][:, : min(dim, max(int((size > size.mean()).sum()), dims + dims // 2))]


class Curve(NamedTuple):
    """One ordering: where its cells lie, and where it is cut into parts (keys), in each of which it is searched whole."""

    centre: np.ndarray
    axes: np.ndarray
    shift: np.ndarray
    cuts: np.ndarray
    halos: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, dims: int, rng: np.random.Generator, base: np.ndarray) -> Curve:
        """A random rotation of the base axes, on the scale of the sample, shifted at random."""
        axes = base @ np.linalg.qr(rng.normal(size=(base.shape[1], base.shape[1])))[0][:, :dims]
        own = sample @ axes
        scale = own.std(axis=0)
        none = np.zeros(0, np.int64)
        return Curve(sample.mean(axis=0), axes / np.where(scale > 0, scale, 1) / 6, 0.5 + (rng.random(axes.shape[1]) - 0.5) * 0.3, none, none)

    def positions(self, x: np.ndarray) -> np.ndarray:
        spot = (x - self.centre) @ self.axes + self.shift
        return hilbert((np.clip(spot, 0, 1 - 1e-6) * (1 << BITS)).astype(np.int64))

    def keys(self, x: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Position, and below it some bits of a hash of the name, which part equal positions."""
        low = ((names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        return self.positions(x) << TIE_BITS | low

    def cut(self, sample: np.ndarray, names: np.ndarray, n: float, halo: int) -> Curve:
        """With cuts into parts of about PART_ROWS of n vectors, and for each cut the key about `halo` vectors before it."""
        parts = max(1, math.ceil(n / PART_ROWS))
        keys = np.sort(self.keys(sample, names))
        at = len(keys) * np.arange(1, parts) // parts
        back = np.maximum(at - math.ceil(halo * len(keys) / max(n, 1)), 0)
        return self._replace(cuts=keys[at], halos=keys[back])


def curves(sample: np.ndarray, names: np.ndarray, n: int, dims: int, n_curves: int, window: int, orders: int, seed: int) -> tuple[list[Curve], list[Crowd], list[list[Curve]]]:
    """Orderings of all vectors, crowds, and orderings of each crowd's vectors, from a sample (unit vectors, names) of n."""
    rng = np.random.default_rng(seed)
    base = axes_of(sample[:SAMPLE], dims)
    own = [Curve.of(sample, dims, rng, base).cut(sample, names, n, window) for _ in range(n_curves)]
    crowded = crowds(sample, n, window * orders)
    near = home(sample, crowded)
    inner = []
    for i, crowd in enumerate(crowded):
        members = sample[near == i]
        basis = axes_of(members[:SAMPLE], dims)
        size = len(members) / len(sample) * n
        inner.append([Curve.of(members, dims, rng, basis).cut(members, names[near == i], size, window) for _ in range(crowd.n_curves)])
    return own, crowded, inner


def home(x: np.ndarray, crowded: Sequence[Crowd]) -> np.ndarray:
    """Number of the crowd of each vector, -1 for none."""
    if not crowded:
        return np.full(len(x), -1)
    near = x @ np.stack([g.centre / np.linalg.norm(g.centre) for g in crowded]).T
    return np.where(near.max(axis=1) >= CROWD, near.argmax(axis=1), -1)


def placed(vectors: DataFrame, dim: int, plan: tuple[list[Curve], list[Crowd], list[list[Curve]]]) -> DataFrame:
    """(part, pos, num, q): each vector (num, values) on every curve, quantised to two bytes an element; also in the next
    part where it is near a cut. A vector of a crowd is on the crowd's own curves as well."""
    schema = "part int, pos bigint, num bigint, q binary"
    sent = vectors.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, crowded, inner = sent.value
        for batch in batches:
            exact = _unit(_floats(batch.column("values"), dim).astype(np.float64))
            names = batch.column("num").to_numpy()
            q = np.rint(exact / np.abs(exact).max(axis=1, keepdims=True) * 32767).astype("<i2")
            blob = pa.Array.from_buffers(pa.binary(2 * dim), len(exact), [None, pa.py_buffer(np.ascontiguousarray(q).tobytes())]).cast(pa.binary())
            near = home(exact, crowded)
            first = 0
            for curve, rows in [(c, None) for c in own] + [(c, np.nonzero(near == i)[0]) for i, cs in enumerate(inner) for c in cs]:
                x, name = (exact, names) if rows is None else (exact[rows], names[rows])
                key = curve.keys(x, name)
                part = np.searchsorted(curve.cuts, key, side="right")
                again = np.nonzero((part < len(curve.cuts)) & (key >= np.append(curve.halos, 0)[part]))[0]
                at = np.concatenate([np.arange(len(key)), again])
                place = first + np.concatenate([part, part[again] + 1])
                index = at if rows is None else rows[at]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(key[at]), pa.array(names[index]), blob.take(pa.array(index))], names=["part", "pos", "num", "q"])
                first += len(curve.cuts) + 1

    return vectors.select("num", "values").mapInArrow(run, schema)


def _largest(s: np.ndarray, keep: int, group: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the keep largest elements of each row: the largest are in the groups with the largest maxima."""
    rows, width = s.shape
    if width > 4 * group * keep:
        whole = width // group * group
        tops = s[:, :whole].reshape(rows, -1, group).max(axis=2)
        pick = np.argpartition(-tops, keep - 1, axis=1)[:, :keep]
        cols = (pick[:, :, None] * group + np.arange(group)).reshape(rows, -1)
        cols = np.concatenate([cols, np.tile(np.arange(whole, width), (rows, 1))], axis=1)
        few = np.take_along_axis(s, cols, 1)
        best = np.argpartition(-few, keep - 1, axis=1)[:, :keep]
        return np.repeat(np.arange(rows), keep), np.take_along_axis(cols, best, 1).ravel()
    keep = min(keep, width)
    best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    return np.repeat(np.arange(rows), keep), best.ravel()


class Lists:
    """The `keep` best neighbours so far of each of n vectors."""

    def __init__(self, n: int, keep: int, floor: float) -> None:
        self.other, self.s = np.full((n, keep), -1, np.int64), np.full((n, keep), -9.0)
        self.floor, self.least = floor, np.full(n, floor)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """Similarities of the vectors a (rows) and b (columns)."""
        keep = self.s.shape[1]
        if (self.least[a] <= -1).all():
            r, c = _largest(s, keep)
        else:
            better = s > self.least[a][:, None]
            many = np.count_nonzero(better, axis=1) > 2 * keep
            better[many] = False
            r, c = np.divmod(np.flatnonzero(better), s.shape[1])
            if many.any():
                rows, cols = _largest(s[many], keep)
                r, c = np.concatenate([r, np.nonzero(many)[0][rows]]), np.concatenate([c, cols])
        if len(r):
            self.found.append((a[r], b[c], s[r, c].astype(float)))

    def settle(self) -> None:
        """Take in what was offered."""
        if not self.found:
            return
        a, b, s = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        ok = s >= self.floor
        n, keep = self.s.shape
        touched = np.zeros(n, bool)
        touched[a] = True
        rows, cols = np.nonzero((self.other >= 0) & touched[:, None])
        a, b, s = np.r_[a[ok], rows], np.r_[b[ok], self.other[rows, cols]], np.r_[s[ok], self.s[rows, cols]]
        _, first = np.unique(a * n + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        best = rank < keep
        self.other[touched], self.s[touched] = -1, -9
        self.other[a[best], rank[best]], self.s[a[best], rank[best]] = b[best], s[best]
        self.least = np.maximum(self.s[:, -1], self.floor)


def search_part(x: np.ndarray, keep: int, floor: float, window: int, orders: int, rounds: int, dims: int, seed: int) -> Lists:
    """The best neighbours of each of the unit vectors x, which lie along a curve: of those in the windows of that order
    and of orders - 1 further curves on the part's own axes; then `rounds` times of their neighbours' neighbours."""
    rng = np.random.default_rng(seed)
    lists = Lists(len(x), keep, floor)
    single = x.astype(np.float32)
    few = x[np.sort(rng.choice(len(x), min(len(x), SAMPLE), replace=False))]
    base = axes_of(few, dims)
    for turn in range(orders if len(x) > 2 * window else 1):
        order = np.arange(len(x)) if turn == 0 else np.argsort(Curve.of(few, dims, rng, base).positions(x), kind="stable")
        before = order[:0]
        for start in range(0, len(x), window):
            own = order[start : start + window]
            met = np.concatenate([before, own])
            s = single[own] @ single[met].T
            if (s >= CLOSE).sum() > (keep + 1) * len(own):  # more than each with itself and its best: single precision cannot rank them
                s = x[own] @ x[met].T
            s[np.arange(len(own)), len(before) + np.arange(len(own))] = -9
            lists.offer(own, met, s)
            if len(before):
                lists.offer(before, own, np.ascontiguousarray(s[:, : len(before)].T))
            before = own
        lists.settle()
    for _ in range(rounds):
        further(single, lists)
    return lists


def further(x: np.ndarray, lists: Lists, block: int = 256) -> None:
    """Neighbours' neighbours in both directions along the lists, of the vectors that have some."""
    keep = lists.s.shape[1]
    rows = np.nonzero(lists.other[:, 0] >= 0)[0]
    for start in range(0, len(rows), block):
        a = rows[start : start + block]
        mid = lists.other[a]
        then = np.where(mid[:, :, None] >= 0, lists.other[mid], -1).reshape(len(a), -1)
        s = np.einsum("ad,akd->ak", x[a], x[then])
        s[(then < 0) | (then == a[:, None])] = -9
        at, to = np.nonzero(s > lists.least[a][:, None])
        lists.found.append((a[at], then[at, to], s[at, to].astype(float)))
        # and the other way: those two steps away may want a
        at, to = np.nonzero((s > lists.least[then]) & (then >= 0))
        lists.found.append((then[at, to], a[at], s[at, to].astype(float)))
    lists.settle()


def doubt(s: np.ndarray | Column):
    """How far a similarity of quantised vectors may be off: the error is at right angles to the vectors."""
    if isinstance(s, Column):
        return QUANTISED_ERROR * F.sqrt(F.greatest(1 - s * s, F.lit(0.0))) + ALWAYS_OFF
    return QUANTISED_ERROR * np.sqrt(np.maximum(1 - s * s, 0)) + ALWAYS_OFF


def candidates(spots: DataFrame, dim: int, floor: float, k: int, keep: int, window: int, orders: int, rounds: int, dims: int, seed: int, parts: int) -> DataFrame:
    """(a, b, s): for every vector its best neighbours in each part: the k best of a list of `keep`, and those that the
    quantisation cannot tell from them. s approximate (see doubt)."""
    schema = "a bigint, b bigint, s double"

    def found(own: pa.Table, at: int) -> pa.RecordBatch:
        q = np.frombuffer(b"".join(own["q"].to_pylist()), "<i2").reshape(-1, dim).astype(np.float64)
        names = own["num"].to_numpy()
        lists = search_part(q / np.sqrt((q * q).sum(axis=1, keepdims=True)), keep, floor, window, orders, rounds, dims, seed + at)
        edge = lists.s[:, min(k, keep) - 1]
        a, r = np.nonzero((lists.other >= 0) & (lists.s >= (edge - 2 * doubt(edge))[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[lists.other[a, r]]), pa.array(lists.s[a, r])], names=["a", "b", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * PART_ROWS:
                table = pa.Table.from_batches(held)
                yield found(table.slice(0, PART_ROWS), number)
                held, number = table.slice(PART_ROWS - window).to_batches(), number + 1
                size = table.num_rows - PART_ROWS + window
        if size:
            yield found(pa.Table.from_batches(held), number)

    return spots.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "pos").mapInArrow(run, schema)


def rerank(pairs: DataFrame, min_similarity: float, dim: int) -> DataFrame:
    """(a, b, sim): exact cosine in double precision of pairs with their vectors (a, b, va, vb), from min_similarity on."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_floats(batch.column(c), dim).astype(np.float64) for c in ("va", "vb"))
                sim = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], names=schema.names)
                yield out.filter(pa.array(sim >= min_similarity))

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, schema)


def merged(near: DataFrame, k: int, min_similarity: float) -> DataFrame:
    """(a, b, s, open) of each vector's candidates over all parts: the k best and those that the quantisation cannot tell
    from them. open: only the exact similarity can give the row its place. One shuffle by vector."""
    once = near.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"))
    own = Window.partitionBy("a")
    best = own.orderBy(F.desc("s"), "b")
    ranked = once.withColumn("r", F.row_number().over(best)).withColumn("before", F.lag("s").over(best)).withColumn("after", F.lead("s").over(best))
    edge = F.min(F.when(F.col("r") <= k, F.col("s"))).over(own)
    kept = ranked.withColumn("edge", edge).where(F.col("s") >= F.col("edge") - 2 * doubt(F.col("edge")))
    s, slack = F.col("s"), 2 * doubt(F.col("s"))
    near_by = (F.col("before") - s <= slack) | (s - F.col("after") <= slack) | (F.abs(s - F.lit(min_similarity)) <= slack)
    return kept.select("a", "b", "s", F.coalesce(near_by, F.lit(False)).alias("open"))


def prints(values: Column) -> list[Column]:
    """Two hashes of a vector, by which rows of one vector are told from others without moving vectors."""
    return [F.xxhash64(values).alias("p"), F.hash(values).alias("h")]


def most_similar(vectors: DataFrame, k: int = 10, min_similarity: float = -1.0, current: DataFrame | None = None, dim: int = 64, n_curves: int = 5, dims: int = 8, window: int = 500, orders: int = 4, rounds: int = 0, slack: int = 5, seed: int = 11) -> DataFrame:
    """(id, other, similarity, rank) of the k most similar other vectors of every vector, of at least min_similarity.

    vectors: id, values; only usable rows count. current: id, p, h (see prints) of the row to take for each id; without
    it, an id's rows must agree. Other columns are ignored. similarity is exact where the rank or min_similarity hangs on
    it, else that of the quantised vectors (see doubt).
    """
    rows = vectors.select("id", "values").where(F.col("id").isNotNull() & usable(F.col("values"), dim))
    chosen = current.select("id", "p", "h") if current is not None else rows.select("id", *prints(F.col("values"))).distinct()
    # all that follows on groups of copies works on this narrow table: every id, its group's smallest id and size
    groups = chosen.groupBy("p", "h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = durable(chosen.join(groups, ["p", "h"]).select("id", "rep", "copies", "p"))
    reps = members.where("id = rep").select("id", F.col("p").alias("rep_print"))
    same = F.xxhash64("values").bitwiseXOR(F.col("rep_print")) == 0
    # one vector per group, numbered; the only exchange of whole vectors
    single = durable(rows.join(reps, "id").where(same).select("id", "values").dropDuplicates(["id"]).select(F.monotonically_increasing_id().alias("num"), "id", "values"))
    n = single.count()
    floor = max(-1.0, min_similarity - QUANTISED_ERROR)
    size = min(max(SAMPLE, 32 * math.ceil(n / PART_ROWS)), MOST_SAMPLED)
    sample = single.select("num", "values").orderBy(F.xxhash64("num", F.lit(seed)), "num").limit(size).toArrow()
    names, drawn = sample["num"].to_numpy(), _unit(_floats(sample["values"], dim).astype(np.float64)) if n else np.zeros((0, dim))
    plan = curves(drawn, names, n, dims, n_curves, window, orders, seed) if n else ([], [], [])
    parts = sum(len(c.cuts) + 1 for c in [*plan[0], *(c for own in plan[2] for c in own)])
    near = candidates(placed(single, dim, plan), dim, floor, k, k + slack, window, orders, rounds, dims, seed, max(parts, 1))
    # beside those of the windows, the k + 1 first ids of the vector's own direction
    pairs = durable(merged(near.unionByName(aligned(single, k + 1, dim)), k, min_similarity))
    doubtful = pairs.where("open").select("a", "b")
    left = single.select(F.col("num").alias("a"), F.col("values").alias("va"))
    right = single.select(F.col("num").alias("b"), F.col("values").alias("vb"))
    exact = rerank(doubtful.join(left, "a").join(right, "b"), min_similarity, dim)
    clear = pairs.where(~F.col("open") & (F.col("s") >= min_similarity)).select("a", "b", F.col("s").alias("sim"))
    called = single.select("num", "id")
    directed = clear.unionByName(exact).join(called.select(F.col("num").alias("a"), F.col("id").alias("rep")), "a").join(called.select(F.col("num").alias("b"), F.col("id").alias("other_rep")), "b")
    firsts = durable(first_ids(members.where("copies > 1"), k + 1))
    # neighbours, each with its copies, and the group's own ids; k + 1 of them, as a member drops itself
    named = directed.select("rep", "other_rep", "sim").join(firsts.select(F.col("rep").alias("other_rep"), F.col("ids").alias("other_ids")), "other_rep", "left")
    listed = named.select("rep", "sim", F.explode(F.coalesce("other_ids", F.array("other_rep"))).alias("other"))
    own = firsts.select("rep", F.lit(1.0).alias("sim"), F.explode("ids").alias("other"))
    order = [F.round("sim", 9).desc(), F.col("other")]
    ranked = listed.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("r") <= k + 1)
    tops = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "other", "sim"))).alias("top"))
    # members of large groups are spread over salts
    grouped = F.exists("top", lambda t: t["other"] == F.col("rep"))
    salted = tops.withColumn("salt", F.explode(F.when(grouped, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    spread = members.select("id", "rep", F.when(F.col("copies") > 1, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    mine = spread.join(salted, ["rep", "salt"]).select("id", F.slice(F.filter("top", lambda t: t["other"] != F.col("id")), 1, k).alias("top"))
    return mine.select("id", F.posexplode("top").alias("rank", "t")).select("id", F.col("t.other").alias("other"), F.col("t.sim").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def directions(single: DataFrame, dim: int) -> DataFrame:
    """(num, id, rep): rep is a hash that vectors of one direction share, whatever their magnitude; those at a rounding
    edge may differ."""
    schema = T.StructType([single.schema["num"], single.schema["id"], T.StructField("rep", T.LongType())])
    odd = np.random.default_rng(1).integers(-(2**62), 2**62, dim) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column("values"), dim).astype(np.float64)
            cells = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 10_000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("id"), pa.array((cells * odd).sum(axis=1))], names=schema.names)

    return single.select("num", "id", "values").mapInArrow(run, schema)


def aligned(single: DataFrame, n: int, dim: int) -> DataFrame:
    """(a, b, s): the n smallest ids of vectors that differ from a in magnitude only; exact ties, which no window ranks by id.
    Vectors are not moved."""
    own = directions(single, dim)
    several = own.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep")
    members = durable(own.join(several, "rep"))
    firsts = first_ids(members, n).select("rep", F.explode("ids").alias("id"))
    named = firsts.join(members.select("rep", "id", F.col("num").alias("b")), ["rep", "id"]).groupBy("rep").agg(F.collect_list("b").alias("bs"))
    return members.join(named, "rep").select(F.col("num").alias("a"), F.explode("bs").alias("b"), F.lit(1.0).alias("s")).where("a <> b")


def first_ids(members: DataFrame, n: int) -> DataFrame:
    """(rep, ids): the n smallest ids of each group of copies, salted so that no task ranks a whole hot group."""
    rows = members.select("id", "rep", F.pmod(F.xxhash64("id"), F.lit(SALTS * 4)).alias("salt"))
    for keys in (["rep", "salt"], ["rep"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= n)
    return rows.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
