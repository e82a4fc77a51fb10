"""Profiles, nearest references and similarity queries with explanations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.vectors import cosine_distance, euclidean

#: Reference profiles up to which one matrix goes to every task (8 bytes a component).
BROADCAST_VALUES = 8_000_000
#: Components up to which references are searched by leaves of a k-d tree; with more, boxes exclude little.
TREE_DIMS = 8
#: Rows of a leaf or of a group of profiles, profiles that a task groups at a time, and references compared with a group at a time.
LEAF, GROUPED, COMPARED = 64, 65_536, 32_768


def _halved(m: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of up to ``LEAF``, halved along the widest component."""
    out, todo = [], [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        x = m[rows]
        f = np.argmax(x.max(0) - x.min(0))
        cut = np.argpartition(x[:, f], len(rows) // 2)
        todo += [rows[cut[len(rows) // 2 :]], rows[cut[: len(rows) // 2]]]
    return out


class Leaves:
    """References by leaves of a k-d tree with their boxes; finds the k nearest of many profiles, all of them exactly."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        fine = np.isfinite(matrix).all(1)
        ids, m, self.k = ids[fine], matrix[fine], k
        if len(m) and len(np.unique(ids)) == len(ids):  # of equal points k + 1 are enough: one may be the profile itself
            order = np.lexsort(m.T)
            first = np.flatnonzero(np.r_[True, (m[order][1:] != m[order][:-1]).any(1)])
            order = order[np.arange(len(m)) - np.repeat(first, np.diff(np.r_[first, len(m)])) <= k]
            ids, m = ids[order], m[order]
        leaves = [rows for rows in _halved(m) if len(rows)]
        self.size = np.array([len(rows) for rows in leaves], np.int64)
        self.start = np.cumsum(self.size) - self.size
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ids, self.m = ids[order], m[order]
        self.low, self.high = (np.array([f(m[rows], 0) for rows in leaves]) for f in (np.min, np.max))

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        n = self.size[leaves]
        return np.repeat(self.start[leaves] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def nearest(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rising distances to the k nearest references with another key, NaN where there are no more."""
        near = np.full((len(x), self.k), np.nan)
        fine = np.flatnonzero(np.isfinite(x).all(1))
        for rows in _halved(x[fine]) if len(self.m) else []:
            if len(rows):
                self._group(own[fine[rows]], x[fine[rows]], fine[rows], near)
        return near

    def _group(self, own: np.ndarray, x: np.ndarray, at: np.ndarray, near: np.ndarray) -> None:
        """One group of profiles: a bound on each k-th distance from close leaves, then all leaves within the bounds."""
        low, high = x.min(0), x.max(0)
        middle = (low + high) / 2
        p = x - middle
        pp = (p**2).sum(1)
        gap = (np.maximum(0, np.maximum(self.low - high, low - self.high)) ** 2).sum(1)

        def squares(refs: np.ndarray) -> np.ndarray:
            c = self.m[refs] - middle
            return pp[:, None] + (c**2).sum(1) - 2 * p @ c.T

        some = min(len(gap), -(-4 * (self.k + 1 + LEAF) // LEAF) + 12)
        off = ((self.low + self.high) / 2 - middle) ** 2
        close = self.rows(np.argpartition(gap + 1e-3 * off.sum(1), some - 1)[:some])
        square = squares(close)
        square[own[:, None] == self.ids[close]] = np.inf
        bound = np.partition(square, self.k - 1, axis=1)[:, self.k - 1] if len(close) >= self.k else np.full(len(x), np.inf)
        bound = np.maximum(bound, 0) * (1 + 1e-9) + 1e-12 * pp  # more than what rounding may take away
        refs, found = self.rows(np.flatnonzero(gap <= bound.max() * (1 + 1e-9))), []
        for a in range(0, len(refs), COMPARED):
            part = refs[a : a + COMPARED]
            i, j = np.nonzero(squares(part) <= bound[:, None])
            j = part[j]
            d = np.sqrt(((x[i] - self.m[j]) ** 2).sum(1))
            good = (own[i] != self.ids[j]) & np.isfinite(d)
            found.append((i[good], d[good]))
        i, d = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((d, i))
        i, d = i[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        first = nth < self.k
        near[at[i[first]], nth[first]] = d[first]


def standardise(profiles: DataFrame, fit_on: Column, z: str = "z") -> DataFrame:
    """z-scores of the array column; mean and population deviation from the rows ``fit_on``; constant components divide by 1."""
    long = profiles.where(fit_on).select(F.posexplode(z).alias("i", "v"))
    stats = long.groupBy("i").agg(F.avg("v").alias("m"), F.coalesce(F.nullif(F.stddev_pop("v"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_stats"))  # a row a component
    return profiles.crossJoin(F.broadcast(row)).withColumn(z, F.zip_with(z, "_stats", lambda v, t: (v - t.m) / t.s)).drop("_stats")


def knn_distance(profiles: DataFrame, references: DataFrame, k: int = 10, key: str = "cell_id", z: str = "z") -> DataFrame:
    """``distance``: mean Euclidean distance to the k nearest references other than itself.

    k is lowered to what there is.  A reference matrix of a checked size goes to every task, in
    blocks of numpy products or, with up to ``TREE_DIMS`` components, by leaves of a k-d tree; beyond it,
    references are dealt out in blocks of that size, each block gives its k + 1 nearest, and these meet by key.
    """
    spark = profiles.sparkSession
    head = references.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(z)).alias("d")).first()
    n, d = head.n, head.d or 1
    if not n:
        return profiles.select(key, F.lit(None).cast("double").alias("distance"))
    k = max(1, min(k, n - 1))
    blocks = -(-n * d // BROADCAST_VALUES)

    def nearest(ids: np.ndarray, matrix: np.ndarray):
        square = (matrix**2).sum(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, matrix.shape[1]))
                out = []
                for a in range(0, len(own), 1024):
                    p, q = x[a : a + 1024], own[a : a + 1024]
                    near = (p**2).sum(1)[:, None] + square - 2 * p @ matrix.T
                    near[q[:, None] == ids[None, :]] = np.inf
                    m = min(k + 8, len(ids))
                    at = np.argpartition(near, m - 1, axis=1)[:, :m]  # then exactly, among a few more than k
                    exact = np.sqrt(((p[:, None, :] - matrix[at]) ** 2).sum(2))
                    exact[np.isinf(np.take_along_axis(near, at, 1))] = np.inf
                    exact.sort(axis=1)
                    out += [row[np.isfinite(row)][:k].tolist() for row in exact]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "near"])

        return run

    def by_leaves(leaves: Leaves):
        def some(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            own, x = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            near = leaves.nearest(own.to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
            there = np.isfinite(near)
            offsets = pa.array(np.r_[0, np.cumsum(there.sum(1))].astype(np.int32))
            return pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(offsets, pa.array(near[there]))], [key, "near"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= GROUPED:
                    yield some(held)
                    held, n = [], 0
            if n:
                yield some(held)

        return run

    few = d <= TREE_DIMS
    if few:  # small rows, much work: not fewer tasks for being small; like profiles together, as a group's box is to be small
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        profiles = profiles.select(key, z).repartitionByRange(tasks, F.get(z, F.lit(0)), key)
    refs = references.select(F.col(key).alias("id"), z).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        rows = refs.where(F.col("_b") == b).select("id", z).toArrow()  # of checked size
        if not rows.num_rows:
            continue
        matrix = rows.column(z).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        ids = rows.column("id").to_numpy()
        part = profiles.select(key, z).mapInArrow(by_leaves(Leaves(ids, matrix, k)) if few else nearest(ids, matrix), f"{key} long, near array<double>")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return found.select(key, F.when(F.size("near") > 0, F.aggregate("near", F.lit(0.0), lambda s, v: s + v) / F.size("near")).alias("distance"))


def query(profiles: DataFrame, target: int, candidates: Column, n: int = 20, metric: str = "euclidean", key: str = "cell_id", z: str = "z", near: Column | None = None) -> DataFrame:
    """The n candidates most like the target: rank, distance, similarity and rank percentile.

    similarity = 1 - distance / p99 of all candidates' distances (1 where p99 is 0), not below 0;
    ties go by key.  near: a further condition that is applied before ranking.
    """
    one = profiles.where(F.col(key) == target).limit(1).select(F.col(z).alias("_q"))
    pool = profiles.where(candidates & (F.col(key) != target))
    if near is not None:
        pool = pool.where(near)
    f = euclidean if metric == "euclidean" else cosine_distance
    scored = pool.crossJoin(F.broadcast(one)).select(key, f(F.col("_q"), F.col(z)).alias("distance"))
    stats = ranks.quantiles(scored, "distance", [0.99]).select(F.col("quantile").alias("_p")).crossJoin(scored.agg(F.count(F.lit(1)).alias("_n")))  # one row each
    top = scored.orderBy("distance", key).limit(n)
    from pyspark.sql import Window

    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # n rows
    similarity = F.when(F.col("_p") > 0, F.greatest(F.lit(0.0), 1 - F.col("distance") / F.col("_p"))).otherwise(1.0)
    return ranked.crossJoin(F.broadcast(stats)).select(key, "rank", "distance", similarity.alias("similarity"), (F.col("rank") / F.col("_n")).alias("rank_percentile"))


def explain(profiles: DataFrame, target: int, cells: DataFrame, trivial: Column | None = None, n: int = 3, key: str = "cell_id", z: str = "z") -> DataFrame:
    """For each cell the n closest components, trivial ones last, and the n most different, as positions.

    trivial: an array column of flags beside the profile.
    """
    one = profiles.where(F.col(key) == target).limit(1).select(F.col(z).alias("_q"))
    joined = profiles.join(F.broadcast(cells.select(key)), key).crossJoin(F.broadcast(one))
    gaps = F.transform(F.arrays_zip(F.col(z).alias("a"), F.col("_q").alias("b")), lambda p, i: F.struct(F.abs(p.a - p.b).alias("gap"), i.alias("i")))
    flags = trivial if trivial is not None else F.transform(z, lambda v: F.lit(False))
    closest = F.transform(F.slice(F.array_sort(F.zip_with(gaps, flags, lambda g, t: F.struct(t.alias("t"), g.gap.alias("gap"), g.i.alias("i")))), 1, n), lambda g: g.i)
    furthest = F.transform(F.slice(F.array_sort(F.transform(gaps, lambda g: F.struct((-g.gap).alias("gap"), g.i.alias("i")))), 1, n), lambda g: g.i)
    return joined.select(key, closest.alias("closest"), furthest.alias("most_different"))


def trivial_match(share: Column, other: Column, limit: float = 0.005) -> Column:
    """Both lack the class: being alike says nothing."""
    return (share < limit) & (other < limit)


def quantised(df: DataFrame, columns: list[str], levels: int = 65535) -> DataFrame:
    """Columns as integers from 0 to ``levels`` over their range, half to even; 0 where all are equal."""
    bounds = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns])
    value = lambda c: F.when(F.col(f"_{c}.hi") > F.col(f"_{c}.lo"), F.rint((F.col(c) - F.col(f"_{c}.lo")) / (F.col(f"_{c}.hi") - F.col(f"_{c}.lo")) * levels)).otherwise(0.0).cast("int")
    return df.crossJoin(F.broadcast(bounds)).withColumns({c: value(c) for c in columns}).drop(*[f"_{c}" for c in columns])


def dequantised(q: Column, low: float, high: float, levels: int = 65535) -> Column:
    return low + q / levels * (high - low)
