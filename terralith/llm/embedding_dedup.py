"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

Vectors are linked when their labels are equal and their cosine reaches the
threshold.  Equal vectors are first taken together (partial aggregation), then
dealt into tiles of bounded size near the same pivot, with as many pivots as the
vectors ask for and ``PIVOT_BYTES`` allow; a pair of tiles is skipped when
the triangle inequality shows that no pair in it can reach the threshold.
Within a pair of tiles the normalised vectors are quantised to int8; the product of the
quantised tiles differs from the cosine by at most ``ex + ey + ex ey`` with the
vectors' own quantisation errors, and only pairs that this may lift to the
threshold are computed again in double precision.  A tile gives sums of links
and a spanning forest, never its pairs.

Results in unusual cases: null, zero and non-finite vectors, null components and
null labels link with nothing, nor do vectors of different lengths; each row
counts as a vector, also where a vec_id repeats; a null vec_id has a null
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.components import connected_components

from .common import saved

THRESHOLD = 0.98
TILE = 2048
#: Bytes of all pivots, which go to every task; their number follows the number of vectors below that.
PIVOT_BYTES = 64 << 20


def usable(embedding: Column, label: Column) -> Column:
    """Not null, not zero, all components finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(label.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and the length of the error for each unit vector."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return q, scale, error


def links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors reach the threshold, as a matrix."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64  # integers stay whole
    near = (qx.astype(exact) @ qy.astype(exact).T) * sx[:, None] * sy[None, :]
    maybe = near + ex[:, None] + ey[None, :] + ex[:, None] * ey[None, :] >= threshold - 1e-6
    count = int(maybe.sum())
    if count > maybe.size // 20:
        return (x @ y.T >= threshold) & maybe
    i, j = np.nonzero(maybe)
    for a in range(0, count, 1 << 16):
        s = slice(a, a + (1 << 16))
        maybe[i[s], j[s]] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= threshold
    return maybe


def forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric matrix reaches."""
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == least).all():
            return least
        least = new


def _pivots(reps: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most n unit vectors of the data and ``PIVOT_BYTES``, by a hash, as centres of cells; by length of the vector."""
    width = reps.agg(F.max("dim")).first()[0] or 1
    n = max(1, min(n, PIVOT_BYTES // (8 * width)))
    got = reps.orderBy(F.xxhash64("rep"), "rep").limit(n).select("dim", F.col("vec").cast("array<double>").alias("vec")).toArrow()
    dims = got.column("dim").to_numpy()
    return {int(d): unit(got.filter(pa.array(dims == d)).column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) for d in np.unique(dims)}


def _cells(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims = np.array([len(v) for v in batch.column("vec").to_pylist()] if batch.num_rows else [], int)
            for d, p in sent.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    flat = batch.column("vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                    flat, step = unit(flat), max(1, (1 << 22) // len(p))  # products of 32 MB at most
                    cell[at] = np.concatenate([(flat[i : i + step] @ p.T).argmax(axis=1) for i in range(0, len(at), step)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    from pyspark.sql import types as T

    return reps.mapInArrow(run, T.StructType([*reps.schema.fields, T.StructField("cell", T.IntegerType())]))


def _tiles(placed: DataFrame, key: list[str]) -> DataFrame:
    """One row a tile: ids, copies and unit vectors, centre and radius."""

    def one(key, table):
        d = key[2].as_py()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        x = unit(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))[order]
        c = x.mean(axis=0)
        radius = float(np.sqrt(((x - c) ** 2).sum(axis=1)).max()) + 1e-9
        cell = [[k.as_py()] for k in key]
        return pa.table([pa.array(v, t) for v, t in zip(cell, (pa.int64(), pa.string(), pa.int32()), strict=True)] + [pa.array([c.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([table.column("rep").to_numpy()[order].astype("<i8").tobytes()], pa.binary()), pa.array([table.column("copies").to_numpy()[order].astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["tile", "label", "dim", "centre", "radius", "ids", "copies", "vecs"])

    return placed.groupBy("tile", "label", "dim").applyInArrow(one, "tile long, label string, dim int, centre array<double>, radius double, ids binary, copies binary, vecs binary")


def near(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; ``pivots`` lowers the number of cells, which changes no result."""
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"), (usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull()).alias("ok"))
    groups = rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = saved(groups.withColumn("dim", F.size("vec")))
    # Cells of several tiles each: smaller ones would only multiply the pairs of tiles.
    n = reps.count() // (8 * tile)
    cells = _cells(reps, _pivots(reps, n if pivots is None else min(n, pivots)))
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    placed = cells.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / tile)))
    placed = placed.withColumn("tile", F.xxhash64("label", "dim", "cell", "part")).drop("cell", "n", "part")
    tiles = saved(_tiles(placed, ["tile"]))
    # Pairs of tiles of a label (their number, not that of vectors, is squared), without those that are too far apart.
    a = tiles.select(F.col("tile").alias("a"), "label", "dim", F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    b = tiles.select(F.col("tile").alias("b"), "label", "dim", F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    apart = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = F.lit(math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    pairs = a.join(b, ["label", "dim"]).where((F.col("a") <= F.col("b")) & (apart <= F.col("ra") + F.col("rb") + reach)).select("a", "b", "dim")
    left = tiles.select(F.col("tile").alias("a"), F.col("ids").alias("ids_a"), F.col("copies").alias("n_a"), F.col("vecs").alias("vecs_a"))
    right = tiles.select(F.col("tile").alias("b"), F.col("ids").alias("ids_b"), F.col("copies").alias("n_b"), F.col("vecs").alias("vecs_b"))
    work = pairs.repartition("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids_a, ids_b = (np.frombuffer(row[c], "<i8") for c in ("ids_a", "ids_b"))
                n_a, n_b = (np.frombuffer(row[c], "<i8") for c in ("n_a", "n_b"))
                x, y = (np.frombuffer(row[c], float).reshape(-1, row["dim"]) for c in ("vecs_a", "vecs_b"))
                linked = links(x, y, threshold)
                if row["a"] == row["b"]:
                    linked |= linked.T
                    np.fill_diagonal(linked, False)
                    ids, weight = ids_a, linked @ n_a
                    least = forest(linked, ids)
                else:
                    ids, weight = np.concatenate([ids_a, ids_b]), np.concatenate([linked @ n_b, linked.T @ n_a])
                    some_a, some_b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                    n = len(some_a)
                    both = np.zeros((n + len(some_b),) * 2, bool)
                    both[:n, n:] = linked[np.ix_(some_a, some_b)]
                    both |= both.T
                    least = ids.copy()
                    at = np.concatenate([some_a, len(ids_a) + some_b])
                    if len(at):
                        least[at] = forest(both, ids[at])
                some = weight > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(weight[some].astype(np.int64)), pa.array(least[some])], ["node", "links", "root"])

    found = saved(work.mapInArrow(run, "node long, links long, root long"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("node <> root"), "node", "root")
    known = reps.join(sums, reps.rep == sums.node, "left").drop("node").join(component, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("_l"), F.col("vec").alias("_v"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    own = rows.join(known, F.col("ok") & (F.col("label") == F.col("_l")) & (F.col("vec") == F.col("_v")), "left")
    component_id = F.coalesce("component", F.col("vec_id").cast("long"))
    return own.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").cast("long").eqNullSafe(component_id).alias("kept"))


def op10_embedding_dedup(spark, sf_dir):
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
