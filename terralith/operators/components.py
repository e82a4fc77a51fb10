"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which one task joins them (16 bytes each); beyond, star rounds.
ONE_TASK_EDGES = 100_000


def materialise(df: DataFrame) -> DataFrame:
    """Writes to the shared checkpoint folder and cuts the lineage."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars of the components they form in it."""
    f = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f.join(a, b)
    pairs = [(x, r) for x in list(f.up) if (r := f.root(x)) != x]
    for i in range(0, len(pairs), 65536):
        a, b = zip(*pairs[i : i + 65536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge between two nodes.

    Partitions first reduce their edges to stars.  What is left is joined by one
    task if it is small by count, else by alternating large-star and small-star
    rounds (logarithmically many), each written to the checkpoint folder.
    Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.mapInArrow(_forest, "u long, v long").distinct())
    n = e.count()
    if n <= one_task_edges:
        return e.coalesce(1).mapInArrow(_forest, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("component")).transform(_with_roots)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialise(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).transform(_with_roots)
        before = now


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select("component").distinct()
    return stars.unionByName(roots.select(F.col("component").alias("node"), "component"))
