"""The lattice of cells: ids, centres, blocks, polygon masks.

A raster is a table keyed by ``cell_id = row * n_cols + col``; rows run south.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def grid(spark: SparkSession, n_rows: int, n_cols: int, cell: float, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """cell_id, row, col and the centre of every cell."""
    ids = spark.range(n_rows * n_cols).select(F.col("id").alias("cell_id"), (F.col("id") / n_cols).cast("long").alias("row"), (F.col("id") % n_cols).alias("col"))
    return ids.withColumns({"x": F.lit(left) + (F.col("col") + 0.5) * cell, "y": F.lit(top) - (F.col("row") + 0.5) * cell})


def cell_of(x: Column, y: Column, n_rows: int | Column, n_cols: int, cell: float, left: float = 0.0, top: float = 0.0) -> Column:
    """The cell that holds a point, -1 off the lattice."""
    col, row = F.floor((x - left) / cell), F.floor((F.lit(top) - y) / cell)
    rows = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return F.when((col >= 0) & (col < n_cols) & (row >= 0) & (row < rows), row * n_cols + col).otherwise(-1).cast("long")


def snap(low: float, high: float, step: float) -> tuple[float, float]:
    """Bounds grown outward to multiples of the step, a millionth of it aside."""
    import math

    return math.floor(low / step + 1e-6) * step, math.ceil(high / step - 1e-6) * step


def inside(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Even-odd rule over all rings, so holes need no care; a fixed number of edges, in one expression."""
    odd = F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
                odd = odd != cross
    return odd


def inside_edges(points: DataFrame, edges: DataFrame, key: str = "cell_id", band: float = 1000.0) -> DataFrame:
    """Keys of the points in the polygons given as rows (x1, y1, x2, y2, polygon) of edges.

    Points and edges meet in bands of y, an equi join; parity is per polygon.
    """
    e = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))))
    p = points.select(key, "x", "y").withColumn("band", F.floor(F.col("y") / band))
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = p.join(e, "band").where(cross).groupBy(key, "polygon").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n % 2 = 1").select(key).distinct()


def block_of(x: Column, y: Column, size: float) -> Column:
    """Name of the spatial block that holds a point."""
    return F.concat_ws("_", F.floor(x / size).cast("long"), F.floor(y / size).cast("long"))


def deal_folds(blocks: DataFrame, n_folds: int, seed: int = 42, block: str = "block") -> DataFrame:
    """block, fold: blocks in the order of a seeded hash, dealt in turn."""
    from ..functions.ranks import row_numbers

    keyed = blocks.select(block).distinct().withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col(block))))
    return row_numbers(keyed, [F.col("_hash"), F.col(block)], out="_n").select(block, ((F.col("_n") - 1) % n_folds).cast("int").alias("fold"))


def reference_grids(left: Column, bottom: Column, right: Column, top: Column, cell: float, buffer: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """left, top, rows and columns of the lattice over buffered bounds, grown to whole multiples of the cell; of bounds in columns."""
    a, b = F.floor((left - buffer) / cell), F.floor((bottom - buffer) / cell)
    c, d = F.ceil((right + buffer) / cell), F.ceil((top + buffer) / cell)
    return a * F.lit(cell), d * F.lit(cell), d - b, c - a


def reference_grid(left: float, bottom: float, right: float, top: float, cell: float, buffer: float = 0.0) -> tuple[float, float, int, int]:
    """left, top, rows and columns of the lattice over buffered bounds, grown to whole multiples of the cell."""
    a, c = snap(left - buffer, right + buffer, cell)
    b, d = snap(bottom - buffer, top + buffer, cell)
    return a, d, round((d - b) / cell), round((c - a) / cell)


def seeded_sample(df: DataFrame, n: int, key: str = "cell_id", seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows at any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def hashed(cells: DataFrame, seed: int) -> DataFrame:
    """A score from 0 to 1 of each cell by md5 of the seed and its id: the same however rows are dealt."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"))), 1, 13), 16, 10).cast("long")
    return cells.withColumn("score", bits / F.lit(float(1 << 52)))
