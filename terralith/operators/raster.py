"""Operators on rasters as tables: block statistics, focal windows, terrain, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSES, CLOUD, NODATA


def harmonise(code: Column, table: dict[int, int]) -> Column:
    """The class of each code; 0 for unknown ones."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[code], F.lit(NODATA))


def class_fractions(pixels: DataFrame, by: list[str], code: str = "code", nominal: int | None = None) -> DataFrame:
    """Shares of each class among valid pixels and the share without data; one pass with partial aggregation."""
    valid = F.count_if(~F.col(code).isin(NODATA, CLOUD))
    everything = F.lit(nominal) if nominal else F.count(F.lit(1))
    counts = pixels.groupBy(*by).agg(valid.alias("n_valid"), everything.alias("n_all"), *[F.count_if(F.col(code) == c).alias(f"n_{k}") for k, c in CLASSES.items()])
    fractions = [F.when(F.col("n_valid") > 0, F.col(f"n_{k}") / F.col("n_valid")).otherwise(0.0).alias(f"frac_{k}") for k in CLASSES]
    return counts.select(*by, *fractions, (1 - F.col("n_valid") / F.col("n_all")).alias("nodata_frac"))


def block_stats(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.max(value).alias(f"{value}_max"))


def ring_cells(radius: float, cell: float) -> int:
    """Half width of a window in cells, rounded half to even."""
    n = int(round(radius / cell))
    if n < 1:
        raise ValueError(f"radius {radius} is under half a cell of {cell}")
    return n


def _box(n: int, rows: str, along: str, by: list[str]):
    return Window.partitionBy(*by, rows).orderBy(along).rangeBetween(-n, n)


def ring_means(cells: DataFrame, values: list[str], radii: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Mean of each value in the square ring round each cell, over cells of the lattice only.

    Separable: a range window along rows, then one along columns; two shuffles for all values and radii.
    """
    by = by or []
    one = cells.select("*", *[F.sum(F.col(v)).over(_box(n, "row", "col", by)).alias(f"_s_{r}_{v}") for r, n in radii.items() for v in values], *[F.count(F.lit(1)).over(_box(n, "row", "col", by)).alias(f"_c_{r}") for r, n in radii.items()])
    two = one.select("*", *[F.sum(f"_s_{r}_{v}").over(_box(n, "col", "row", by)).alias(f"_t_{r}_{v}") for r, n in radii.items() for v in values], *[F.sum(f"_c_{r}").over(_box(n, "col", "row", by)).alias(f"_d_{r}") for r, n in radii.items()])

    def ring(r: str, v: str) -> Column:
        rest = F.col(f"_d_{r}") - 1
        mean = F.when(rest > 0, (F.col(f"_t_{r}_{v}") - F.col(v)) / rest).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias(f"ring{r}_{v}")

    return two.select(*cells.columns, *[ring(r, v) for r in radii for v in values])


def disk_sums(cells: DataFrame, value: str, radius_cells: int, by: list[str] | None = None, out: str = "disk") -> DataFrame:
    """Sum of the value and number of lattice cells (``out``_n) within a disk.

    For each row offset the disk is a strip: strips of one width share a window along the row, and
    are then added to their rows; the shuffle is by cell, with 2 r + 1 rows a cell.
    """
    by = by or []
    half = {dy: math.isqrt(radius_cells**2 - dy**2) for dy in range(-radius_cells, radius_cells + 1)}
    strips = cells.select(*by, "row", "col", *[c for w in sorted(set(half.values())) for c in (F.sum(value).over(_box(w, "row", "col", by)).alias(f"_s{w}"), F.count(F.lit(1)).over(_box(w, "row", "col", by)).alias(f"_c{w}"))])
    moved = strips.select(*by, "col", F.inline(F.array(*[F.struct((F.col("row") - dy).alias("row"), F.col(f"_s{w}").cast("double").alias("s"), F.col(f"_c{w}").alias("c")) for dy, w in half.items()])))
    sums = moved.groupBy(*by, "row", "col").agg(F.sum("s").alias(out), F.sum("c").alias(f"{out}_n"))
    # A row that holds cells may lack this column: strips are centred on cells only, so join back drops what is off the lattice.
    return cells.join(sums, [*by, "row", "col"])


def horn(cells: DataFrame, z: str, size: float, by: list[str] | None = None) -> DataFrame:
    """slope and aspect in degrees by Horn's weights; rows and columns beyond the edge continue linearly.

    aspect is null on the flat, both are null next to missing cells.  The lattice is a full rectangle.
    """
    by = by or []
    w = Window.partitionBy(*by, "row").orderBy("col")

    def beside(shift: int, of: Column, w) -> Column:
        near, far = F.lag(of, shift).over(w), F.lag(of, -shift).over(w)
        return F.when(near.isNull(), 2 * of - far).otherwise(near)

    v = F.col(z).cast("double")
    rows = cells.withColumns({"_w": beside(1, v, w), "_e": beside(-1, v, w), "_z": v})
    rows = rows.withColumns({"_across": F.col("_e") - F.col("_w"), "_along": F.col("_w") + 2 * F.col("_z") + F.col("_e")})
    u = Window.partitionBy(*by, "col").orderBy("row")
    rows = rows.withColumns({"_n_across": beside(1, F.col("_across"), u), "_s_across": beside(-1, F.col("_across"), u), "_n_along": beside(1, F.col("_along"), u), "_s_along": beside(-1, F.col("_along"), u)})
    dx = (F.col("_n_across") + 2 * F.col("_across") + F.col("_s_across")) / (8 * size)
    dy = (F.col("_n_along") - F.col("_s_along")) / (8 * size)
    aspect = F.when((dx == 0) & (dy == 0), None).otherwise((F.degrees(F.atan2(-dx, -dy)) + 360) % 360)
    return rows.select(*cells.columns, F.degrees(F.atan(F.hypot(dx, dy))).alias("slope"), aspect.alias("aspect"))


def dilate(cells: DataFrame, value: str, n: int, by: list[str] | None = None, out: str = "dilated") -> DataFrame:
    """Largest value in the (2 n + 1) squared window, by range windows along rows and columns."""
    by = by or []
    one = cells.withColumn("_m", F.max(value).over(_box(n, "row", "col", by)))
    return one.withColumn(out, F.max("_m").over(_box(n, "col", "row", by))).drop("_m")


def resample_nearest(target: DataFrame, source: DataFrame, value: str, size: float, left: float = 0.0, top: float = 0.0, key: str = "pixel_id") -> DataFrame:
    """The source cell that holds each target point (x, y); null outside."""
    t = target.select(key, F.floor((F.col("x") - left) / size).alias("col"), F.floor((F.lit(top) - F.col("y")) / size).alias("row"))
    return t.join(source.select("row", "col", value), ["row", "col"], "left").select(key, value)


def resample_bilinear(target: DataFrame, source: DataFrame, value: str, size: float, left: float = 0.0, top: float = 0.0, key: str = "pixel_id") -> DataFrame:
    """Weighted mean of the four source centres round each target point; missing ones are left out and the weights renewed."""
    t = target.select(key, ((F.col("x") - left) / size - 0.5).alias("u"), ((F.lit(top) - F.col("y")) / size - 0.5).alias("v"))
    corners = [F.struct((F.floor("v") + i).alias("row"), (F.floor("u") + j).alias("col"), ((F.lit(1 - i) + (2 * i - 1) * (F.col("v") - F.floor("v"))) * (F.lit(1 - j) + (2 * j - 1) * (F.col("u") - F.floor("u")))).alias("w")) for i in (0, 1) for j in (0, 1)]
    spread = t.select(key, F.inline(F.array(*corners)))
    known = spread.where("w > 0").join(source.select("row", "col", value).where(F.col(value).isNotNull()), ["row", "col"])
    means = known.groupBy(key).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    return target.select(key).join(means, key, "left")
