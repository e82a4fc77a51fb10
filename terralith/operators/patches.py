"""Connected patches of lattice cells, and growth types of new patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import row_numbers
from .components import connected_components
from .raster import dilate


def patches(cells: DataFrame, n_cols: int, eight: bool = False) -> DataFrame:
    """cell_id, patch for the cells (row, col) given; patch is the smallest cell_id of its component.

    Runs of neighbours along a row come from a window (gaps and islands); runs that touch in the
    next row are joined, so the graph has runs, not cells, for nodes.
    """
    c = cells.select("row", "col").distinct()
    island = F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col"))
    runs = c.withColumn("_i", island).groupBy("row", "_i").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).select("row", "lo", "hi", (F.col("row") * n_cols + F.col("lo")).alias("run"))
    wide = 1 if eight else 0
    # Runs meet those of the next row by row and column band, an equi join.
    band = 64
    up = runs.select((F.col("row") + 1).alias("row"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("run").alias("a")).withColumn("band", F.explode(F.sequence(F.floor((F.col("a_lo") - wide) / band), F.floor((F.col("a_hi") + wide) / band))))
    down = runs.select("row", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("run").alias("b")).withColumn("band", F.explode(F.sequence(F.floor(F.col("b_lo") / band), F.floor(F.col("b_hi") / band))))
    edges = up.join(down, ["row", "band"]).where((F.col("a_lo") - wide <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi") + wide)).select("a", "b").distinct()
    labels = connected_components(edges)
    labelled = runs.join(labels, runs.run == labels.node, "left").select("row", "lo", "hi", F.coalesce("component", "run").alias("patch"))
    return labelled.select("row", "patch", F.explode(F.sequence("lo", "hi")).alias("col")).select((F.col("row") * n_cols + F.col("col")).alias("cell_id"), "patch")


def patch_stats(cells: DataFrame, score: str, area: float) -> DataFrame:
    """Size, area in hectares, mean and largest score of each patch."""
    return cells.groupBy("patch").agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * area / 1e4).alias("area_ha"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))


def outline(cells: DataFrame) -> DataFrame:
    """Boundary edges of each patch: the sides that only one of its cells has."""
    sides = cells.select("patch", F.inline(F.array(*[F.struct(F.lit(k).alias("axis"), (F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for k, i, j in (("h", 0, 0), ("h", 1, 0), ("v", 0, 0), ("v", 0, 1))])))
    return sides.groupBy("patch", "axis", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def growth_types(pixels: DataFrame, n_cols: int, touch: int, big_cells: float, k: int) -> DataFrame:
    """cell_id, lei_type of lattice cells that hold new pixels.

    pixels: a full lattice of row, col, old (built before), new (built since).  A patch of new
    pixels (8 neighbours) is outlying if the ring of ``touch`` pixels round it holds pixels and none
    of them is old.  A ring pixel counts for the patch of the largest label that reaches it.  A cell
    of k x k pixels takes the kind of most of its pixels in big patches (ties: adjacent), or in all if none is big.
    """
    new = pixels.where("new")
    found = patches(new, n_cols, eight=True)
    labels = row_numbers(found.select("patch").distinct(), [F.col("patch")], out="label")
    marked = pixels.withColumn("cell_id", F.col("row") * n_cols + F.col("col")).join(found, "cell_id", "left").join(labels, "patch", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    spread = dilate(marked, "label", touch)
    ring = spread.where("dilated > 0 and label = 0").groupBy(F.col("dilated").alias("label")).agg(F.count(F.lit(1)).alias("ring_n"), F.count_if("old").alias("ring_old"))
    sizes = marked.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    kinds = sizes.join(ring, "label", "left").select("label", F.coalesce((F.col("ring_n") > 0) & (F.col("ring_old") == 0), F.lit(False)).alias("outlying"), (F.col("size") >= big_cells).alias("big"))
    by_cell = marked.where("label > 0").join(kinds, "label").groupBy(((F.floor(F.col("row") / k)) * F.lit(n_cols // k) + F.floor(F.col("col") / k)).alias("cell_id"))
    counts = by_cell.agg(F.count_if(F.expr("outlying and big")).alias("out_big"), F.count_if(F.expr("not outlying and big")).alias("adj_big"), F.count_if("outlying").alias("out_all"), F.count_if(F.expr("not outlying")).alias("adj_all"))
    more = F.when(F.col("out_big") + F.col("adj_big") > 0, F.col("out_big") > F.col("adj_big")).otherwise(F.col("out_all") > F.col("adj_all"))
    return counts.select("cell_id", F.when(more, "outlying").otherwise("adjacent").alias("lei_type"))
