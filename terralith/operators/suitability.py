"""Weighted overlays, score combination, sites, and parameter sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COVER_VALUES, MCDA_CRITERIA, MCDA_MATRIX, RANDOM_INDEX
from ..functions import ranks
from ..functions.vectors import clip


def comparisons(matrix) -> np.ndarray:
    """Pairwise comparisons from text, rows parted by ``;``, or from rows; a number may be a fraction such as 1/3."""
    if isinstance(matrix, str):
        matrix = [row.split() for row in matrix.split(";")]
    parts = [[[float(n) for n in str(cell).split("/")] for cell in row] for row in matrix]
    return np.array([[cell[0] / cell[1] if len(cell) > 1 else cell[0] for cell in row] for row in parts])


def priorities(pairs: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float, float]:
    """Weights, growth factor and consistency ratio: what repeated multiplication with the comparisons converges to."""
    wrong = [f"{i}, {j}" for i, row in enumerate(pairs) for j, x in enumerate(row) if x <= 0 or abs(x * pairs[j][i] - 1) > 1e-6]
    if wrong or not 0 < len(pairs) <= max(RANDOM_INDEX):
        raise ValueError(f"not a matrix of comparisons and their inverses: {wrong or len(pairs)}")
    w = np.full(len(pairs), 1 / len(pairs))
    for _ in range(steps):
        w = pairs @ w
        growth = float(w.sum())
        w = w / growth
    chance = RANDOM_INDEX.get(len(pairs))
    return w, growth, (growth - len(pairs)) / (len(pairs) - 1) / chance if chance else 0.0


def linear_down(x: Column, limit: float) -> Column:
    return clip(1 - x / limit)


def mcda_criteria(cells: DataFrame, slope: float = 15.0, road: float = 3000.0, built: float = 2000.0, water: float = 100.0, cover: dict[str, float] | None = None) -> DataFrame:
    """Adds criteria from 0 to 1 from slope_mean, distances coded as log1p metres, and cover shares."""
    cover = cover or {f"frac_{k}": v for k, v in COVER_VALUES.items() if v}
    metres = lambda c: F.expm1(c)
    w = metres("log_dist_water")
    return cells.withColumns(
        {
            "c_slope": linear_down(F.col("slope_mean"), slope),
            "c_road": linear_down(metres("log_dist_major"), road),
            "c_built": linear_down(metres("log_dist_built"), built),
            "c_water": clip((w - water) / water),
            "c_cover": clip(sum((F.col(k) * v for k, v in cover.items()), F.lit(0.0))),
        }
    )


def default_weights(cover: bool = True) -> dict[str, float]:
    """Weights of the criteria's columns by the default matrix; without land cover, of the matrix without it."""
    n = len(MCDA_CRITERIA) - (not cover)
    return dict(zip((f"c_{k}" for k in MCDA_CRITERIA[:n]), priorities(comparisons([r[:n] for r in MCDA_MATRIX[:n]]))[0].tolist(), strict=True))


def weighted(criteria: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in criteria.items():
        total = total + F.col(c) * float(w)
    return total


def combine(cells: DataFrame, parts: list[str], weights: list[float], y: str, flag: str | None = None) -> DataFrame:
    """``weight`` and ``auc`` of weight * first + (1 - weight) * second, both ranked, for every weight in one plan."""
    a, b = parts
    rows = ranks.pct_rank(ranks.pct_rank(cells, a, out="_a"), b, out="_b")
    if flag:
        rows = rows.where(F.col(flag))
    grid = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return ranks.auc(grid.withColumn("_s", F.round(F.col("weight") * F.col("_a") + (1 - F.col("weight")) * F.col("_b"), 12)), y, "_s", ["weight"])


def best_weight(aucs: DataFrame) -> DataFrame:
    """The weight of the highest AUC to four digits; among equals the one nearest a half, then the smallest."""
    return aucs.orderBy(F.round("auc", 4).desc(), F.round(F.abs(F.col("weight") - 0.5), 9), "weight").limit(1)


def sites(patches: DataFrame, minimum: float = 1.0, top: int = 20, top_area: float = 5.0) -> DataFrame:
    """Patches of an area (hectares) numbered by mean score, cells and label; the first large ones ranked."""
    kept = patches.where(F.col("area_ha") >= minimum - 1e-10)
    order = [F.col("mean_score").desc(), F.col("n_cells").desc(), F.col("patch").asc()]
    numbered = ranks.row_numbers(kept, order, out="site_id")
    large = ranks.row_numbers(kept.where(F.col("area_ha") >= top_area), order, out="_top").where(F.col("_top") <= top).select("patch", F.col("_top").alias("top_site_rank"))
    return numbered.join(large, "patch", "left")


def dominant(shares: list[tuple[str, Column]]) -> Column:
    """Name of the largest share, the first listed among equals."""
    top = F.greatest(*[c for _, c in shares])
    chain = F.when(shares[0][1] == top, shares[0][0])
    for name, c in shares[1:]:
        chain = chain.when(c == top, name)
    return chain


def slope_sweep(cells: DataFrame, limits: list[float], y: str, score: str, slope: str = "slope_mean") -> DataFrame:
    """AUC of a score on the cells that each slope limit leaves; all limits in one plan."""
    grid = cells.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).where(F.col(slope) <= F.col("limit"))
    return ranks.auc(grid, y, score, ["limit"])


def coarsen(cells: DataFrame, factor: int, n_cols: int, means: list[str]) -> DataFrame:
    """Cells of ``factor`` x ``factor`` cells, with the means of the values."""
    wide = -(-n_cols // factor)
    r, c = F.floor(F.col("row") / factor), F.floor(F.col("col") / factor)
    return cells.groupBy((r * wide + c).alias("cell_id")).agg(*[F.avg(m).alias(m) for m in means])


def class_hits(cells: DataFrame, y: str, cls: str = "class", classes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Hit rate, precision, lift and share flagged of the best classes."""
    inside, pos = F.col(cls).isin(list(classes)), F.col(y).cast("int")
    c = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(pos).alias("p"), F.count_if(inside).alias("k"), F.sum(F.when(inside, pos).otherwise(0)).alias("h"))
    precision = F.try_divide("h", "k")
    return c.select(F.try_divide("h", "p").alias("hit_rate"), precision.alias("precision"), F.try_divide(precision, F.try_divide("p", "n")).alias("lift"), F.try_divide("k", "n").alias("flagged"))


def auc_by_type(cells: DataFrame, y: str, score: str, kind: str, kinds: list[str]) -> DataFrame:
    """AUC of each kind of positive against all negatives."""
    spread = cells.withColumn("_kind", F.explode(F.when(F.col(y), F.array(F.col(kind))).otherwise(F.array(*[F.lit(k) for k in kinds])))).where(F.col("_kind").isin(kinds))
    return ranks.auc(spread, y, score, ["_kind"]).withColumnRenamed("_kind", kind)


def project_diff(a: DataFrame, b: DataFrame, key: str, values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of two tables that differ: only in one, or a value over the tolerance."""
    x = a.select(key, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    y = b.select(F.col(key).alias("_k"), *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    j = x.join(y, x[key] == y["_k"], "full")
    off = F.lit(False)
    for v in values:
        off = off | ~(F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) | F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance, F.lit(False)))
    what = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(off, "changed")
    return j.select(F.coalesce(key, "_k").alias(key), what.alias("difference")).where("difference is not null")


def distance_auc(cells: DataFrame, built: DataFrame, y: str, cap: float) -> DataFrame:
    """auc, n_pos, n_neg of nearness to built cells as a score."""
    from .proximity import nearest_point

    near = nearest_point(cells.select("cell_id", "x", "y"), built.select("x", "y"), cap)
    return ranks.auc(cells.select("cell_id", y).join(near, "cell_id").withColumn("_score", -F.col("distance")), y, "_score")
