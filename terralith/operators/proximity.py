"""Nearest-neighbour distances with a cap, by buckets.

Both sides are dealt into square buckets; a query asks rings of buckets that grow
until its best distance can't be beaten from outside, or the cap is reached.
Each ring is an equi join on the bucket, and only open queries go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import materialise


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / square))).otherwise(0.0)
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def _rings(queries: DataFrame, targets: DataFrame, key: str, distance: Column, cap: float, bucket: float, skip: Column | None) -> DataFrame:
    """targets carry bx, by (their buckets) and what ``distance`` needs."""
    left = queries.withColumns({"qx": F.floor(F.col("x") / bucket), "qy": F.floor(F.col("y") / bucket), "best": F.lit(None).cast("double")})
    done, ring, last = None, 0, math.ceil(cap / bucket)
    while True:
        # This ring only: cells at Chebyshev distance ``ring``.
        span = F.sequence(F.lit(-ring), F.lit(ring))
        asked = left.select(key, "x", "y", "qx", "qy", F.explode(span).alias("i")).select(key, "x", "y", "qx", "qy", "i", F.explode(F.when(F.abs("i") == ring, span).otherwise(F.array(F.lit(-ring), F.lit(ring))) if ring else F.array(F.lit(0))).alias("j"))
        asked = asked.select(key, "x", "y", (F.col("qx") + F.col("i")).alias("bx"), (F.col("qy") + F.col("j")).alias("by"))
        pairs = asked.join(targets, ["bx", "by"])
        if skip is not None:
            pairs = pairs.where(~skip)
        found = pairs.groupBy(key).agg(F.min(distance).alias("here"))
        left = left.join(found, key, "left").withColumn("best", F.least("best", "here")).drop("here")
        border = F.least(F.col("x") - (F.col("qx") - ring) * bucket, (F.col("qx") + ring + 1) * bucket - F.col("x"), F.col("y") - (F.col("qy") - ring) * bucket, (F.col("qy") + ring + 1) * bucket - F.col("y"))
        if ring >= last:
            out = left.select(key, "best")
            done = out if done is None else done.unionByName(out)
            return done.select(key, F.least(F.coalesce("best", F.lit(cap)), F.lit(cap)).alias("distance"))
        left = materialise(left.withColumn("_over", F.coalesce(F.col("best") <= border, F.lit(False)) | (border >= cap)))
        over = left.where("_over").select(key, "best")
        done = over if done is None else done.unionByName(over)
        left = left.where("not _over").drop("_over")
        if left.isEmpty():
            return done.select(key, F.least(F.coalesce("best", F.lit(cap)), F.lit(cap)).alias("distance"))
        ring += 1


def nearest_point(queries: DataFrame, points: DataFrame, cap: float, key: str = "cell_id", bucket: float = 500.0, outside: str | None = None) -> DataFrame:
    """``distance`` of each query (x, y) to the nearest point, the cap if there is none nearer.

    outside: a column of the points with the query key they lie in; those do not count for that query.
    """
    p = points.select(F.col("x").alias("px"), F.col("y").alias("py"), *([F.col(outside).alias("_own")] if outside else []), F.floor(F.col("x") / bucket).alias("bx"), F.floor(F.col("y") / bucket).alias("by"))
    skip = (F.col("_own") == F.col(key)) if outside else None
    return _rings(queries.select(key, "x", "y"), p, key, F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), cap, bucket, skip)


def nearest_line(queries: DataFrame, segments: DataFrame, cap: float, key: str = "cell_id", bucket: float = 500.0) -> DataFrame:
    """``distance`` of each query to the nearest segment (x1, y1, x2, y2), at most the cap."""
    s = segments.select("x1", "y1", "x2", "y2")
    s = s.withColumn("bx", F.explode(F.sequence(F.floor(F.least("x1", "x2") / bucket), F.floor(F.greatest("x1", "x2") / bucket))))
    s = s.withColumn("by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / bucket), F.floor(F.greatest("y1", "y2") / bucket))))
    return _rings(queries.select(key, "x", "y"), s, key, segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]), cap, bucket, None)
