"""Rasters from one coordinate system to another: target points are projected into the source and looked up there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy
from . import raster

#: Geographic coordinates; other systems are UTM, 326xx in the north and 327xx in the south.
DEGREES = 4326


def project(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one system (EPSG code) in another."""

    def zone(code: int) -> tuple[Column, Column]:
        if code // 100 not in (326, 327) or not 1 <= code % 100 <= 60:
            raise ValueError(f"EPSG:{code} is neither 4326 nor UTM")
        return F.lit(code % 100), F.lit(code // 100 == 327)

    if source == target:
        return x, y
    lon, lat = (x, y) if source == DEGREES else geodesy.from_utm(x, y, *zone(source))
    return (lon, lat) if target == DEGREES else geodesy.to_utm(lon, lat, *zone(target))


def projected(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """The table with x and y in another system: by way of degrees, a projection a step, so that none is worked out twice."""
    for a, b in ((source, DEGREES), (DEGREES, target)):
        if a != b:
            to = project(F.col(x), F.col(y), a, b)
            df = df.withColumns({x: to[0], y: to[1]})
    return df


def points(spark: SparkSession, left: float, top: float, cell: float, rows: int, cols: int) -> DataFrame:
    """pixel_id, row, col, x, y: the centres of a raster's cells, in any system."""
    r, c = F.floor(F.col("id") / cols), F.col("id") % cols
    return spark.range(rows * cols).select(F.col("id").alias("pixel_id"), r.alias("row"), c.alias("col"), (F.lit(left) + (c + 0.5) * cell).alias("x"), (F.lit(top) - (r + 0.5) * cell).alias("y"))


def warp(target: DataFrame, source: DataFrame, value: str, size: float, left: float, top: float, target_crs: int, source_crs: int, bilinear: bool = False, key: str = "pixel_id") -> DataFrame:
    """key, value: the source raster (row, col from ``left`` and ``top``, cells of ``size``) at each target point; null outside."""
    there = projected(target.select(key, "x", "y"), target_crs, source_crs)
    return (raster.resample_bilinear if bilinear else raster.resample_nearest)(there, source, value, size, left, top, key)
