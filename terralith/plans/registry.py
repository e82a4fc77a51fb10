"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import labels, proximity
from ..sources import views
from . import extra, geo, model, more

QUERIES = {**geo.QUERIES, **model.QUERIES, **extra.QUERIES, **more.QUERIES}
ORACLE = {**geo.ORACLE, **model.ORACLE, **extra.ORACLE, **more.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, class fractions, growth labels, distance to built-up land of the baseline year, AUC by row band."""
    frac = geo.fractions(spark, sf_dir)
    grown = labels.growth(labels.yearly(frac, model.YEARS)).where("candidate")
    cells = views.cell(spark, sf_dir).select("cell_id", "row", "x", "y")
    towns = cells.join(frac.where("yr = 1996 and frac_built >= 0.5").select("cell_id"), "cell_id", "left_semi")
    distance = proximity.nearest_point(cells, towns, 3000.0)
    scored = grown.join(distance, "cell_id").join(cells, "cell_id").select("grew", (-F.col("distance")).alias("score"), F.floor(F.col("row") / 10).alias("band"))
    return ranks.auc(scored, "grew", "score", ["band"])
