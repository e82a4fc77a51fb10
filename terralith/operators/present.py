"""What reports and maps need: readable names, units, codes of labels, upper ends of colour scales, metadata of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks

# Readable names of features that are not rings.
NAMES = {
    "log_dist_built": "distance to built-up",
    "log_dist_water": "distance to water",
    "log_dist_major": "distance to a major road",
    "log_dist_any": "distance to any road",
    "road_density": "road density (500 m)",
    "elev_mean": "elevation",
    "slope_mean": "slope (mean)",
    "slope_max": "slope (max)",
}
# Codes of label classes on a map.
EXCLUDED, BUILT, OPEN, GREW = 255, 1, 3, 4


def readable(column: Column) -> Column:
    """The name of a feature for people: rings by pattern, others from the table, unknown ones as they are."""
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    ring = F.regexp_replace(column, r"^ring(\d+)_(.+)$", "$2 share within $1 m")
    return F.coalesce(F.try_element_at(named, column), ring)


def shown(column: Column) -> Column:
    """unit and show: how a stored value of the feature is turned into the one that is shown."""
    how = F.when(column.startswith("log_dist"), F.array(F.lit("m"), F.lit("expm1"))).when(column.startswith("ring"), F.array(F.lit("%"), F.lit("percent")))
    how = how.when(column == "road_density", F.array(F.lit("km/km²"), F.lit("value"))).when(column == "elev_mean", F.array(F.lit("m"), F.lit("value"))).otherwise(F.array(F.lit("°"), F.lit("value")))
    return F.struct(how[0].alias("unit"), how[1].alias("show"))


def shown_value(column: Column, value: Column) -> Column:
    """The value as it is shown."""
    show = shown(column)["show"]
    return F.when(show == "expm1", F.expm1(value)).when(show == "percent", 100 * value).otherwise(value)


def label_code(excluded: Column, built: Column, grew: Column, candidate: Column, ambiguous: Column) -> Column:
    """The code of a cell's label on a map, null where it has none; the first that holds counts."""
    return F.when(excluded, EXCLUDED).when(built, BUILT).when(grew, GREW).when(candidate & ~ambiguous, OPEN)


def upper_ends(df: DataFrame, values: list[str], share: float = 0.99) -> DataFrame:
    """column, upper: the upper end of a colour scale of each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value")) for v in values])))
    return ranks.quantiles(long, "value", [share], ["column"]).select("column", F.col("quantile").alias("upper"))


def page_meta(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """One row a feature of a page's profiles: position, readable name, unit, show, low and high of all cells, mean and deviation of those fitted on."""
    parts = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(F.when(fit_on, F.col(c))).alias("mean"), F.stddev_pop(F.when(fit_on, F.col(c))).alias("sd")) for i, c in enumerate(columns)]
    rows = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    return rows.select("*", readable(F.col("column")).alias("label"), shown(F.col("column")).alias("s")).select("position", "column", "label", "s.unit", "s.show", "low", "high", "mean", "sd")
