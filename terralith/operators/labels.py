"""Growth labels, exclusion masks and the rules that turn clusters into classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Years


def yearly(frac: DataFrame, years: dict[str, int], value: str = "frac_built", year: str = "yr") -> DataFrame:
    """One row a cell with the value in each named year; null where a cell lacks the year."""
    return frac.where(F.col(year).isin(list(years.values()))).groupBy("cell_id").agg(*[F.max(F.when(F.col(year) == y, F.col(value))).alias(k) for k, y in years.items()])


def growth(by_year: DataFrame, built: float = 0.5, open_: float = 0.1, train: tuple[str, ...] = ("train1", "train2")) -> DataFrame:
    """Label columns from built shares in baseline, confirm, train years, latest_confirm and latest.

    A cell that lacks one of the years is no candidate.
    """

    def is_built(c: str) -> Column:
        return F.coalesce(F.col(c) >= built, F.lit(False))

    def is_open(c: str) -> Column:
        return F.coalesce(F.col(c) < open_, F.lit(False))

    candidate = is_open("baseline") & is_open("confirm") & F.col("latest_confirm").isNotNull() & F.col("latest").isNotNull()
    grew = candidate & is_built("latest_confirm") & is_built("latest")
    stayed = candidate & is_open("latest_confirm") & is_open("latest")
    trained = F.lit(True)
    for c in train:
        trained = trained & is_built(c)
    return by_year.select(
        "cell_id",
        (is_built("baseline") & is_built("confirm")).alias("built_baseline"),
        candidate.alias("candidate"),
        grew.alias("grew"),
        (candidate & ~grew & ~stayed).alias("ambiguous"),
        (candidate & trained).alias("chg_train_pos"),
    )


def exclusion(cells: DataFrame, wet: float = 0.5, slope: float = 15.0, nodata: float = 0.5, protected: float = 0.5) -> DataFrame:
    """Rules on wet_frac, slope_mean, nodata_frac and protected_frac, each strictly over its limit, and any of them."""
    limits = {"wet": ("wet_frac", wet), "slope": ("slope_mean", slope), "nodata": ("nodata_frac", nodata), "protected": ("protected_frac", protected)}
    out = cells.withColumns({f"excl_{k}": F.coalesce(F.col(c) > v, F.lit(False)) for k, (c, v) in limits.items()})
    any_ = F.lit(False)
    for k in limits:
        any_ = any_ | F.col(f"excl_{k}")
    return out.withColumn("excluded", any_)


def snapshot_for(year: Column, current: int) -> Column:
    """The vector snapshot that goes with a raster year: the last not after it, so nothing later leaks in."""
    return F.when(year >= current, F.lit("current")).otherwise(year.cast("string"))


def as_of(table: DataFrame, date: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return table.where((F.col(start) <= date) & (F.col(end).isNull() | (F.col(end) > date)))


def run_years(run: str, years: Years) -> tuple[int, ...]:
    """Years whose maps a run may see."""
    if run not in ("validation", "final"):
        raise ValueError(f"unknown run {run!r}")
    return (years.baseline, years.confirm) if run == "validation" else (years.latest_confirm, years.latest)


def collapse(water: Column, built: Column, tree: Column, usable: Column) -> Column:
    """1 built-up, 2 forest, 3 usable, 255 excluded: the largest share, the first listed among equals."""
    top = F.greatest(built, tree, usable, water)
    return F.when(built == top, 1).when(tree == top, 2).when(usable == top, 3).otherwise(255)


def cluster_class(f: dict[str, Column], slope: Column, water: float = 0.5, built: float = 0.3, tree: float = 0.5, steep: float = 8.0, cropland_usable: bool = True) -> tuple[Column, Column]:
    """Class and flag of a cluster from its mean shares, by rules in order."""
    wet, usable = f["water"] + f["flooded"], f["crop"] + f["range"] + f["bare"]
    farm = f["crop"] >= F.greatest(f["range"], f["built"], f["tree"])
    is_wet = wet >= water
    is_built = (f["built"] >= built) & (f["built"] >= F.greatest(f["tree"], usable))
    is_forest = (f["tree"] >= tree) | ((f["tree"] + f["range"] >= 0.5) & (slope >= steep))
    rest = farm if not cropland_usable else F.lit(False)
    cls = F.when(is_wet, 255).when(is_built, 1).when(is_forest, 2).when(rest, 255).otherwise(3)
    flag = F.when(is_wet, "water").when(~is_built & ~is_forest & farm, "agricultural")
    return cls, flag


def order_clusters(cells: DataFrame, cluster: str = "cluster", built: str = "built", tree: str = "tree") -> DataFrame:
    """cluster, cluster_id: renumbered from 0 by mean built share, falling, then tree share, falling."""
    from pyspark.sql import Window

    means = cells.groupBy(cluster).agg(F.round(F.avg(built), 9).alias("_b"), F.round(F.avg(tree), 9).alias("_t"))  # a row a cluster
    return means.select(cluster, (F.row_number().over(Window.orderBy(F.col("_b").desc(), F.col("_t").desc(), F.col(cluster))) - 1).alias("cluster_id"))


def confusion(pairs: DataFrame, ours: str, theirs: str, classes: list[int]) -> DataFrame:
    """Counts on the full grid of classes."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"{ours} int, {theirs} int")
    n = pairs.groupBy(F.col(ours).cast("int").alias(ours), F.col(theirs).cast("int").alias(theirs)).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, [ours, theirs], "left").select(ours, theirs, F.coalesce("n", F.lit(0)).alias("n"))


def agreement(pairs: DataFrame, ours: str, theirs: str, classes: list[int]) -> DataFrame:
    """Per class: precision, recall and the shares of both maps; the overall agreement on every row."""
    m = confusion(pairs, ours, theirs, classes)
    rows = m.select(F.inline(F.array(F.struct(F.col(ours).alias("class"), F.col("n").alias("mine"), F.lit(0).cast("long").alias("ref"), F.when(F.col(ours) == F.col(theirs), F.col("n")).otherwise(0).alias("same")), F.struct(F.col(theirs).alias("class"), F.lit(0).cast("long").alias("mine"), F.col("n").alias("ref"), F.lit(0).cast("long").alias("same")))))
    s = rows.groupBy("class").agg(F.sum("mine").alias("mine"), F.sum("ref").alias("ref"), F.sum("same").alias("same"))
    total = s.agg(F.sum("mine").alias("_n"), F.sum("same").alias("_same"))
    j = s.crossJoin(F.broadcast(total))
    return j.select("class", F.try_divide("same", "mine").alias("precision"), F.try_divide("same", "ref").alias("recall"), F.try_divide("mine", "_n").alias("map_share"), F.try_divide("ref", "_n").alias("ref_share"), F.try_divide("_same", "_n").alias("agreement"))


def davies_bouldin(points: DataFrame, cluster: str, dims: list[str]) -> DataFrame:
    """The index of a labelling: clusters are few, so their pairs are."""
    centres = points.groupBy(cluster).agg(*[F.avg(d).alias(f"_m_{d}") for d in dims])
    spread = points.join(F.broadcast(centres), cluster).groupBy(cluster, *[f"_m_{d}" for d in dims]).agg(F.avg(F.sqrt(sum((F.col(d) - F.col(f"_m_{d}")) ** 2 for d in dims))).alias("_s"))
    a, b = spread.alias("a"), spread.alias("b")
    gap = F.sqrt(sum((F.col(f"a._m_{d}") - F.col(f"b._m_{d}")) ** 2 for d in dims))
    ratio = a.join(b, F.col(f"a.{cluster}") != F.col(f"b.{cluster}")).select(F.col(f"a.{cluster}").alias("c"), F.try_divide(F.col("a._s") + F.col("b._s"), gap).alias("r"))
    return ratio.groupBy("c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def id_sets(a: DataFrame, b: DataFrame, without: DataFrame, key: str = "cell_id") -> DataFrame:
    """key, kind of ids of a or b that are not in ``without``: in both, or in one of them only."""
    one = a.select(key).distinct().withColumn("_a", F.lit(1))
    two = b.select(key).distinct().withColumn("_b", F.lit(1))
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "first").otherwise("second")
    return one.join(two, key, "full").join(without.select(key), key, "left_anti").select(key, kind.alias("kind"))
