"""Ranks, percentiles and metrics of rankings without a global single-task window.

Ranks come from counts of distinct values, range-partitioned and summed up in two
steps: partition totals, of which there are as many as partitions, and a window
within each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import materialise


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by group and order, with their partition; written, so that it stays as it is."""
    return materialise(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, by: list[str], value: Column) -> DataFrame:
    """For each group and partition, the sum of ``value`` over the group's earlier partitions."""
    sums = parts.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))


def row_numbers(df: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "n") -> DataFrame:
    """Adds the number of each row, from 1, in its group by the order."""
    by = by or []
    rows = _ranged(df, by, order)
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    joined = rows.withColumn("_local", local).join(F.broadcast(_before(rows, by, F.lit(1))) if not by else _before(rows, by, F.lit(1)), [*by, "_part"])
    return joined.withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def cumulative(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """One row a distinct value and group, with each sum over it (``name``) and over all before it (``name_before``)."""
    by = by or []
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    rows = _ranged(df.groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()]), by, order)
    w = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    up = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{k}").over(up), F.lit(0)).alias(f"_{k}") for k in sums])
    local = rows.select("*", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"{k}_here") for k in sums])
    return local.join(offsets, [*by, "_part"]).select(*by, value, *sums, *[(F.col(f"{k}_here") + F.col(f"_{k}")).alias(f"{k}_before") for k in sums])


def pct_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "pct") -> DataFrame:
    """Adds the average rank of ties over the number of values in the group; null for null."""
    by = by or []
    known = df.where(F.col(value).isNotNull())
    ranks = cumulative(known, value, {"_n": F.count(F.lit(1))}, by)
    totals = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    ranks = ranks.join(totals, by) if by else ranks.crossJoin(F.broadcast(totals))
    ranks = ranks.select(*by, value, ((F.col("_n_before") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(out))
    return df.join(ranks, [*by, value], "left")


def auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``auc`` a group: the share of pairs ordered right, ties half; null unless both classes are there."""
    by = by or []
    flag = F.col(y).cast("int")
    steps = cumulative(df.where(F.col(y).isNotNull() & F.col(score).isNotNull()), score, {"pos": F.sum(flag), "neg": F.sum(1 - flag)}, by)
    won = F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg")))
    return steps.groupBy(*by).agg(F.try_divide(won.cast("double"), (2 * F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))


def roc_curve(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """threshold, fpr, tpr at each distinct score, falling."""
    by = by or []
    flag = F.col(y).cast("int")
    steps = cumulative(df, score, {"pos": F.sum(flag), "neg": F.sum(1 - flag)}, by, descending=True)
    totals = df.groupBy(*by).agg(F.sum(flag).alias("_p"), F.sum(1 - flag).alias("_q"))
    steps = steps.join(totals, by) if by else steps.crossJoin(F.broadcast(totals))
    return steps.select(*by, F.col(score).alias("threshold"), F.try_divide(F.col("neg_before") + F.col("neg"), F.col("_q")).alias("fpr"), F.try_divide(F.col("pos_before") + F.col("pos"), F.col("_p")).alias("tpr"))


def top_n(df: DataFrame, y: str, score: str, fractions: list[float], by: list[str] | None = None, tie: str = "cell_id") -> DataFrame:
    """n, hits, precision, recall and lift of the best-scored share, n = max(1, rint(fraction * N))."""
    by = by or []
    ranked = row_numbers(df.select(*by, y, score, tie), [F.col(score).desc(), F.col(tie).asc()], by)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col(y).cast("int")).alias("_hits"))
    totals = totals.withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions])))
    totals = totals.withColumn("top", F.greatest(F.lit(1), F.rint(F.col("fraction") * F.col("_all")).cast("long")))
    joined = ranked.join(F.broadcast(totals), by) if by else ranked.crossJoin(F.broadcast(totals))
    hits = joined.where("n <= top").groupBy(*by, "fraction", "top", "_all", "_hits").agg(F.sum(F.col(y).cast("int")).alias("hits"))
    precision = F.col("hits") / F.col("top")
    return hits.select(*by, "fraction", F.col("top").alias("n"), F.col("hits").cast("long").alias("hits"), precision.alias("precision"), F.try_divide(F.col("hits"), F.col("_hits")).alias("recall"), F.try_divide(precision, F.col("_hits") / F.col("_all")).alias("lift"))


def toc_curve(df: DataFrame, y: str, score: str, by: list[str] | None = None, points: int = 100, tie: str = "cell_id") -> DataFrame:
    """Shares flagged and hit at points + 1 even positions of the ranking, to four digits."""
    by = by or []
    ranked = row_numbers(df.select(*by, y, score, tie), [F.col(score).desc(), F.col(tie).asc()], by)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col(y).cast("int")).alias("_hits"))
    at = totals.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("position", F.rint(F.col("point") * F.col("_all") / points).cast("long"))
    hits = ranked.where(F.col(y).cast("int") == 1).select(*by, "n")
    # Each hit counts once, at the first point whose position reaches it; then points add up.
    all_ = hits.join(totals, by) if by else hits.crossJoin(F.broadcast(totals))
    near = F.floor(F.col("n") * points / F.col("_all")).cast("int")
    first = F.filter(F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 2, F.lit(points))), lambda p: F.rint(p * F.col("_all") / points) >= F.col("n"))[0]
    counts = all_.groupBy(*by, first.alias("point")).agg(F.count(F.lit(1)).alias("here"))
    up_to = Window.partitionBy(*by).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)  # points + 1 rows a group
    joined = at.select(*by, "point").join(counts, [*by, "point"], "left").select(*by, "point", F.sum(F.coalesce("here", F.lit(0))).over(up_to).alias("hits"))
    out = at.join(joined, [*by, "point"], "left")
    return out.select(*by, "point", F.round(F.col("position") / F.col("_all"), 4).alias("flagged"), F.round(F.try_divide(F.coalesce("hits", F.lit(0)), F.col("_hits")), 4).alias("hit_share"))


def perfect_line(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """flagged, hit_share: the corners of the best possible curve, which finds all hits first."""
    by = by or []
    share = df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("_p"))
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(a).cast("double").alias("flagged") if a is not None else F.col("_p").alias("flagged"), F.lit(b).cast("double").alias("hit_share")) for i, (a, b) in enumerate(((0, 0), (None, 1), (1, 1)))])
    return share.select(*by, F.inline(corners))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """share, quantile: exact quantiles, interpolated between the two values next to them, which are picked by their numbers."""
    by = by or []
    numbered = row_numbers(df.select(*by, value).where(F.col(value).isNotNull()), [F.col(value)], by, out="_i")
    place = F.col("share") * (F.col("_all") - 1) + 1
    wanted = numbered.groupBy(*by).agg(F.max("_i").alias("_all")).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.select(*by, "share", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_i"), place.alias("_place"))
    ends = numbered.join(F.broadcast(wanted) if not by else wanted, [*by, "_i"])
    low, high = F.min_by(value, "_i"), F.max_by(value, "_i")
    return ends.groupBy(*by, "share", "_place").agg((low + (high - low) * (F.col("_place") - F.floor("_place"))).alias("quantile")).drop("_place")


def _cuts(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """A row a group, with each quantile under its name."""
    q = quantiles(df, value, sorted(set(shares.values())), by)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(k) for k, s in shares.items()])


def quantile_classes(df: DataFrame, score: str, quantiles=(0.9, 0.7, 0.4), by: list[str] | None = None, out: str = "class") -> DataFrame:
    """Adds 1 for scores from the first quantile on, 2 and 3 likewise, else 4; exact, interpolated quantiles."""
    by = by or []
    cuts = _cuts(df, score, {f"_q{i}": float(q) for i, q in enumerate(quantiles)}, by)
    joined = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))
    chain = F.lit(len(quantiles) + 1)
    for i in reversed(range(len(quantiles))):
        chain = F.when(F.col(score) >= F.col(f"_q{i}"), i + 1).otherwise(chain)
    return joined.withColumn(out, chain).drop(*[f"_q{i}" for i in range(len(quantiles))])


def rescale(df: DataFrame, distance: str, low: float = 0.01, high: float = 0.99, out: str = "score") -> DataFrame:
    """1 - (d - p1) / (p99 - p1), clipped to 0..1; 1 where p99 <= p1."""
    cuts = _cuts(df, distance, {"_lo": low, "_hi": high}, [])
    share = F.try_divide(F.col(distance) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    value = F.when(F.col("_hi") > F.col("_lo"), 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(1.0)
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, value).drop("_lo", "_hi")
