"""Vector layers: lines, polygons and buildings as columns of coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Road tags of the two classes that count.
MAJOR = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
MINOR = ["tertiary", "tertiary_link", "residential", "unclassified", "service", "living_street", "road", "busway"]
# Building tags by group.
TYPE_GROUPS = {
    "residential": ["apartments", "house", "residential", "detached", "semidetached_house", "terrace", "bungalow", "dormitory", "villa", "hut"],
    "commercial": ["commercial", "retail", "office", "hotel", "supermarket", "kiosk", "shop"],
    "industrial": ["industrial", "warehouse", "manufacture", "factory", "storage_tank"],
    "institutional": ["school", "college", "university", "hospital", "public", "government", "civic", "temple", "church", "mosque", "religious", "train_station", "transportation"],
}


def segments(vertices: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Consecutive vertices of each line as x1, y1, x2, y2."""
    w = Window.partitionBy(line).orderBy(order)
    return vertices.select(line, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def pieces(segs: DataFrame, step: float = 5.0, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Each line cut into n = ceil(L / step) equal pieces: weight L / n at the piece's midpoint (x, y).

    A segment emits the midpoints between its start and end along the line.
    """
    d = length(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    w = Window.partitionBy(line)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    s = segs.withColumn("d", d)
    s = s.withColumns({"s0": F.coalesce(F.sum("d").over(run), F.lit(0.0)), "L": F.sum("d").over(w)}).where("L > 0 and d > 0")
    s = s.withColumn("n", F.greatest(F.lit(1.0), F.ceil(F.col("L") / step).cast("double")))
    # k with s0 <= (k + 0.5) L / n < s0 + d
    lo = F.ceil(F.col("s0") * F.col("n") / F.col("L") - 0.5)
    hi = F.ceil((F.col("s0") + F.col("d")) * F.col("n") / F.col("L") - 0.5) - 1
    s = s.withColumns({"lo": F.greatest(lo, F.lit(0)), "hi": F.least(hi, F.col("n").cast("long") - 1)}).where("lo <= hi")
    k = s.withColumn("k", F.explode(F.sequence("lo", "hi")))
    t = ((F.col("k") + 0.5) * F.col("L") / F.col("n") - F.col("s0")) / F.col("d")
    return k.select(line, (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), (F.col("L") / F.col("n")).alias("weight"))


def length_per_cell(segs: DataFrame, cell_of: Column, step: float = 5.0) -> DataFrame:
    """cell_id, metres of line in it; what lies off the lattice (-1) is dropped."""
    return pieces(segs, step).withColumn("cell_id", cell_of).where("cell_id >= 0").groupBy("cell_id").agg(F.sum("weight").alias("metres"))


def road_class(tag: Column, tracks: bool = False) -> Column:
    """major or minor by the first of the tags, null for what does not count."""
    first = F.trim(F.split(tag, ";")[0])
    minor = MINOR + (["track"] if tracks else [])
    return F.when(first.isin(MAJOR), "major").when(first.isin(minor), "minor")


def type_group(tag: Column) -> Column:
    """Group of a building tag: unknown for none or yes, other for the rest."""
    t = F.lower(tag)
    chain = F.when(t.isNull() | (t == "yes"), "unknown")
    for group, tags in TYPE_GROUPS.items():
        chain = chain.when(t.isin(tags), group)
    return chain.otherwise("other")


def shoelace(ring: Column) -> Column:
    """Area of a ring, an array of structs x, y; the last vertex need not repeat the first."""
    n = F.size(ring)
    cross = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + ring[i].x * ring[(i + 1) % n].y - ring[(i + 1) % n].x * ring[i].y)
    return F.when(n >= 3, F.abs(cross) / 2).otherwise(0.0)


def centroid(ring: Column) -> Column:
    """Area centroid of a ring as struct x, y."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, i: Column) -> Column:
        p, q = ring[i], ring[(i + 1) % n]
        c = p.x * q.y - q.x * p.y
        return F.struct((s.a + c).alias("a"), (s.x + (p.x + q.x) * c).alias("x"), (s.y + (p.y + q.y) * c).alias("y"))

    s = F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)
    return F.struct((s.x / (3 * s.a)).alias("x"), (s.y / (3 * s.a)).alias("y"))


def clip_lines(segs: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Segments cut to a box (Liang-Barsky); those outside are dropped."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t0, t1, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, F.col("x1") - left), (dx, right - F.col("x1")), (-dy, F.col("y1") - bottom), (dy, top - F.col("y1"))):
        t = F.try_divide(q, p)
        t0 = F.when(p < 0, F.greatest(t0, t)).otherwise(t0)
        t1 = F.when(p > 0, F.least(t1, t)).otherwise(t1)
        out = out | ((p == 0) & (q < 0))
    s = segs.withColumns({"_t0": t0, "_t1": t1, "_out": out}).where("not _out and _t0 < _t1")
    rest = [c for c in segs.columns if c not in ("x1", "y1", "x2", "y2")]
    return s.select(*rest, (F.col("x1") + F.col("_t0") * dx).alias("x1"), (F.col("y1") + F.col("_t0") * dy).alias("y1"), (F.col("x1") + F.col("_t1") * dx).alias("x2"), (F.col("y1") + F.col("_t1") * dy).alias("y2"))


def clean_buildings(buildings: DataFrame, low: float = 10.0, high: float = 100_000.0) -> DataFrame:
    """Buildings of a credible area; ``yes`` for no type."""
    return buildings.where(F.col("area_m2").between(low, high)).withColumn("building_type", F.coalesce("building_type", F.lit("yes")))


def buildings_per_cell(buildings: DataFrame, cell_area: float) -> DataFrame:
    return buildings.where("cell_id >= 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("bldg_count"), F.least(F.lit(1.0), F.sum("area_m2") / cell_area).alias("bldg_area_frac"))


def reference_cells(buildings: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Cells with buildings: number, area, the most frequent typed group (first by bldg_id among equals), source.

    mapped: further cells (cell_id) that a land-cover map gives.
    """
    grouped = buildings.where("cell_id >= 0").withColumn("group", type_group(F.col("building_type")))
    by_type = grouped.where("group <> 'unknown'").groupBy("cell_id", "group").agg(F.count(F.lit(1)).alias("n"), F.min("bldg_id").alias("first"))
    main = by_type.groupBy("cell_id").agg(F.min_by("group", F.struct(-F.col("n"), F.col("first"))).alias("main_type"))
    sums = grouped.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_buildings"), F.sum("area_m2").alias("bldg_area_m2"))
    out = sums.join(main, "cell_id", "left")
    if mapped is None:
        return out.select("cell_id", F.lit("osm").alias("source"), "n_buildings", "bldg_area_m2", F.coalesce("main_type", F.lit("unknown")).alias("main_type"))
    m = mapped.select("cell_id").distinct().withColumn("_mapped", F.lit(True))
    j = out.join(m, "cell_id", "full")
    source = F.when(F.col("n_buildings").isNull(), "esri").when(F.col("_mapped"), "both").otherwise("osm")
    return j.select("cell_id", source.alias("source"), F.coalesce("n_buildings", F.lit(0)).alias("n_buildings"), F.coalesce("bldg_area_m2", F.lit(0.0)).alias("bldg_area_m2"), F.coalesce("main_type", F.lit("unknown")).alias("main_type"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def densify(low: tuple[float, float], high: tuple[float, float], n: int = 21) -> list[tuple[float, float]]:
    """Points along the border of a box, for its bounds in another projection."""
    (a, b), (c, d) = low, high
    t = [i / (n - 1) for i in range(n)]
    return [(a + (c - a) * k, b) for k in t] + [(c, b + (d - b) * k) for k in t] + [(c - (c - a) * k, d) for k in t] + [(a, d - (d - b) * k) for k in t]


def line_lengths(segs: DataFrame, by: str) -> DataFrame:
    return segs.groupBy(by).agg((F.sum(length(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])) / 1000).alias("km"))


def area_square_km(rings: DataFrame, by: str, ring: str = "ring") -> DataFrame:
    return rings.groupBy(by).agg((F.sum(shoelace(F.col(ring))) / 1e6).alias("km2"))


def disk_area(radius_cells: int, cell: float) -> float:
    """Square kilometres of the cells of a whole disk."""
    return sum(2 * math.isqrt(radius_cells**2 - dy**2) + 1 for dy in range(-radius_cells, radius_cells + 1)) * (cell / 1000) ** 2


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)
