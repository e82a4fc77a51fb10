"""Queries of the lattice, raster, focal, proximity and vector operators over the views, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HARMONISED, RANDOM_INDEX  # noqa: F401
from ..functions import geodesy
from ..operators import lattice, patches, proximity, raster, vector
from ..sources import views
from ..sources.views import CELL, COLS, HEIGHT, sql

RING = [(350.0, -120.0), (4300.0, -80.0), (3900.0, -2700.0), (2100.0, -1500.0), (420.0, -3600.0)]
HOLE = [(1500.0, -500.0), (2500.0, -520.0), (2300.0, -1100.0)]
EDGES = [(*p, *q) for ring in (RING, HOLE) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def fractions(spark, sf) -> DataFrame:
    return raster.class_fractions(views.pixel(spark, sf), ["cell_id", "yr"])


def built(spark, sf) -> DataFrame:
    """The lattice with shares of the latest year; 0 where a cell has no pixels."""
    frac = fractions(spark, sf).where(f"yr = {views.YEARS['latest']}").select("cell_id", "frac_built", "frac_tree", "frac_water")
    return views.cell(spark, sf).join(frac, "cell_id", "left").select("cell_id", "row", "col", "x", "y", "size", "elev", *[F.coalesce(f"frac_{k}", F.lit(0.0)).alias(k) for k in ("built", "tree", "water")])


def as_cell(x="x", y="y"):
    return lattice.cell_of(F.col(x), F.col(y), HEIGHT // int(CELL), COLS, CELL)


AS_CELL = f"CASE WHEN floor(x / 100) BETWEEN 0 AND {COLS - 1} AND floor(-y / 100) BETWEEN 0 AND {HEIGHT // 100 - 1} THEN (floor(-y / 100) * {COLS} + floor(x / 100))::BIGINT ELSE -1 END"
FRACS = ["frac_water", "frac_tree", "frac_flooded", "frac_crop", "frac_built", "frac_bare", "frac_snow", "frac_range", "nodata_frac"]


def rounds(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(sql("cell", 'SELECT cell_id, r AS "row", c AS col, x, y FROM cell'))
def cell_grid(spark, sf):
    return views.cell(spark, sf).select("cell_id", "row", "col", "x", "y")


@query("SELECT count(*) AS n, sum(i) AS ids, sum((i % 50 + 0.5::DOUBLE) * 100) AS xs FROM range(2000) t(i)")
def generated_grid(spark, sf):
    return lattice.grid(spark, 40, 50, 100.0).agg(F.count(F.lit(1)).alias("n"), F.sum("cell_id").alias("ids"), F.sum("x").alias("xs"))


@query(sql("building", f"SELECT bldg_id, {AS_CELL} AS cell_id FROM building"))
def xy_to_cell(spark, sf):
    return views.building(spark, sf).select("bldg_id", as_cell().alias("cell_id"))


_CROSS = "((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"
_EDGES = "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {int(i >= len(RING))})" for i, (a, b, c, d) in enumerate(EDGES)) + ") t(x1, y1, x2, y2, polygon)"


@query(sql("cell", f"SELECT cell_id FROM cell, edge WHERE {_CROSS} GROUP BY cell_id HAVING count(*) % 2 = 1", edge=_EDGES))
def aoi_mask_raycast(spark, sf):
    return views.cell(spark, sf).where(lattice.inside(F.col("x"), F.col("y"), [RING, HOLE])).select("cell_id")


_PIXELS = "SELECT i AS pixel_id, i // 100 AS r, i % 100 AS c, (i % 100 + 0.5::DOUBLE) * 50 AS x, -(i // 100 + 0.5::DOUBLE) * 50 AS y FROM range(8000) t(i)"


def pixel_grid(spark) -> DataFrame:
    return lattice.grid(spark, 80, 100, 50.0).withColumnRenamed("cell_id", "pixel_id")


@query(sql("cell", f"SELECT (r // 2) * 50 + c // 2 AS cell_id, count(hit.pixel_id) / 4 AS frac FROM pix LEFT JOIN hit ON pix.pixel_id = hit.pixel_id GROUP BY 1", pix=_PIXELS, edge=_EDGES, hit=f"SELECT DISTINCT pixel_id FROM (SELECT pixel_id, polygon FROM pix, edge WHERE {_CROSS} GROUP BY pixel_id, polygon HAVING count(*) % 2 = 1)"))
def rasterize_polygon(spark, sf):
    edges = spark.createDataFrame([(*e, int(i >= len(RING))) for i, e in enumerate(EDGES)], "x1 double, y1 double, x2 double, y2 double, polygon int")
    pixels = pixel_grid(spark)
    hit = lattice.inside_edges(pixels, edges, "pixel_id", 200.0).withColumn("hit", F.lit(1))
    cells = pixels.join(hit, "pixel_id", "left").groupBy((F.floor(F.col("row") / 2) * 50 + F.floor(F.col("col") / 2)).alias("cell_id"))
    return cells.agg((F.count("hit") / 4).alias("frac"))


@query("SELECT c_custkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(floor((lon + 180) / 6)::BIGINT + 1, 60) AS epsg FROM (SELECT c_custkey, (c_custkey * 37) % 361 - 180 AS lon, (c_custkey * 13) % 161 - 80 AS lat FROM customer)")
def utm_zone(spark, sf):
    c = views.read(spark, sf, "customer").selectExpr("c_custkey", "(c_custkey * 37) % 361 - 180 as lon", "(c_custkey * 13) % 161 - 80 as lat")
    return c.select("c_custkey", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("SELECT c_custkey, round(72 + (c_custkey * 37) % 600 / 100.0, 6)::DOUBLE AS lon, round((c_custkey * 13) % 8000 / 100.0, 6)::DOUBLE AS lat, TRUE AS zone_43 FROM customer")
def utm_round_trip(spark, sf):
    c = views.read(spark, sf, "customer").selectExpr("c_custkey", "72 + (c_custkey * 37) % 600 / 100.0D as lon", "(c_custkey * 13) % 8000 / 100.0D as lat")
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), F.lit(43))
    lon, lat = geodesy.from_utm(F.col("e"), F.col("n"), F.lit(43))
    return c.withColumns({"e": e, "n": n}).select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.col("e").between(100_000, 900_000).alias("zone_43"))


_LUT = "CASE " + " ".join(f"WHEN raw = {k} THEN {v}" for k, v in HARMONISED.items()) + " ELSE 0 END"


@query(sql("pixel", f"SELECT {_LUT} AS code, count(*) AS n FROM (SELECT (h * 10 + cell_id % 3 * 5)::INT AS raw FROM pixel) GROUP BY 1"))
def harmonise_lut(spark, sf):
    raw = views.pixel(spark, sf).select((F.col("h") * 10 + F.col("cell_id") % 3 * 5).cast("int").alias("raw"))
    return raw.groupBy(raster.harmonise(F.col("raw"), HARMONISED).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("frac", f"SELECT cell_id, yr, {rounds(FRACS)} FROM frac"))
def class_fractions(spark, sf):
    return fractions(spark, sf).select("cell_id", "yr", *r6(*FRACS))


@query(sql("frac", "SELECT yr, round(avg(nodata_frac), 6) AS nodata, count(*) FILTER (nodata_frac > 0.5) AS over FROM frac GROUP BY yr"))
def nodata_fraction(spark, sf):
    return fractions(spark, sf).groupBy("yr").agg(F.round(F.avg("nodata_frac"), 6).alias("nodata"), F.count_if(F.col("nodata_frac") > 0.5).alias("over"))


@query(sql("pixel", "SELECT cell_id, round(avg(v), 6) AS v_mean, max(v) AS v_max FROM pixel GROUP BY cell_id"))
def block_mean_max(spark, sf):
    s = raster.block_stats(views.pixel(spark, sf), ["cell_id"], "v")
    return s.select("cell_id", F.round("v_mean", 6).alias("v_mean"), "v_max")


def _ring_sql(n: int) -> str:
    return sql("built", f"SELECT a.cell_id, " + ", ".join(f"round(CASE WHEN count(*) > 1 THEN greatest(0, least(1, (sum(b.{v}) - a.{v}) / (count(*) - 1))) ELSE 0 END, 6) AS ring_{v}" for v in ("built", "tree", "water")) + f" FROM built a JOIN built b ON abs(a.r - b.r) <= {n} AND abs(a.c - b.c) <= {n} GROUP BY a.cell_id, a.built, a.tree, a.water")


def _rings(spark, sf, radius):
    n = raster.ring_cells(radius, CELL)
    out = raster.ring_means(built(spark, sf), ["built", "tree", "water"], {"": n})
    return out.select("cell_id", *[F.round(f"ring_{v}", 6).alias(f"ring_{v}") for v in ("built", "tree", "water")])


@query(_ring_sql(2))
def ring_mean_250(spark, sf):
    return _rings(spark, sf, 250)


@query(_ring_sql(5))
def ring_mean_500(spark, sf):
    return _rings(spark, sf, 500)


@query(sql("cell", "SELECT a.cell_id, sum(b.size)::DOUBLE AS disk, count(*) AS disk_n FROM cell a JOIN cell b ON (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 25 GROUP BY a.cell_id"))
def disk_density(spark, sf):
    return raster.disk_sums(views.cell(spark, sf), "size", 5).select("cell_id", "disk", "disk_n")


def _horn_sql(what: str) -> str:
    v = {}
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            v[i, j] = f"coalesce(n{i + 1}{j + 1}.elev, 0)"
    pads = "SELECT r, c, elev::DOUBLE AS elev FROM cell UNION ALL SELECT a.r, a.c - 1, 2 * a.elev - b.elev FROM cell a JOIN cell b ON a.r = b.r AND b.c = a.c + 1 WHERE a.c = 0 UNION ALL SELECT a.r, a.c + 1, 2 * a.elev - b.elev FROM cell a JOIN cell b ON a.r = b.r AND b.c = a.c - 1 WHERE a.c = 49"
    full = "SELECT * FROM wide UNION ALL SELECT a.r - 1, a.c, 2 * a.elev - b.elev FROM wide a JOIN wide b ON a.c = b.c AND b.r = a.r + 1 WHERE a.r = 0 UNION ALL SELECT a.r + 1, a.c, 2 * a.elev - b.elev FROM wide a JOIN wide b ON a.c = b.c AND b.r = a.r - 1 WHERE a.r = (SELECT max(r) FROM cell)"
    weight = lambda i, j: {0: 2, 1: 1, -1: 1}
    dx = " + ".join(f"sum(CASE WHEN f.r - a.r = {i} AND f.c - a.c = {j} THEN {j * (2 if i == 0 else 1)} * f.elev ELSE 0 END)" for i in (-1, 0, 1) for j in (-1, 1))
    dy = " + ".join(f"sum(CASE WHEN f.r - a.r = {i} AND f.c - a.c = {j} THEN {-i * (2 if j == 0 else 1)} * f.elev ELSE 0 END)" for i in (-1, 1) for j in (-1, 0, 1))
    grad = f"SELECT a.cell_id, ({dx}) / 800 AS dx, ({dy}) / 800 AS dy FROM cell a JOIN full_ f ON abs(f.r - a.r) <= 1 AND abs(f.c - a.c) <= 1 GROUP BY a.cell_id"
    pick = {"slope": "round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope", "aspect": "CASE WHEN dx = 0 AND dy = 0 THEN NULL ELSE round((degrees(atan2(-dx, -dy)) + 360) % 360, 6) END AS aspect"}[what]
    return sql("cell", f"SELECT cell_id, {pick} FROM grad", wide=pads, full_=full, grad=grad)


@query(_horn_sql("slope"))
def horn_slope(spark, sf):
    return raster.horn(views.cell(spark, sf), "elev", CELL).select("cell_id", F.round("slope", 6).alias("slope"))


@query(_horn_sql("aspect"))
def horn_aspect(spark, sf):
    return raster.horn(views.cell(spark, sf), "elev", CELL).select("cell_id", F.round("aspect", 6).alias("aspect"))


@query(sql("cell", "SELECT a.cell_id, max(b.size) AS dilated FROM cell a JOIN cell b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.cell_id"))
def grey_dilation(spark, sf):
    return raster.dilate(views.cell(spark, sf), "size", 2).select("cell_id", "dilated")


_TARGET = "SELECT i AS pixel_id, (i % 60 + 0.5::DOUBLE) * 90 - 60 AS x, 60 - (i // 60 + 0.5::DOUBLE) * 90 AS y FROM range(1200) t(i)"


def _target(spark) -> DataFrame:
    return spark.range(1200).select(F.col("id").alias("pixel_id"), ((F.col("id") % 60 + 0.5) * 90 - 60).alias("x"), (60 - (F.floor(F.col("id") / 60) + 0.5) * 90).alias("y"))


@query(sql("cell", "SELECT pixel_id, elev FROM target LEFT JOIN cell ON cell.c = floor(target.x / 100) AND cell.r = floor(-target.y / 100)", target=_TARGET))
def nearest_resample(spark, sf):
    return raster.resample_nearest(_target(spark), views.cell(spark, sf), "elev", CELL)


@query(
    sql(
        "cell",
        "SELECT t.pixel_id, round(sum(w * elev) / sum(w), 6) AS elev FROM target t LEFT JOIN (SELECT pixel_id, w, elev FROM corner JOIN cell ON cell.c = cc AND cell.r = rr WHERE w > 0) k ON t.pixel_id = k.pixel_id GROUP BY t.pixel_id",
        target=_TARGET,
        corner="SELECT pixel_id, floor(v) + i AS rr, floor(u) + j AS cc, (1 - i + (2 * i - 1) * (v - floor(v))) * (1 - j + (2 * j - 1) * (u - floor(u))) AS w FROM (SELECT pixel_id, x / 100 - 0.5 AS u, -y / 100 - 0.5 AS v FROM target), range(2) a(i), range(2) b(j)",
    )
)
def bilinear_resample(spark, sf):
    return raster.resample_bilinear(_target(spark), views.cell(spark, sf), "elev", CELL).select("pixel_id", F.round("elev", 6).alias("elev"))


def _components_sql(near: str) -> str:
    return sql("cell", "SELECT cell_id, min(root) AS patch FROM reach GROUP BY cell_id", mark="SELECT cell_id, r, c FROM cell WHERE (size * 7 + r * 3 + c) % 10 < 3", reach=f"SELECT cell_id, r, c, cell_id AS root FROM mark UNION SELECT m.cell_id, m.r, m.c, reach.root FROM reach JOIN mark m ON {near}")


def _marked(spark, sf):
    return views.cell(spark, sf).where("(size * 7 + row * 3 + col) % 10 < 3")


@query(_components_sql("abs(m.r - reach.r) + abs(m.c - reach.c) = 1"))
def components_4(spark, sf):
    return patches.patches(_marked(spark, sf), COLS)


@query(_components_sql("greatest(abs(m.r - reach.r), abs(m.c - reach.c)) = 1"))
def components_8(spark, sf):
    return patches.patches(_marked(spark, sf), COLS, eight=True)


@query(sql("cell", "SELECT sum(side)::BIGINT AS sides FROM (SELECT a.cell_id, 4 - count(b.cell_id) AS side FROM m a LEFT JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.cell_id)", m="SELECT * FROM cell WHERE (size * 7 + r * 3 + c) % 10 < 3"))
def patch_outline(spark, sf):
    marked = _marked(spark, sf)
    labelled = patches.patches(marked, COLS).join(marked.select("cell_id", "row", "col"), "cell_id")
    return patches.outline(labelled).agg(F.count(F.lit(1)).alias("sides"))


@query(
    sql(
        "cell",
        "SELECT cell_id, CASE WHEN CASE WHEN ob + ab > 0 THEN ob > ab ELSE oa > aa END THEN 'outlying' ELSE 'adjacent' END AS lei_type FROM (SELECT (r // 2) * 25 + c // 2 AS cell_id, count(*) FILTER (outlying AND big) AS ob, count(*) FILTER (NOT outlying AND big) AS ab, count(*) FILTER (outlying) AS oa, count(*) FILTER (NOT outlying) AS aa FROM lab JOIN kind USING (label) GROUP BY 1)",
        px="SELECT cell_id, r, c, size % 9 = 0 AND c < 20 AS old, (size * 7 + r * 3 + c) % 10 < 2 AND NOT (size % 9 = 0 AND c < 20) AS new FROM cell",
        reach="SELECT cell_id, r, c, cell_id AS root FROM px WHERE new UNION SELECT m.cell_id, m.r, m.c, reach.root FROM reach JOIN px m ON m.new AND greatest(abs(m.r - reach.r), abs(m.c - reach.c)) = 1",
        patch="SELECT cell_id, any_value(r) AS r, any_value(c) AS c, min(root) AS p FROM reach GROUP BY cell_id",
        lab="SELECT *, dense_rank() OVER (ORDER BY p) AS label FROM patch",
        ring="SELECT px.cell_id, px.old, max(lab.label) AS label FROM px JOIN lab ON abs(px.r - lab.r) <= 2 AND abs(px.c - lab.c) <= 2 WHERE NOT px.new GROUP BY px.cell_id, px.old",
        kind="SELECT s.label, coalesce(n > 0 AND o = 0, FALSE) AS outlying, s.size >= 3 AS big FROM (SELECT label, count(*) AS size FROM lab GROUP BY label) s LEFT JOIN (SELECT label, count(*) AS n, count(*) FILTER (old) AS o FROM ring GROUP BY label) g ON s.label = g.label",
    )
)
def lei_type(spark, sf):
    old = "size % 9 = 0 and col < 20"
    px = views.cell(spark, sf).selectExpr("row", "col", f"{old} as old", f"(size * 7 + row * 3 + col) % 10 < 2 and not ({old}) as new")
    return patches.growth_types(px, COLS, 2, 3, 2)


_NEAR = "round(least(coalesce(min(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))), {cap}), {cap}), 6) AS distance"


def _class_points(spark, sf, code=1, year=2001):
    """Pixels of a class, spread in their cell by their hash."""
    p = views.pixel(spark, sf).where(f"code = {code} and yr = {year}")
    return p.selectExpr("cell_id as own", f"(cell_id % {COLS}) * 100 + 10 * h + 5D as x", f"-((cell_id div {COLS}) * 100 + 10 * (cast(v as bigint) % 10) + 5D) as y").distinct()


_POINTS = f"SELECT DISTINCT cell_id AS own, (cell_id % {COLS}) * 100 + 10 * h + 5::DOUBLE AS x, -((cell_id // {COLS}) * 100 + 10 * (v::BIGINT % 10) + 5::DOUBLE) AS y FROM pixel WHERE code = 1 AND yr = 2001"


@query(sql("cell pixel", f"SELECT q.cell_id, {_NEAR.format(cap=1500)} FROM cell q, p GROUP BY q.cell_id", p=_POINTS))
def dist_to_class(spark, sf):
    return proximity.nearest_point(views.cell(spark, sf), _class_points(spark, sf), 1500.0).select("cell_id", F.round("distance", 6).alias("distance"))


@query(sql("cell pixel", f"SELECT q.cell_id, {_NEAR.format(cap=1500)} FROM cell q LEFT JOIN p ON p.own <> q.cell_id GROUP BY q.cell_id", p=_POINTS))
def dist_outside_cell(spark, sf):
    return proximity.nearest_point(views.cell(spark, sf), _class_points(spark, sf), 1500.0, outside="own").select("cell_id", F.round("distance", 6).alias("distance"))


_T = "CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0 END"


@query(sql("cell segment", f"SELECT cell_id, round(coalesce(least(min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)), 800), 800), 6) AS distance FROM (SELECT cell_id, x, y, x1, y1, x2, y2, {_T} AS t FROM cell LEFT JOIN segment ON x BETWEEN least(x1, x2) - 800 AND greatest(x1, x2) + 800 AND y BETWEEN least(y1, y2) - 800 AND greatest(y1, y2) + 800) GROUP BY cell_id"))
def nearest_line_dist(spark, sf):
    return proximity.nearest_line(views.cell(spark, sf), vector.segments(views.vertex(spark, sf)), 800.0, bucket=200.0).select("cell_id", F.round("distance", 6).alias("distance"))


_LENGTH = {
    "m": "SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS d FROM segment",
    "s": "SELECT *, coalesce(sum(d) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(d) OVER (PARTITION BY line_id) AS l FROM m",
    "k": "SELECT line_id, l / n AS weight, (k + 0.5::DOUBLE) * l / n AS t FROM (SELECT line_id, l, greatest(1, ceil(l / 25)) AS n, unnest(range(greatest(1, ceil(l / 25))::BIGINT)) AS k FROM (SELECT DISTINCT ON (line_id) line_id, l FROM s ORDER BY line_id, seq) WHERE l > 0)",
    "spot": "SELECT k.weight, x1 + (t - s0) / d * (x2 - x1) AS x, y1 + (t - s0) / d * (y2 - y1) AS y FROM k JOIN s ON k.line_id = s.line_id AND t >= s0 AND t < s0 + d",
    "metres": f"SELECT cell_id, round(sum(weight), 4) AS metres FROM (SELECT weight, {AS_CELL} AS cell_id FROM spot) WHERE cell_id >= 0 GROUP BY cell_id",
}


def _metres(spark, sf):
    return vector.length_per_cell(vector.segments(views.vertex(spark, sf)), as_cell(), 25.0)


@query(sql("segment", "SELECT cell_id, round(metres, 0) AS metres FROM metres", **_LENGTH))
def road_length_per_cell(spark, sf):
    return _metres(spark, sf).select("cell_id", F.round("metres", 0).alias("metres"))


@query(sql("cell segment", "SELECT a.cell_id, round(sum(coalesce(metres, 0)) / 1000 / (count(*) * 0.01::DOUBLE), 3) AS density FROM cell a JOIN cell b ON (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 25 LEFT JOIN metres ON b.cell_id = metres.cell_id GROUP BY a.cell_id", **_LENGTH))
def road_density(spark, sf):
    cells = views.cell(spark, sf).join(_metres(spark, sf), "cell_id", "left").withColumn("metres", F.coalesce(F.round("metres", 4), F.lit(0.0)))
    disk = raster.disk_sums(cells, "metres", 5)
    return disk.select("cell_id", F.round(F.greatest(F.lit(0.0), F.col("disk") / 1000 / (F.col("disk_n") * (CELL / 1000) ** 2)), 3).alias("density"))


_TAG = "CASE {k} % 7 WHEN 0 THEN 'primary;secondary' WHEN 1 THEN ' residential ' WHEN 2 THEN 'track' WHEN 3 THEN 'footway' WHEN 4 THEN NULL WHEN 5 THEN 'trunk_link' ELSE 'service; primary' END"


@query(f"SELECT cls, count(*) AS n FROM (SELECT CASE WHEN t IN ({', '.join(repr(x) for x in vector.MAJOR)}) THEN 'major' WHEN t IN ({', '.join(repr(x) for x in vector.MINOR)}) THEN 'minor' END AS cls FROM (SELECT trim(split_part({_TAG.format(k='p_partkey')}, ';', 1)) AS t FROM part)) GROUP BY cls")
def classify_roads(spark, sf):
    tags = views.read(spark, sf, "part").select(F.expr(_TAG.format(k="p_partkey")).alias("tag"))
    return tags.groupBy(vector.road_class(F.col("tag")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'water_body' AS kind FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0 UNION ALL SELECT 'waterway' FROM part WHERE p_size % 2 = 1 AND p_partkey % 5 = 0) GROUP BY kind")
def water_kinds(spark, sf):
    layer = views.read(spark, sf, "part").selectExpr("p_size % 2 = 0 as is_polygon", "if(p_partkey % 3 = 0, 'water', null) as natural", "if(p_partkey % 5 = 0, 'river', null) as waterway")
    bodies = layer.where("is_polygon and natural = 'water'").select(F.lit("water_body").alias("kind"))
    ways = layer.where("not is_polygon and waterway is not null").select(F.lit("waterway").alias("kind"))
    return bodies.unionByName(ways).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(sql("building", "SELECT building_type, count(*) AS n, round(min(area_m2), 6) AS low, round(max(area_m2), 6) AS high FROM (SELECT coalesce(CASE WHEN bldg_id % 9 = 0 THEN NULL ELSE building_type END, 'yes') AS building_type, area_m2 FROM building WHERE area_m2 BETWEEN 10 AND 300) GROUP BY 1"))
def building_filter(spark, sf):
    b = views.building(spark, sf).withColumn("building_type", F.when(F.col("bldg_id") % 9 != 0, F.col("building_type")))
    return vector.clean_buildings(b, 10, 300).groupBy("building_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("area_m2"), 6).alias("low"), F.round(F.max("area_m2"), 6).alias("high"))


@query(sql("building", f"SELECT cell_id, count(*) AS bldg_count, round(least(1, sum(area_m2) / 2000), 6) AS bldg_area_frac FROM (SELECT *, {AS_CELL} AS cell_id FROM building) WHERE cell_id >= 0 GROUP BY cell_id"))
def building_per_cell(spark, sf):
    b = views.building(spark, sf).withColumn("cell_id", as_cell())
    return vector.buildings_per_cell(b, 2000.0).select("cell_id", "bldg_count", F.round("bldg_area_frac", 6).alias("bldg_area_frac"))


_KIND = "CASE {k} % 8 WHEN 0 THEN 'Apartments' WHEN 1 THEN 'yes' WHEN 2 THEN NULL WHEN 3 THEN 'temple' WHEN 4 THEN 'garage' WHEN 5 THEN 'warehouse' WHEN 6 THEN 'hotel' ELSE 'house' END"
_GROUP = "CASE WHEN lower(t) IS NULL OR lower(t) = 'yes' THEN 'unknown' " + " ".join(f"WHEN lower(t) IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in vector.TYPE_GROUPS.items()) + " ELSE 'other' END"


@query(f"SELECT {_GROUP} AS grp, count(*) AS n FROM (SELECT {_KIND.format(k='o_orderkey')} AS t FROM orders) GROUP BY 1")
def type_group(spark, sf):
    t = views.read(spark, sf, "orders").select(F.expr(_KIND.format(k="o_orderkey")).alias("t"))
    return t.groupBy(vector.type_group(F.col("t")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def _typed(spark, sf):
    return views.building(spark, sf).withColumns({"building_type": F.expr(_KIND.format(k="(bldg_id * 7 + cast(area_m2 as bigint))")), "cell_id": as_cell()})


_TYPED = f"SELECT bldg_id, area_m2, cell_id, {_GROUP} AS grp FROM (SELECT *, {_KIND.format(k='(bldg_id * 7 + floor(area_m2)::BIGINT)')} AS t, {AS_CELL} AS cell_id FROM building) WHERE cell_id >= 0"


@query(
    sql(
        "building frac",
        "SELECT coalesce(s.cell_id, m.cell_id) AS cell_id, CASE WHEN s.cell_id IS NULL THEN 'esri' WHEN m.cell_id IS NULL THEN 'osm' ELSE 'both' END AS source, coalesce(n_buildings, 0) AS n_buildings, round(coalesce(bldg_area_m2, 0), 6) AS bldg_area_m2, coalesce(main_type, 'unknown') AS main_type FROM (SELECT cell_id, count(*) AS n_buildings, sum(area_m2) AS bldg_area_m2 FROM typed GROUP BY cell_id) s FULL JOIN m ON s.cell_id = m.cell_id LEFT JOIN main ON s.cell_id = main.cell_id",
        typed=_TYPED,
        m="SELECT cell_id FROM frac WHERE yr = 2001 AND frac_built >= 0.5",
        main="SELECT cell_id, grp AS main_type FROM (SELECT cell_id, grp, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, min(bldg_id)) AS k FROM typed WHERE grp <> 'unknown' GROUP BY cell_id, grp) WHERE k = 1",
    )
)
def reference_cells(spark, sf):
    mapped = fractions(spark, sf).where("yr = 2001 and frac_built >= 0.5")
    out = vector.reference_cells(_typed(spark, sf), mapped)
    return out.withColumn("bldg_area_m2", F.round("bldg_area_m2", 6))


@query(sql("building", "SELECT cell_id, grp AS main_type, n FROM (SELECT cell_id, grp, count(*) AS n, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, min(bldg_id)) AS k FROM typed WHERE grp <> 'unknown' GROUP BY cell_id, grp) WHERE k = 1", typed=_TYPED))
def main_type_mode(spark, sf):
    by = _typed(spark, sf).where("cell_id >= 0").withColumn("g", vector.type_group(F.col("building_type"))).where("g <> 'unknown'").groupBy("cell_id", "g").agg(F.count(F.lit(1)).alias("n"), F.min("bldg_id").alias("first"))
    best = by.groupBy("cell_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "g")).alias("b"))
    return best.select("cell_id", F.col("b.g").alias("main_type"), (-F.col("b.m")).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def dedupe_keep_first(spark, sf):
    rows = views.read(spark, sf, "lineitem")
    return vector.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier")
def union_missing_cols(spark, sf):
    a = views.read(spark, sf, "customer").selectExpr("c_custkey as k", "c_nationkey as nation", "c_acctbal as balance")
    b = views.read(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_nationkey as nation", "s_name as name")
    return a.unionByName(b, allowMissingColumns=True)


@query(sql("segment", "SELECT kind, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) / 1000, 4) AS km FROM (SELECT *, CASE WHEN line_id % 4 = 0 THEN 'major' ELSE 'minor' END AS kind FROM segment) GROUP BY kind"))
def length_by_class(spark, sf):
    segs = vector.segments(views.vertex(spark, sf)).withColumn("kind", F.when(F.col("line_id") % 4 == 0, "major").otherwise("minor"))
    return vector.line_lengths(segs, "kind").select("kind", F.round("km", 4).alias("km"))


@query("SELECT p_partkey, (p_size * 10)::DOUBLE * (100 + p_partkey % 7) AS area, p_partkey % 50 * 100 + p_size * 5.0::DOUBLE AS cx, -((100 + p_partkey % 7) / 2.0::DOUBLE) AS cy FROM part")
def polygon_area_centroid(spark, sf):
    """Rectangles of known area and centre."""
    p = views.read(spark, sf, "part").selectExpr("p_partkey", "cast(p_partkey % 50 * 100 as double) as x", "cast(p_size * 10 as double) as w", "cast(100 + p_partkey % 7 as double) as h")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("x"), F.lit(0.0)), (F.col("x") + F.col("w"), F.lit(0.0)), (F.col("x") + F.col("w"), -F.col("h")), (F.col("x"), -F.col("h")))])
    c = vector.centroid(F.col("ring"))
    return p.withColumn("ring", ring).select("p_partkey", vector.shoelace(F.col("ring")).alias("area"), F.round(c.x, 6).alias("cx"), F.round(c.y, 6).alias("cy"))


@query(
    sql(
        "segment",
        "SELECT line_id, round(sum(greatest(0, t1 - t0) * d), 3) AS metres FROM (SELECT line_id, d, " + "greatest(0, " + ", ".join(f"CASE WHEN {p} < 0 THEN ({q}) / ({p}) ELSE 0 END" for p, q in (("-dx", "x1 - 1000"), ("dx", "3000 - x1"), ("-dy", "y1 + 2500"), ("dy", "-500 - y1"))) + ") AS t0, least(1, " + ", ".join(f"CASE WHEN {p} > 0 THEN ({q}) / ({p}) WHEN {p} = 0 AND {q} < 0 THEN 0 ELSE 1 END" for p, q in (("-dx", "x1 - 1000"), ("dx", "3000 - x1"), ("-dy", "y1 + 2500"), ("dy", "-500 - y1"))) + ") AS t1 FROM (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS d FROM segment)) WHERE t0 < t1 GROUP BY line_id",
    )
)
def clip_lines(spark, sf):
    cut = vector.clip_lines(vector.segments(views.vertex(spark, sf)), 1000.0, -2500.0, 3000.0, -500.0)
    return cut.groupBy("line_id").agg(F.round(F.sum(vector.length(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])), 3).alias("metres"))


assert math.isclose(vector.disk_area(5, CELL), 0.81)
