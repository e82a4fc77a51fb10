"""Queries of reports, geometry, reprojection, id sets, sensitivity and whole models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import geometry, labels, learn, present, raster, suitability, vector, warp
from ..operators.components import materialise
from ..sources import views
from ..sources.views import COLS, sql
from .extra import _INPUTS, _SCORES, _training
from .geo import FRACS, built, fractions
from .model import YEARS, clustered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_NAMES = "CASE k WHEN 0 THEN 'log_dist_built' WHEN 1 THEN 'log_dist_major' WHEN 2 THEN 'road_density' WHEN 3 THEN 'elev_mean' WHEN 4 THEN 'slope_max' ELSE 'ring' || (250 * (1 + k % 2)) || '_' || CASE k % 3 WHEN 0 THEN 'built' WHEN 1 THEN 'tree' ELSE 'water' END END"
_PART_NAMES = f"SELECT p_partkey, p_size / 10 AS v, {_NAMES} AS name FROM (SELECT *, p_partkey % 11 AS k FROM part)"
_LABEL = "CASE name WHEN 'log_dist_built' THEN 'distance to built-up' WHEN 'log_dist_major' THEN 'distance to a major road' WHEN 'road_density' THEN 'road density (500 m)' WHEN 'elev_mean' THEN 'elevation' WHEN 'slope_max' THEN 'slope (max)' ELSE split_part(name, '_', 2) || ' share within ' || substr(split_part(name, '_', 1), 5) || ' m' END"


def _named(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 11
    ring = F.concat(F.lit("ring"), (250 * (1 + k % 2)).cast("string"), F.lit("_"), F.when(k % 3 == 0, "built").when(k % 3 == 1, "tree").otherwise("water"))
    name = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in ("log_dist_built", "log_dist_major", "road_density", "elev_mean", "slope_max")]), (k + 1).cast("int")), ring)
    return views.read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10).alias("v"), name.alias("name"))


@query(f"SELECT p_partkey, {_LABEL} AS label FROM ({_PART_NAMES})")
def feature_label(spark, sf):
    return _named(spark, sf).select("p_partkey", present.readable(F.col("name")).alias("label"))


@query(f"SELECT p_partkey, CASE WHEN name LIKE 'log_dist%' THEN 'm' WHEN name LIKE 'ring%' THEN '%' WHEN name = 'road_density' THEN 'km/km²' WHEN name = 'elev_mean' THEN 'm' ELSE '°' END AS unit, round(CASE WHEN name LIKE 'log_dist%' THEN exp(v) - 1 WHEN name LIKE 'ring%' THEN 100 * v ELSE v END, 6) AS shown FROM ({_PART_NAMES})")
def display_units(spark, sf):
    n = F.col("name")
    return _named(spark, sf).select("p_partkey", present.shown(n)["unit"].alias("unit"), F.round(present.shown_value(n, F.col("v")), 6).alias("shown"))


_GROWN = {
    "yearly": "SELECT cell_id, " + ", ".join(f"max(frac_built) FILTER (yr = {y}) AS {k}" for k, y in YEARS.items()) + " FROM frac GROUP BY cell_id",
    "grown": "SELECT *, coalesce(candidate AND latest_confirm >= 0.5 AND latest >= 0.5, FALSE) AS grew, coalesce(candidate AND NOT (latest_confirm >= 0.5 AND latest >= 0.5) AND NOT (latest_confirm < 0.1 AND latest < 0.1), FALSE) AS ambiguous, coalesce(baseline >= 0.5 AND confirm >= 0.5, FALSE) AS built_baseline FROM (SELECT *, coalesce(baseline < 0.1, FALSE) AND coalesce(confirm < 0.1, FALSE) AND latest_confirm IS NOT NULL AND latest IS NOT NULL AS candidate FROM yearly)",
}


@query(sql("frac", "SELECT cell_id, CASE WHEN cell_id % 9 = 0 THEN 255 WHEN built_baseline THEN 1 WHEN grew THEN 4 WHEN candidate AND NOT ambiguous THEN 3 END AS code FROM grown", **_GROWN))
def label_codes(spark, sf):
    g = labels.growth(labels.yearly(fractions(spark, sf), YEARS)).withColumn("excluded", F.col("cell_id") % 9 == 0)
    return g.select("cell_id", present.label_code(*[F.col(c) for c in ("excluded", "built_baseline", "grew", "candidate", "ambiguous")]).alias("code"))


@query(sql("frac", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q} AS share, round(quantile_cont({c}, {q}), 6) AS upper FROM frac" for q in ("0.99", "0.995") for c in FRACS[:4])))
def image_limits(spark, sf):
    """Upper ends of colour scales."""
    f, out = fractions(spark, sf), None
    for q in (0.99, 0.995):
        one = present.upper_ends(f, FRACS[:4], q).select("column", F.lit(q).alias("share"), F.round("upper", 6).alias("upper"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    sql(
        "built",
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{n}' AS \"column\", '{t}' AS label, '{u}' AS unit, '{s}' AS show, round(min({c}), 6)::DOUBLE AS low, round(max({c}), 6)::DOUBLE AS high, round(avg({c}) FILTER (cell_id % 2 = 0), 6) AS mean, round(stddev_pop({c}) FILTER (cell_id % 2 = 0), 6) AS sd FROM built"
            for i, (n, c, t, u, s) in enumerate((("elev_mean", "elev", "elevation", "m", "value"), ("ring250_built", "built", "built share within 250 m", "%", "percent"), ("slope_max", "size", "slope (max)", "°", "value")))
        ),
    )
)
def web_meta(spark, sf):
    b = built(spark, sf).select("cell_id", F.col("elev").alias("elev_mean"), F.col("built").alias("ring250_built"), F.col("size").alias("slope_max"))
    m = present.page_meta(b, ["elev_mean", "ring250_built", "slope_max"], F.col("cell_id") % 2 == 0)
    return m.select("position", "column", "label", "unit", "show", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "sd")])


@query(sql("evaluation", "SELECT kind, corner, round(CASE corner WHEN 0 THEN 0 WHEN 1 THEN p ELSE 1 END, 6)::DOUBLE AS flagged, CASE corner WHEN 0 THEN 0 ELSE 1 END::DOUBLE AS hit_share FROM (SELECT kind, avg(y::INT) AS p FROM evaluation GROUP BY kind), (SELECT unnest([0, 1, 2]) AS corner)"))
def toc_perfect(spark, sf):
    return ranks.perfect_line(views.evaluation(spark, sf), "y", ["kind"]).withColumn("flagged", F.round("flagged", 6))


@query(sql("building frac", "SELECT cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM a) AND cell_id IN (SELECT cell_id FROM b) THEN 'both' WHEN cell_id IN (SELECT cell_id FROM a) THEN 'first' ELSE 'second' END AS kind FROM (SELECT cell_id FROM a UNION SELECT cell_id FROM b) WHERE cell_id NOT IN (SELECT cell_id FROM grown WHERE built_baseline)", **_GROWN, a=f"SELECT DISTINCT (floor(-y / 100) * {COLS} + floor(x / 100))::BIGINT AS cell_id FROM building", b="SELECT cell_id FROM grown WHERE grew"))
def id_sets(spark, sf):
    """Cells with buildings and cells that grew, without those that were built."""
    cells = views.building(spark, sf).select((F.floor(-F.col("y") / 100) * COLS + F.floor(F.col("x") / 100)).alias("cell_id"))
    g = labels.growth(labels.yearly(fractions(spark, sf), YEARS))
    return labels.id_sets(cells, g.where("grew"), g.where("built_baseline"))


_SQUARES = "SELECT p_partkey AS id, ((p_partkey * 37) % 5000)::DOUBLE AS x, -((p_partkey * 53) % 4000)::DOUBLE AS y, (p_size * 10)::DOUBLE AS s FROM part"


def _squares(spark, sf) -> DataFrame:
    return views.read(spark, sf, "part").selectExpr("p_partkey as id", "cast((p_partkey * 37) % 5000 as double) as x", "-cast((p_partkey * 53) % 4000 as double) as y", "cast(p_size * 10 as double) as s", "p_size")


def _ring(*corners):
    return F.array(*[F.struct((F.col("x") + a * F.col("s")).alias("x"), (F.col("y") + b * F.col("s")).alias("y")) for a, b in corners])


@query(sql("cell", f"SELECT r // 4 AS patch, round(sum(greatest(0, least(q.x + s, cell.x + 50) - greatest(q.x, cell.x - 50)) * greatest(0, least(q.y + s, cell.y + 50) - greatest(q.y, cell.y - 50))), 3) AS area FROM cell JOIN ({_SQUARES}) q ON q.x < cell.x + 50 AND q.x + s > cell.x - 50 AND q.y < cell.y + 50 AND q.y + s > cell.y - 50 GROUP BY patch"))
def patch_overlap(spark, sf):
    """How much of the squares lies in each band of cells."""
    cells = views.cell(spark, sf).select("x", "y", F.expr("row div 4").alias("patch"))
    out = geometry.overlap_by(cells, _squares(spark, sf).select(_ring((0, 0), (1, 0), (1, 1), (0, 1)).alias("ring")), 100.0, "patch")
    return out.where("area > 0").select("patch", F.round("area", 3).alias("area"))


@query(f"SELECT id, part, area FROM (SELECT id, 0 AS part, s * s AS area FROM ({_SQUARES}) UNION ALL SELECT id, 2 AS part, s * s / 4 AS area FROM ({_SQUARES}) WHERE id % 3 = 0) WHERE area > 0")
def multipart_explode(spark, sf):
    """Parts of geometries of a square, an empty part and, of every third, a smaller square."""
    empty = _ring((0, 0), (1, 0), (0, 0))
    rings = F.when(F.col("id") % 3 == 0, F.array(_ring((0, 0), (1, 0), (1, 1), (0, 1)), empty, _ring((2, 0), (2.5, 0), (2.5, 0.5), (2, 0.5)))).otherwise(F.array(_ring((0, 0), (1, 0), (1, 1), (0, 1)), empty))
    return geometry.parts(_squares(spark, sf).select("id", rings.alias("rings"))).select("id", "part", "area")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n_parts, round(CASE WHEN id % 2 = 0 THEN s * s / 2 ELSE s * s END, 3) AS area FROM ({_SQUARES}) WHERE s > 0")
def valid_polygons(spark, sf):
    """Bow ties become two triangles, squares whose points repeat stay one square."""
    ring = F.when(F.col("id") % 2 == 0, _ring((0, 0), (1, 1), (1, 0), (0, 1))).otherwise(_ring((0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    out = geometry.valid(_squares(spark, sf).where("s > 0").select("id", ring.alias("ring")))
    return out.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_parts"), F.round(F.sum(vector.shoelace(F.col("ring"))), 3).alias("area"))


@query(sql("cell", "SELECT r // 5 AS patch, count(*) * 1.0::DOUBLE AS area FROM cell WHERE c % 7 <> 3 GROUP BY patch"))
def patch_polygons(spark, sf):
    """Dissolved outlines of bands of cells with gaps; their area in cells, from the rings alone."""
    cells = views.cell(spark, sf).where("col % 7 <> 3").select("row", "col", F.expr("row div 5").alias("patch"))
    rings = geometry.outlines(geometry.directed_sides(cells))
    signed = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0.0), lambda s, i: s + F.col("ring")[i].x * F.col("ring")[(i + 1) % F.size("ring")].y - F.col("ring")[(i + 1) % F.size("ring")].x * F.col("ring")[i].y)
    return rings.groupBy("patch").agg((F.sum(signed) / 2).alias("area"))


def _raster_of_cells(spark, sf) -> DataFrame:
    return views.cell(spark, sf).select("row", "col", F.col("elev").cast("double").alias("elev"))


@query(sql("cell", "SELECT cell_id, elev::DOUBLE AS elev FROM cell"))
def warp_there_and_back(spark, sf):
    """The lattice's centres in degrees, warped from the raster in UTM zone 43 north: each finds its own cell."""
    c = views.cell(spark, sf)
    lon, lat = warp.project(700_000 + F.col("x"), 2_000_000 + F.col("y"), 32643, warp.DEGREES)
    target = c.select("cell_id", lon.alias("x"), lat.alias("y"))
    return warp.warp(target, _raster_of_cells(spark, sf), "elev", 100.0, 700_000.0, 2_000_000.0, warp.DEGREES, 32643, key="cell_id")


@query(sql("cell", "SELECT p.cell_id, round((p.elev + q.elev) / 2, 3) AS elev FROM cell p JOIN cell q ON q.r = p.r AND q.c = p.c + 1"))
def warp_bilinear(spark, sf):
    """Points in zone 42 half way between neighbours of a row of the raster in zone 43."""
    c = views.cell(spark, sf).where(f"col < {COLS - 1}")
    there = warp.projected(c.select("cell_id", (700_050 + F.col("x")).alias("x"), (2_000_000 + F.col("y")).alias("y")), 32643, 32642)
    out = warp.warp(there, _raster_of_cells(spark, sf), "elev", 100.0, 700_000.0, 2_000_000.0, 32642, 32643, True, "cell_id")
    both = views.cell(spark, sf).select((F.col("cell_id") - 1).alias("cell_id"))
    return out.join(both, "cell_id", "left_semi").select("cell_id", F.round("elev", 3).alias("elev"))


def _coarse(f: int) -> str:
    """AUC of the distance to built-up land for cells f times as large, from pixels up."""
    pix = f"SELECT (cell_id // {COLS} // {f}) * {COLS} + cell_id % {COLS} // {f} AS cell_id, yr, code FROM pixel"
    frac = f"SELECT cell_id, yr, CASE WHEN count(*) FILTER (code NOT IN (0, 10)) > 0 THEN count(*) FILTER (code = 7) / count(*) FILTER (code NOT IN (0, 10)) ELSE 0.0::DOUBLE END AS frac_built FROM ({pix}) GROUP BY cell_id, yr"
    year = "SELECT cell_id, " + ", ".join(f"max(frac_built) FILTER (yr = {y}) AS {k}" for k, y in YEARS.items()) + f" FROM ({frac}) GROUP BY cell_id"
    grown = _GROWN["grown"].replace("FROM yearly", f"FROM ({year})")
    xy = f"SELECT *, (cell_id % {COLS} + 0.5::DOUBLE) * {100 * f} AS x, -(cell_id // {COLS} + 0.5::DOUBLE) * {100 * f} AS y FROM ({grown})"
    near = f"SELECT a.cell_id, any_value(a.grew) AS grew, least(3000, coalesce(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 3000)) AS d FROM g a LEFT JOIN g b ON b.baseline >= 0.5 WHERE a.candidate AND NOT a.ambiguous GROUP BY a.cell_id"
    ranks_ = "SELECT grew, rank() OVER (ORDER BY d DESC) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS rk FROM n"
    return f"SELECT {f} AS factor, n_cells, n_pos, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 6) AS auc FROM (WITH g AS ({xy}), n AS ({near}), k AS ({ranks_}) SELECT (SELECT count(*) FROM g) AS n_cells, count(*) FILTER (grew) AS n_pos, count(*) FILTER (NOT grew) AS n_neg, sum(rk) FILTER (grew) AS s FROM k)"


@query(sql("pixel", " UNION ALL ".join(_coarse(f) for f in (1, 2, 4))))
def cell_size_sensitivity(spark, sf):
    """Features and labels rebuilt from pixels at each cell size, and the AUC of the distance to built-up land."""
    out = None
    for f in (1, 2, 4):
        row, col = F.expr(f"cell_id div {COLS} div {f}"), F.expr(f"cell_id % {COLS} div {f}")
        frac = raster.class_fractions(views.pixel(spark, sf).withColumn("cell_id", row * COLS + col), ["cell_id", "yr"])
        g = labels.growth(labels.yearly(frac, YEARS))
        places = g.withColumns({"x": (F.col("cell_id") % COLS + 0.5) * (100.0 * f), "y": -(F.expr(f"cell_id div {COLS}") + 0.5) * (100.0 * f)})
        towns = frac.where(f"yr = {YEARS['baseline']} and frac_built >= 0.5").select("cell_id")
        one = suitability.distance_auc(places.where("candidate and not ambiguous"), places.join(towns, "cell_id", "left_semi"), "grew", 3000.0)
        one = one.crossJoin(g.agg(F.count(F.lit(1)).alias("n_cells"))).select(F.lit(f).alias("factor"), "n_cells", "n_pos", F.round("auc", 6).alias("auc"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query()
def k_sensitivity(spark, sf):
    """Quality, class shares and agreement for k = 5 to 8; a cluster's class by its mean built and tree shares."""
    c = clustered(spark, sf)
    truth = F.when(F.col("frac_built") >= 0.3, 1).when(F.col("frac_tree") >= 0.5, 2).otherwise(3)
    return learn.k_sweep(c.withColumn("truth", truth), FRACS[:5], (5, 6, 7, 8), truth, "truth")


@query()
def holdout_scorers(spark, sf):
    """The hold-out with all four scorers."""
    t = materialise(_training(spark, sf).withColumn("is_ref", F.col("y").cast("boolean")))
    out = None
    for name, scorer in learn.scorers(_INPUTS, "elev_mean", ["elev_mean", "a"], also=_SCORES).items():
        one = learn.holdout_summary(learn.holdout(t, scorer).withColumn("scorer", F.lit(name)), ["scorer"])
        out = one if out is None else out.unionByName(one)
    return out


@query()
def rf_run_model(spark, sf):
    """A model from tuning to scores of both runs; rows of both by run."""
    t = materialise(_training(spark, sf).withColumn("candidate", F.col("cell_id") % 4 != 0))
    got = learn.run_model(t, t.withColumn("usable", F.col("cell_id") % 5 != 0), _INPUTS, "y", "candidate", "usable", also=_SCORES)
    return got["validation"].withColumn("run", F.lit("validation")).unionByName(got["final"].withColumn("run", F.lit("final")))


@query(sql("cell", "SELECT cell_id, path, a AS \"left\", b AS \"right\" FROM (SELECT cell_id, unnest(['size', 'elev']) AS path, unnest([size::VARCHAR, elev::VARCHAR]) AS a, unnest([(size + CASE WHEN cell_id % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR, elev::VARCHAR]) AS b FROM cell) WHERE a <> b"))
def document_diff(spark, sf):
    """Leaves of JSON documents of two runs that differ."""
    from ..sources import sinks

    c = views.cell(spark, sf).select("cell_id", "size", "elev")
    a = c.select("cell_id", F.to_json(F.struct("size", "elev")).alias("doc"))
    b = c.withColumn("size", F.col("size") + F.when(F.col("cell_id") % 10 == 0, 1).otherwise(0)).select("cell_id", F.to_json(F.struct("size", "elev")).alias("doc"))
    return sinks.differing_leaves(a, b, "cell_id", "doc")


@query(sql("profile", f"SELECT cell_id, (floor(-y / 100) * {COLS} + floor(x / 100))::BIGINT AS place FROM (SELECT vec_id AS cell_id, ((vec_id * 331) % 5000)::DOUBLE + 0.25 AS x, -((vec_id * 173) % 4000)::DOUBLE - 0.25 AS y FROM embeddings)"))
def place_of_point(spark, sf):
    """The cell that a longitude and latitude lie in."""
    p = views.read(spark, sf, "embeddings").selectExpr("vec_id as cell_id", "cast((vec_id * 331) % 5000 as double) + 0.25D as x", "-cast((vec_id * 173) % 4000 as double) - 0.25D as y")
    lon, lat = warp.project(700_000 + F.col("x"), 2_000_000 + F.col("y"), 32643, warp.DEGREES)
    x, y = warp.project(F.col("lon"), F.col("lat"), warp.DEGREES, 32643)
    there = p.select("cell_id", lon.alias("lon"), lat.alias("lat")).select("cell_id", (x - 700_000).alias("x"), (y - 2_000_000).alias("y"))
    return there.select("cell_id", (F.floor(-F.col("y") / 100) * COLS + F.floor(F.col("x") / 100)).alias("place"))
