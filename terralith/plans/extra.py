"""Queries of contracts, sources, sinks and learning; fits have no SQL, what surrounds them has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts
from ..functions import geodesy
from ..operators import geometry, labels, lattice, learn, similarity, vector
from ..sources import files, sinks, synthetic, views
from ..sources.views import COLS, sql
from .geo import FRACS, fractions
from .model import _CLUSTERED, YEARS, clustered, knn, models, scored, standardised

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_GRID = "SELECT cell_id, r, c, x, y FROM cell"


@query(sql("cell", " UNION ALL ".join(f"SELECT '{a}' AS \"column\", count(*) - count({b}) AS nulls, min({b})::DOUBLE AS low, max({b})::DOUBLE AS high FROM cell" for a, b in (("cell_id", "cell_id"), ("row", "r"), ("col", "c"), ("x", "x"), ("y", "y")))))
def contract_validation(spark, sf):
    return contracts.report(contracts.validate(views.cell(spark, sf), contracts.CONTRACTS["grid"]), contracts.CONTRACTS["grid"])


@query(sql("cell pixel", "SELECT DISTINCT pixel.cell_id + 5 AS cell_id FROM pixel WHERE pixel.cell_id + 5 NOT IN (SELECT cell_id FROM cell)"))
def referential_check(spark, sf):
    return contracts.unknown_cells(views.pixel(spark, sf).select((F.col("cell_id") + 5).alias("cell_id")).distinct(), views.cell(spark, sf))


@query(sql("cell frac", "SELECT cell.cell_id, yr FROM cell JOIN frac ON cell.cell_id = frac.cell_id WHERE yr = 2001"))
def join_one_to_one(spark, sf):
    return contracts.one_to_one(views.cell(spark, sf).select("cell_id"), fractions(spark, sf).where("yr = 2001").select("cell_id", "yr"), ["cell_id"])


@query("SELECT l_partkey AS pixel, arg_min(l_quantity, (l_suppkey, l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_quantity > 5 GROUP BY 1")
def mosaic_first_valid(spark, sf):
    t = views.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("pixel"), F.struct("l_suppkey", "l_orderkey", "l_linenumber").alias("tile"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("v"))
    return files.mosaic(t, ["pixel"], "v", "tile")


@query("SELECT event_id, props FROM events WHERE user_id BETWEEN 10 AND 40 AND value BETWEEN 0 AND 50")
def bbox_filter(spark, sf):
    return views.read(spark, sf, "events").where(files.in_box(F.col("user_id"), F.col("value"), 10, 0, 40, 50)).select("event_id", "props")


@query("SELECT page_id FROM (SELECT page_id, 'map_' || page_id % 9 || '_' || page_id % 7 || '_' || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE 'x-' || page_id % 9 END AS id FROM pages) WHERE ends_with(id, '-7') OR contains(id, '_7_')")
def item_filter(spark, sf):
    items = views.read(spark, sf, "pages").selectExpr("page_id", "concat('map_', page_id % 9, '_', page_id % 7, '_', if(page_id % 2 = 0, 'x', concat('x-', page_id % 9))) as id")
    return files.items_of_year(items, 7).select("page_id")


@query(sql("cell", 'SELECT r AS "row", list(v ORDER BY c) AS cells FROM (SELECT r, c, CASE WHEN size % 2 = 0 THEN size::DOUBLE ELSE -1 END AS v FROM cell) GROUP BY r'))
def class_raster_rows(spark, sf):
    c = views.cell(spark, sf)
    return sinks.image_rows(c, c.where("size % 2 = 0"), "size", -1)


_FIX = "printf('%.2f', {})"


@query(sql("cell", "SELECT cell_id, 'POLYGON ((' || " + " || ', ' || ".join(_FIX.format(f"x {a} 50") + " || ' ' || " + _FIX.format(f"y {b} 50") for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-"))) + " || '))' AS wkt FROM cell"))
def cell_squares(spark, sf):
    return views.cell(spark, sf).select("cell_id", sinks.square(F.col("x"), F.col("y"), 100.0).alias("wkt"))


@query(sql("cell", "SELECT model, cell_id FROM (SELECT unnest(['a', 'b']) AS model, cell_id FROM cell) WHERE NOT (model = 'a' AND cell_id % 50 < 49 OR model = 'b' AND cell_id % 50 > 0)"))
def score_coverage(spark, sf):
    s = models(spark, sf).where("(model = 'a' and cell_id % 50 < 49) or (model = 'b' and cell_id % 50 > 0)")
    return files.missing_scores(s, views.cell(spark, sf))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return views.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_TOWN = (
    "SELECT cell_id, r, c, CASE WHEN core < 0.05 THEN 0 ELSE core END AS b0 FROM (SELECT i AS cell_id, i // 30 AS r, i % 30 AS c, greatest(0, least(1, 0.5::DOUBLE + (7.5::DOUBLE - sqrt((i // 30 - 9.0::DOUBLE) ** 2 + (i % 30 - 10.5::DOUBLE) ** 2)) * 1.5)) AS core FROM range(900) t(i))"
)


@query(f"WITH t AS ({_TOWN}), b AS (SELECT *, CASE WHEN abs(r - 24) <= 1 AND abs(c - 13) <= 1 THEN greatest(b0, 0.8) ELSE b0 END AS built FROM t), w AS (SELECT *, CASE WHEN r BETWEEN 2 AND 4 AND c BETWEEN 25 AND 27 THEN least(0.9, 1 - built) ELSE 0 END AS water FROM b), f AS (SELECT *, CASE WHEN r >= 18 AND c >= 18 THEN least(0.8, 1 - built - water) ELSE 0.05 * (1 - built - water) END AS tree FROM w) SELECT cell_id, round(built, 6) AS built, round(water, 6) AS water, round(tree, 6) AS tree, round(0.5 * (1 - built - water - tree), 6) AS crop FROM f")
def synthetic_town(spark, sf):
    t = synthetic.town(spark, 30, 2023)
    return t.select("cell_id", *[F.round(f"frac_{k}", 6).alias(k) for k in ("built", "water", "tree", "crop")])


@query(sql("cell", "SELECT cell_id, lo + q / 65535::DOUBLE * (hi - lo) - elev BETWEEN -0.01 AND 0.01 AS close FROM (SELECT cell_id, elev, lo, hi, round_even((elev - lo) / (hi - lo) * 65535, 0) AS q FROM cell, (SELECT min(elev)::DOUBLE AS lo, max(elev)::DOUBLE AS hi FROM cell))"))
def quantised_round_trip(spark, sf):
    c = views.cell(spark, sf).select("cell_id", F.col("elev").cast("double").alias("elev"))
    bounds = c.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    q = similarity.quantised(c, ["elev"]).withColumnRenamed("elev", "q").join(c, "cell_id").crossJoin(F.broadcast(bounds))
    lo, hi = F.col("lo"), F.col("hi")
    return q.select("cell_id", F.abs(lo + F.col("q") / 65535 * (hi - lo) - F.col("elev")).between(0, 0.01).alias("close"))


@query(
    sql(
        "cell frac",
        "SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM (SELECT i.cell_id, CASE WHEN own_n < 2 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM (SELECT cell_id, max(own_n) AS own_n, max(a) AS a, min(b) AS b FROM (SELECT p.cell_id, CASE WHEN p.cluster = q.cluster THEN count(*) END AS own_n, CASE WHEN p.cluster = q.cluster THEN sum(d) / (count(*) - 1) END AS a, CASE WHEN p.cluster <> q.cluster THEN sum(d) / count(*) END AS b FROM (SELECT p.cell_id, p.cluster, q.cluster AS qc, sqrt((p.frac_built - q.frac_built) ** 2 + (p.frac_crop - q.frac_crop) ** 2) AS d FROM pick p, pick q) x JOIN pick p ON x.cell_id = p.cell_id JOIN (SELECT DISTINCT cluster FROM pick) q ON x.qc = q.cluster GROUP BY p.cell_id, p.cluster, q.cluster) GROUP BY cell_id) i)",
        clustered=_CLUSTERED,
        pick="SELECT * FROM clustered ORDER BY md5(cell_id::VARCHAR), cell_id LIMIT 400",
    )
)
def silhouette_sampled(spark, sf):
    s = learn.silhouette(clustered(spark, sf), "cluster", ["frac_built", "frac_crop"], 400)
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


@query(sql("frac", "SELECT label, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT grew::INT::DOUBLE AS label, CASE WHEN grew THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS weight FROM g, (SELECT count(*) AS n, count(*) FILTER (grew) AS p FROM g)) GROUP BY label", yearly="SELECT cell_id, " + ", ".join(f"max(frac_built) FILTER (yr = {y}) AS {k}" for k, y in YEARS.items()) + " FROM frac GROUP BY cell_id", g="SELECT latest_confirm >= 0.5 AND latest >= 0.5 AS grew FROM yearly WHERE baseline < 0.1 AND confirm < 0.1 AND latest IS NOT NULL AND latest_confirm IS NOT NULL"))
def class_weights(spark, sf):
    g = labels.growth(labels.yearly(fractions(spark, sf), YEARS)).where("candidate")
    return learn.balanced(g, "grew").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


#: Scores of the evaluation, which models of other models' scores may see beside the whitelist.
_SCORES = ("a", "b")
_INPUTS = ["elev_mean", "road_density", *_SCORES]


def _training(spark, sf) -> DataFrame:
    s = scored(spark, sf)
    blocks = s.withColumn("block", lattice.block_of(F.col("col") * 100.0, F.col("row") * 100.0, 500.0))
    return blocks.join(lattice.deal_folds(blocks, 3), "block").select("cell_id", "fold", "y", F.col("elev").cast("double").alias("elev_mean"), F.col("size").cast("double").alias("road_density"), *[F.col(c).cast("double").alias(c) for c in _SCORES])


@query()
def kmeans_fit(spark, sf):
    z = learn.assembled(learn.scaled(clustered(spark, sf), FRACS[:5]), FRACS[:5])
    fitted = learn.kmeans(z, 4, starts=2).transform(z).select("cell_id", F.col("prediction").alias("cluster"), F.col("frac_built").alias("built"), F.col("frac_tree").alias("tree"))
    return fitted.join(F.broadcast(labels.order_clusters(fitted)), "cluster").select("cell_id", "cluster_id")


@query()
def gmm_bic(spark, sf):
    z = learn.assembled(learn.scaled(clustered(spark, sf), FRACS[:3]), FRACS[:3])
    n = z.count()
    rows = [(k, learn.bic(learn.gmm(z, k, starts=1).summary.logLikelihood, n, k, 3)) for k in (2, 3)]
    return spark.createDataFrame(rows, "k int, bic double")


@query()
def pca_variance(spark, sf):
    share, n = learn.pca_variance(clustered(spark, sf), FRACS[:5])
    return spark.createDataFrame([(i, s, i < n) for i, s in enumerate(share)], "component int, share double, needed boolean")


@query()
def rf_oof(spark, sf):
    return learn.out_of_fold(learn.ranked_features(_training(spark, sf), _INPUTS), _INPUTS, "y", also=_SCORES)[0]


@query()
def rf_importance(spark, sf):
    t = _training(spark, sf)
    _, fitted = learn.out_of_fold(t, _INPUTS, "y", also=_SCORES)
    folds = [r[0] for r in t.select("fold").distinct().orderBy("fold").collect()]
    return learn.permutation_importance(t, _INPUTS, "y", fitted, folds)


@query()
def rf_ablation(spark, sf):
    return learn.ablation(_training(spark, sf), {"scores": _SCORES, "terrain": ("elev_mean",), "roads": ("road_density",)}, _INPUTS, "y", also=_SCORES)


@query()
def rf_tune(spark, sf):
    best = learn.tune(_training(spark, sf), _INPUTS, "y", (1, 5, 20), ("sqrt", "0.5"), also=_SCORES)
    return spark.createDataFrame([(best["leaf"], best["features"], best["auc"])], "leaf int, features string, auc double")


@query()
def holdout_check(spark, sf):
    z = standardised(spark, sf).withColumn("fold", (F.col("cell_id") % 3).cast("int"))

    def scorer(cells, refs, there):
        return similarity.knn_distance(there, refs, 10).select("cell_id", (-F.col("distance")).alias("score"))

    out = learn.holdout(z.select("cell_id", "z", "fold", "is_ref"), scorer)
    return out.where("is_ref").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.median("percentile").alias("median"), F.avg((F.col("percentile") > 90).cast("int")).alias("top10"))


@query(sql("profile", "SELECT count(*) AS n FROM profile WHERE is_ref"))
def reference_ids(spark, sf):
    return views.profile(spark, sf).where("is_ref").agg(F.count(F.lit(1)).alias("n"))


@query(sql("cell", "SELECT cell_id, ('0x' || substr(md5('42:' || cell_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS score FROM cell"))
def random_baseline(spark, sf):
    return lattice.hashed(views.cell(spark, sf), 42).select("cell_id", "score")


@query()
def tiff_image(spark, sf):
    """The lattice as a TIFF and read again: rows and columns of the image."""
    from ..sources.files import tiff_array

    a = tiff_array(sinks.image_tiff(class_raster_rows(spark, sf), "i2"))
    return spark.createDataFrame([(int(a.shape[0]), int(a.shape[1]), int((a >= 0).sum()))], "n_rows int, n_cols int, n_valid int")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def top_dropped_tags(spark, sf):
    return vector.top_values(views.read(spark, sf, "part").where("p_size > 10"), "p_type")


@query(sql("cell", "SELECT cell_id, elev FROM cell ORDER BY md5('42:' || cell_id), cell_id LIMIT 100"))
def seeded_sample(spark, sf):
    return lattice.seeded_sample(views.cell(spark, sf), 100).select("cell_id", "elev")


@query("SELECT p_partkey AS id, w * h AS area FROM (SELECT p_partkey, greatest(0, least(x + s, 3000) - greatest(x, 1000)) AS w, greatest(0, least(y + s, 2500) - greatest(y, 500)) AS h FROM (SELECT p_partkey, (p_partkey * 37) % 5000 / 1.0::DOUBLE AS x, (p_partkey * 53) % 4000 / 1.0::DOUBLE AS y, p_size * 10.0::DOUBLE AS s FROM part)) WHERE w * h > 0")
def clip_polygons(spark, sf):
    """Squares cut to a box; the area of what is left."""
    p = views.read(spark, sf, "part").selectExpr("p_partkey as id", "cast((p_partkey * 37) % 5000 as double) as x", "cast((p_partkey * 53) % 4000 as double) as y", "p_size * 10.0D as s")
    ring = F.array(*[F.struct((F.col("x") + a * F.col("s")).alias("x"), (F.col("y") + b * F.col("s")).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    cut = geometry.cut(p.select("id", ring.alias("ring")), *[F.lit(v) for v in (1000.0, 500.0, 3000.0, 2500.0)])
    return cut.select("id", vector.shoelace(F.col("ring")).alias("area")).where("area > 0")


@query(sql("frac", "SELECT yr, round(sum(frac_built) / 100, 6) AS built, round(sum(frac_tree) / 100, 6) AS tree, round(sum(frac_crop) / 100, 6) AS crop FROM frac GROUP BY yr"))
def class_areas(spark, sf):
    """Square kilometres of classes by year, for cells of 100 m."""
    f = fractions(spark, sf)
    return f.groupBy("yr").agg(*[F.round(F.sum(f"frac_{k}") / 100, 6).alias(k) for k in ("built", "tree", "crop")])


@query(sql("cell frac", "SELECT cluster, round((avg(frac_built) - (SELECT avg(frac_built) FROM clustered)) / (SELECT stddev_samp(frac_built) FROM clustered), 6) AS built, round((avg(elev) - (SELECT avg(elev) FROM clustered)) / (SELECT stddev_samp(elev) FROM clustered), 6) AS elev FROM clustered GROUP BY cluster", clustered=_CLUSTERED))
def cluster_profiles(spark, sf):
    """Cluster means in sample standard deviations."""
    c = clustered(spark, sf)
    stats = c.agg(*[F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias(f"_{v}") for v in ("frac_built", "elev")])
    means = c.groupBy("cluster").agg(F.avg("frac_built").alias("frac_built"), F.avg("elev").alias("elev")).crossJoin(F.broadcast(stats))
    return means.select("cluster", *[F.round((F.col(v) - F.col(f"_{v}.m")) / F.col(f"_{v}.s"), 6).alias(o) for v, o in (("frac_built", "built"), ("elev", "elev"))])


@query()
def k_scan(spark, sf):
    rows = learn.k_scan(clustered(spark, sf), FRACS[:5], range(3, 11))
    return spark.createDataFrame([(r["k"], r["method"], float(r["cost"]), float(r["silhouette"]), r["davies_bouldin"] and float(r["davies_bouldin"])) for r in rows], "k int, method string, cost double, silhouette double, davies_bouldin double")


@query("SELECT s_suppkey AS id, CEIL((y1 + 50 + s) / 100.0)::BIGINT - FLOOR((y1 - 50) / 100.0)::BIGINT AS n_rows, CEIL((x1 + 50 + s) / 100.0)::BIGINT - FLOOR((x1 - 50) / 100.0)::BIGINT AS n_cols, FLOOR((x1 - 50) / 100.0) * 100 AS left_, CEIL((y1 + 50 + s) / 100.0) * 100 AS top_ FROM (SELECT s_suppkey, ((s_suppkey * 37) % 500)::DOUBLE AS x1, ((s_suppkey * 53) % 400)::DOUBLE AS y1, (s_suppkey % 90 * 10)::DOUBLE AS s FROM supplier)")
def reference_grid(spark, sf):
    """The lattice over buffered bounds of each supplier's box."""
    b = views.read(spark, sf, "supplier").selectExpr("s_suppkey as id", "cast((s_suppkey * 37) % 500 as double) as left", "cast((s_suppkey * 53) % 400 as double) as bottom", "cast(s_suppkey % 90 * 10 as double) as s")
    left, top, rows, cols = lattice.reference_grids(F.col("left"), F.col("bottom"), F.col("left") + F.col("s"), F.col("bottom") + F.col("s"), 100.0, 50.0)
    return b.select("id", rows.alias("n_rows"), cols.alias("n_cols"), left.alias("left_"), top.alias("top_"))


@query("SELECT c_custkey, 43 AS zone, TRUE AS inside FROM customer")
def grid_bounds_wgs84(spark, sf):
    """Bounds in degrees of a box in zone 43 hold points in it."""
    a, b, c, d = geodesy.bounds_wgs84(spark, 700_000, 2_000_000, 720_000, 2_020_000, 43, 200)
    zone = geodesy.resolve_zone([[(a, b), (c, b), (c, d), (a, d)]])
    p = views.read(spark, sf, "customer").selectExpr("c_custkey", "700000 + (c_custkey * 37) % 20000 as x", "2000000 + (c_custkey * 53) % 20000 as y")
    lon, lat = geodesy.from_utm(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(43))
    return p.select("c_custkey", F.lit(zone).alias("zone"), (lon.between(a, c) & lat.between(b, d)).alias("inside"))


assert COLS == 50 and knn
