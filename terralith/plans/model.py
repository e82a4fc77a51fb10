"""Queries of labels, clusters, similarity, overlays and ranking metrics, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import labels, lattice, patches, raster, similarity, suitability, vector
from ..sources import views
from ..sources.views import COLS, sql
from .geo import FRACS, built, fractions, rounds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
YEARS = {"baseline": 1996, "confirm": 1997, "train1": 1998, "train2": 1999, "latest_confirm": 2000, "latest": 2001}
MATRIX = suitability.comparisons("1 3 5; 1/3 1 3; 1/5 1/3 1")
WEIGHTS = suitability.priorities(MATRIX)[0]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def by_year(spark, sf) -> DataFrame:
    return labels.yearly(fractions(spark, sf), YEARS)


_YEARLY = "SELECT cell_id, " + ", ".join(f"max(frac_built) FILTER (yr = {y}) AS {k}" for k, y in YEARS.items()) + " FROM frac GROUP BY cell_id"
_GROWTH = (
    "SELECT cell_id, coalesce(baseline >= 0.5 AND confirm >= 0.5, FALSE) AS built_baseline, candidate, candidate AND latest_confirm >= 0.5 AND latest >= 0.5 AS grew, "
    "candidate AND NOT (latest_confirm >= 0.5 AND latest >= 0.5) AND NOT (latest_confirm < 0.1 AND latest < 0.1) AS ambiguous, candidate AND coalesce(train1 >= 0.5, FALSE) AND coalesce(train2 >= 0.5, FALSE) AS chg_train_pos "
    "FROM (SELECT *, coalesce(baseline < 0.1, FALSE) AND coalesce(confirm < 0.1, FALSE) AND latest_confirm IS NOT NULL AND latest IS NOT NULL AS candidate FROM yearly)"
)


@query(sql("frac", _GROWTH.replace("candidate AND latest_confirm >= 0.5 AND latest >= 0.5 AS grew", "coalesce(candidate AND latest_confirm >= 0.5 AND latest >= 0.5, FALSE) AS grew"), yearly=_YEARLY))
def growth_labels(spark, sf):
    return labels.growth(by_year(spark, sf))


@query(sql("frac", "SELECT count(*) FILTER (candidate) AS candidates, count(*) FILTER (grew) AS grew, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (chg_train_pos) AS chg, count(*) FILTER (built_baseline) AS built FROM growth", yearly=_YEARLY, growth=_GROWTH))
def label_counts(spark, sf):
    g = labels.growth(by_year(spark, sf))
    return g.agg(F.count_if("candidate").alias("candidates"), F.count_if("grew").alias("grew"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("chg_train_pos").alias("chg"), F.count_if("built_baseline").alias("built"))


def _exclusion(spark, sf, years):
    frac = fractions(spark, sf).where(F.col("yr").isin(list(years))).groupBy("cell_id").agg(F.max(F.col("frac_water") + F.col("frac_flooded")).alias("wet_frac"), F.max("nodata_frac").alias("nodata_frac"))
    cells = views.cell(spark, sf).select("cell_id", (F.col("size") % 30).cast("double").alias("slope_mean"), F.when(F.col("cell_id") % 17 == 0, 1.0).otherwise(0.0).alias("protected_frac")).join(frac, "cell_id", "left")
    return labels.exclusion(cells).select("cell_id", "excl_wet", "excl_slope", "excl_nodata", "excl_protected", "excluded")


def _exclusion_sql(years) -> str:
    return sql(
        "cell frac",
        "SELECT *, excl_wet OR excl_slope OR excl_nodata OR excl_protected AS excluded FROM (SELECT cell.cell_id, coalesce(wet > 0.5, FALSE) AS excl_wet, size % 30 > 15 AS excl_slope, coalesce(nd > 0.5, FALSE) AS excl_nodata, cell.cell_id % 17 = 0 AS excl_protected FROM cell LEFT JOIN "
        f"(SELECT cell_id, max(frac_water + frac_flooded) AS wet, max(nodata_frac) AS nd FROM frac WHERE yr IN ({', '.join(map(str, years))}) GROUP BY cell_id) f ON cell.cell_id = f.cell_id)",
    )


@query(_exclusion_sql((1996, 1997)))
def exclusion_validation(spark, sf):
    return _exclusion(spark, sf, (1996, 1997))


@query(_exclusion_sql((2000, 2001)))
def exclusion_final(spark, sf):
    return _exclusion(spark, sf, (2000, 2001))


@query("SELECT snapshot, count(*) AS n FROM (SELECT CASE WHEN y >= 2001 THEN 'current' ELSE y::VARCHAR END AS snapshot FROM (SELECT year(o_orderdate) AS y FROM orders)) GROUP BY snapshot")
def time_travel_pairing(spark, sf):
    y = views.building(spark, sf).select(labels.snapshot_for(F.col("snapshot"), 2001).alias("snapshot"))
    return y.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1998 AND (o_orderkey % 3 = 0 OR year(o_orderdate) + 2 > 1998)")
def snapshot_asof(spark, sf):
    t = views.building(spark, sf).select("bldg_id", F.col("snapshot").alias("valid_from"), F.when(F.col("bldg_id") % 3 != 0, F.col("snapshot") + 2).alias("valid_to"))
    return labels.as_of(t, F.lit(1998)).select(F.col("bldg_id").alias("o_orderkey"))


@query(sql("cell building frac", "SELECT cell.cell_id, round(f.frac_built, 6) AS frac_built, coalesce(b.n, 0) AS bldg_count FROM cell JOIN (SELECT * FROM frac WHERE yr = 2001) f ON cell.cell_id = f.cell_id LEFT JOIN (SELECT bldg_id % 1000 AS cell_id, count(*) AS n FROM building GROUP BY 1) b ON cell.cell_id = b.cell_id"))
def feature_table_join(spark, sf):
    c2 = fractions(spark, sf).where("yr = 2001").select("cell_id", "frac_built")
    c3 = views.building(spark, sf).groupBy((F.col("bldg_id") % 1000).alias("cell_id")).agg(F.count(F.lit(1)).alias("bldg_count"))
    return views.cell(spark, sf).select("cell_id").join(c2, "cell_id").join(c3, "cell_id", "left").select("cell_id", F.round("frac_built", 6).alias("frac_built"), F.coalesce("bldg_count", F.lit(0)).alias("bldg_count"))


@query(sql("cell frac", "SELECT cell_id FROM cell WHERE cell_id NOT IN (SELECT cell_id FROM frac WHERE yr = 1996)"))
def feature_table_missing(spark, sf):
    return views.cell(spark, sf).select("cell_id").join(fractions(spark, sf).where("yr = 1996"), "cell_id", "left_anti")


_CLUSTER = "(size * 3 + r + c) % 7"


def clustered(spark, sf):
    f = fractions(spark, sf).where("yr = 2001")
    return views.cell(spark, sf).join(f, "cell_id").withColumn("cluster", F.expr("cast((size * 3 + row + col) % 7 as int)"))


_CLUSTERED = f"SELECT cell.*, {', '.join('f.' + x for x in FRACS)}, ({_CLUSTER})::INT AS cluster FROM cell JOIN (SELECT * FROM frac WHERE yr = 2001) f ON cell.cell_id = f.cell_id"


@query(sql("cell frac", "SELECT cluster, (row_number() OVER (ORDER BY round(b, 9) DESC, round(t, 9) DESC, cluster) - 1)::INT AS cluster_id FROM (SELECT cluster, avg(frac_built) AS b, avg(frac_tree) AS t FROM clustered GROUP BY cluster)", clustered=_CLUSTERED))
def cluster_order(spark, sf):
    return labels.order_clusters(clustered(spark, sf), built="frac_built", tree="frac_tree")


@query(sql("cell frac", f"SELECT cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, {', '.join(f'round(avg({x}), 6) AS {x}' for x in FRACS)} FROM clustered GROUP BY cluster", clustered=_CLUSTERED))
def cluster_centroids(spark, sf):
    from pyspark.sql import Window

    m = clustered(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 6).alias(x) for x in FRACS])
    return m.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_RULES = (
    "SELECT cell_id, CASE WHEN wet >= 0.5 THEN 255 WHEN isb THEN 1 WHEN isf THEN 2 ELSE 3 END AS class_3, CASE WHEN wet >= 0.5 THEN 'water' WHEN NOT isb AND NOT isf AND farm THEN 'agricultural' END AS flag FROM ("
    "SELECT cell_id, frac_water + frac_flooded AS wet, frac_built >= 0.3 AND frac_built >= greatest(frac_tree, frac_crop + frac_range + frac_bare) AS isb, frac_tree >= 0.5 OR (frac_tree + frac_range >= 0.5 AND size % 20 >= 8) AS isf, frac_crop >= greatest(frac_range, frac_built, frac_tree) AS farm FROM clustered)"
)


@query(sql("cell frac", _RULES, clustered=_CLUSTERED))
def cluster_rules(spark, sf):
    f = {k: F.col(f"frac_{k}") for k in ("water", "flooded", "built", "tree", "crop", "range", "bare")}
    cls, flag = labels.cluster_class(f, F.col("size") % 20)
    return clustered(spark, sf).select("cell_id", cls.alias("class_3"), flag.alias("flag"))


_COLLAPSE = "CASE WHEN frac_built = top THEN 1 WHEN frac_tree = top THEN 2 WHEN frac_crop + frac_range + frac_bare = top THEN 3 ELSE 255 END"
_COLLAPSED = f"SELECT cell_id, {_COLLAPSE} AS cls, [1, 2, 3, 255][1 + (size % 5) % 4] AS ours FROM (SELECT *, greatest(frac_built, frac_tree, frac_crop + frac_range + frac_bare, frac_water + frac_flooded) AS top FROM clustered)"


def collapsed(spark, sf):
    cls = labels.collapse(F.col("frac_water") + F.col("frac_flooded"), F.col("frac_built"), F.col("frac_tree"), F.col("frac_crop") + F.col("frac_range") + F.col("frac_bare"))
    ours = F.array(*[F.lit(x) for x in (1, 2, 3, 255)])[((F.col("size") % 5) % 4).cast("int")]
    return clustered(spark, sf).select("cell_id", cls.alias("cls"), ours.alias("ours"))


@query(sql("cell frac", "SELECT cls, count(*) AS n FROM collapsed GROUP BY cls", clustered=_CLUSTERED, collapsed=_COLLAPSED))
def collapse_class(spark, sf):
    return collapsed(spark, sf).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


_K4 = "SELECT unnest([1, 2, 3, 255]) AS k"


@query(sql("cell frac", "SELECT a.k AS ours, b.k AS cls, count(cell_id) AS n FROM k4 a CROSS JOIN k4 b LEFT JOIN collapsed ON ours = a.k AND cls = b.k GROUP BY 1, 2", clustered=_CLUSTERED, collapsed=_COLLAPSED, k4=_K4))
def confusion_matrix(spark, sf):
    return labels.confusion(collapsed(spark, sf), "ours", "cls", [1, 2, 3, 255])


@query(
    sql(
        "cell frac",
        'SELECT k AS "class", round(same / nullif(mine, 0), 6) AS precision, round(same / nullif(ref, 0), 6) AS recall, round(mine / tot, 6) AS map_share, round(ref / tot, 6) AS ref_share, round(hit / tot, 6) AS agreement FROM (SELECT k, (SELECT count(*) FROM land WHERE ours = k) AS mine, (SELECT count(*) FROM land WHERE cls = k) AS ref, (SELECT count(*) FROM land WHERE cls = k AND ours = k) AS same, (SELECT count(*) FROM land) AS tot, (SELECT count(*) FROM land WHERE cls = ours) AS hit FROM (SELECT unnest([1, 2, 3]) AS k))',
        clustered=_CLUSTERED,
        collapsed=_COLLAPSED,
        land="SELECT * FROM collapsed WHERE ours <> 255 AND cls <> 255",
    )
)
def agreement_land(spark, sf):
    land = collapsed(spark, sf).where("ours <> 255 and cls <> 255")
    out = labels.agreement(land, "ours", "cls", [1, 2, 3])
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "map_share", "ref_share", "agreement")])


@query(
    sql(
        "cell frac",
        "SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.cluster, max((a.s + b.s) / sqrt((a.m1 - b.m1) ** 2 + (a.m2 - b.m2) ** 2)) AS r FROM spread a JOIN spread b ON a.cluster <> b.cluster GROUP BY a.cluster)",
        clustered=_CLUSTERED,
        m="SELECT cluster, avg(frac_built) AS m1, avg(frac_crop) AS m2 FROM clustered GROUP BY cluster",
        spread="SELECT m.cluster, m1, m2, avg(sqrt((frac_built - m1) ** 2 + (frac_crop - m2) ** 2)) AS s FROM clustered JOIN m ON clustered.cluster = m.cluster GROUP BY ALL",
    )
)
def davies_bouldin(spark, sf):
    return labels.davies_bouldin(clustered(spark, sf), "cluster", ["frac_built", "frac_crop"]).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


_BLOCK = "floor(x / 500)::BIGINT || '_' || floor(y / 500)::BIGINT"


@query(sql("cell", f"SELECT cell_id, {_BLOCK} AS block FROM cell"))
def spatial_blocks(spark, sf):
    return views.cell(spark, sf).select("cell_id", lattice.block_of(F.col("x"), F.col("y"), 500.0).alias("block"))


@query(sql("cell", "SELECT block, ((row_number() OVER (ORDER BY md5('42:' || block), block) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT " + _BLOCK + " AS block FROM cell)"))
def fold_assign(spark, sf):
    cells = views.cell(spark, sf).select(lattice.block_of(F.col("x"), F.col("y"), 500.0).alias("block"))
    return lattice.deal_folds(cells, 5)


_PCT = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by})"


@query(sql("frac", f"SELECT cell_id, yr, round({_PCT.format(by='yr', v='round_even(frac_built, 6)')}, 6) AS pct FROM frac"))
def pct_rank_features(spark, sf):
    f = fractions(spark, sf).select("cell_id", "yr", F.bround("frac_built", 6).alias("v"))
    return ranks.pct_rank(f, "v", ["yr"]).select("cell_id", "yr", F.round("pct", 6).alias("pct"))


@query(sql("frac", "SELECT 'rf_change' AS model, cell_id FROM growth WHERE candidate UNION ALL SELECT 'rf_state', cell_id FROM growth WHERE candidate OR built_baseline", yearly=_YEARLY, growth=_GROWTH))
def training_set(spark, sf):
    g = labels.growth(by_year(spark, sf))
    return g.where("candidate").select(F.lit("rf_change").alias("model"), "cell_id").unionByName(g.where("candidate or built_baseline").select(F.lit("rf_state").alias("model"), "cell_id"))


_Z = {
    "long": "SELECT cell_id, is_ref, is_candidate, unnest(z) AS v, unnest(range(64)) AS i FROM profile",
    "stats": "SELECT i, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS s FROM long WHERE is_ref OR is_candidate GROUP BY i",
    "zs": "SELECT cell_id, is_ref, is_candidate, long.i, (v - m) / s AS z FROM long JOIN stats ON long.i = stats.i",
}


def standardised(spark, sf):
    return similarity.standardise(views.profile(spark, sf), F.col("is_ref") | F.col("is_candidate"))


@query(sql("profile", "SELECT cell_id, round(sqrt(sum(z * z)), 6) AS norm FROM zs GROUP BY cell_id", **_Z))
def zscore_profiles(spark, sf):
    from ..functions.vectors import norm

    return standardised(spark, sf).select("cell_id", F.round(norm(F.col("z")), 6).alias("norm"))


_ZL = {**_Z, "zl": "SELECT cell_id, is_ref, is_candidate, list(z ORDER BY i) AS z FROM zs GROUP BY cell_id, is_ref, is_candidate"}
_KNN = {**_ZL, "near": "SELECT a.cell_id, list_distance(a.z, b.z) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.z, b.z)) AS k FROM zl a JOIN zl b ON b.is_ref AND a.cell_id <> b.cell_id WHERE a.cell_id % 7 = 0 OR a.is_ref IS NOT NULL", "knn": "SELECT cell_id, avg(d) AS distance FROM near WHERE k <= 10 GROUP BY cell_id"}


def knn(spark, sf):
    z = standardised(spark, sf)
    return similarity.knn_distance(z, z.where("is_ref"), 10)


@query(sql("profile", "SELECT cell_id, round(distance, 6) AS distance FROM knn", **_KNN))
def knn_similarity(spark, sf):
    return knn(spark, sf).select("cell_id", F.round("distance", 6).alias("distance"))


@query(sql("profile", "SELECT cell_id, round(CASE WHEN hi > lo THEN 1 - greatest(0, least(1, (distance - lo) / (hi - lo))) ELSE 1 END, 5) AS score FROM knn, (SELECT quantile_cont(distance, 0.01) AS lo, quantile_cont(distance, 0.99) AS hi FROM knn)", **_KNN))
def similarity_rescale(spark, sf):
    return ranks.rescale(knn(spark, sf), "distance").select("cell_id", F.round("score", 5).alias("score"))


def _query_sql(distance: str, where: str = "a.is_candidate") -> str:
    return sql(
        "profile",
        "SELECT cell_id, (row_number() OVER (ORDER BY d, cell_id))::INT AS rank, round(d, 6) AS distance, round(CASE WHEN p > 0 THEN greatest(0, 1 - d / p) ELSE 1 END, 6) AS similarity, round(row_number() OVER (ORDER BY d, cell_id) / n, 6) AS rank_percentile FROM ds, (SELECT quantile_cont(d, 0.99) AS p, count(*) AS n FROM ds) QUALIFY row_number() OVER (ORDER BY d, cell_id) <= 20",
        **_ZL,
        ds=f"SELECT a.cell_id, {distance} AS d FROM zl a, zl q WHERE q.cell_id = 7 AND a.cell_id <> 7 AND {where}",
    )


def _query(spark, sf, **options):
    out = similarity.query(standardised(spark, sf), 7, F.col("is_candidate"), **options)
    return out.select("cell_id", "rank", *[F.round(c, 6).alias(c) for c in ("distance", "similarity", "rank_percentile")])


@query(_query_sql("list_distance(a.z, q.z)"))
def similarity_query_topn(spark, sf):
    return _query(spark, sf)


@query(_query_sql("1 - list_cosine_similarity(a.z, q.z)"))
def similarity_query_cosine(spark, sf):
    return _query(spark, sf, metric="cosine")


@query(_query_sql("list_distance(a.z, q.z)", "a.is_candidate AND sqrt(((a.cell_id // 50 - 0) ** 2 + (a.cell_id % 50 - 7) ** 2)::DOUBLE) <= 15"))
def similarity_query_radius(spark, sf):
    return _query(spark, sf, near=F.hypot(F.floor(F.col("cell_id") / COLS).cast("double"), (F.col("cell_id") % COLS - 7).cast("double")) <= 15)


@query(sql("profile", "SELECT cell_id, list(i ORDER BY gap, i)[1:3] AS closest, list(i ORDER BY gap DESC, i)[1:3] AS most_different FROM (SELECT a.cell_id, a.i::INT AS i, abs(a.z - q.z) AS gap FROM zs a JOIN zs q ON q.cell_id = 7 AND a.i = q.i) GROUP BY cell_id", **_Z))
def explain_gap(spark, sf):
    z = standardised(spark, sf)
    return similarity.explain(z, 7, z)


@query(sql("cell", "SELECT count(*) AS n FROM cell a, cell b WHERE b.cell_id = 7 AND (a.size % 10) / 1000.0 < 0.005 AND (b.size % 10) / 1000.0 < 0.005"))
def trivial_matches(spark, sf):
    one = views.cell(spark, sf).where("cell_id = 7").select((F.col("size") % 10 / 1000).alias("q"))
    return views.cell(spark, sf).crossJoin(F.broadcast(one)).where(similarity.trivial_match(F.col("size") % 10 / 1000, F.col("q"))).agg(F.count(F.lit(1)).alias("n"))


@query(sql("cell", f"SELECT cell_id, fold, round(100 * {_PCT.format(by='fold', v='elev')}, 6) AS percentile FROM f", f="SELECT cell_id, elev, cell_id % 5 AS fold FROM cell"))
def holdout_percentile(spark, sf):
    c = views.cell(spark, sf).select("cell_id", "elev", (F.col("cell_id") % 5).alias("fold"))
    return ranks.pct_rank(c, "elev", ["fold"]).select("cell_id", "fold", F.round(100 * F.col("pct"), 6).alias("percentile"))


@query(sql("cell", f"SELECT round(median(p), 6) AS med, round(avg((p > 90)::INT), 6) AS top10, round(avg((p > 70)::INT), 6) AS top30, round(100 * (1 - avg(is_ref::INT) / 2), 6) AS best FROM (SELECT is_ref, 100 * {_PCT.format(by='fold', v='elev')} AS p FROM f) WHERE is_ref OR TRUE", f="SELECT elev, cell_id % 5 AS fold, size % 3 = 0 AS is_ref FROM cell").replace("WHERE is_ref OR TRUE", ""))
def holdout_summary(spark, sf):
    c = views.cell(spark, sf).select("elev", (F.col("cell_id") % 5).alias("fold"), (F.col("size") % 3 == 0).alias("is_ref"))
    p = 100 * F.col("pct")
    return ranks.pct_rank(c, "elev", ["fold"]).agg(F.round(F.median(p), 6).alias("med"), F.round(F.avg((p > 90).cast("int")), 6).alias("top10"), F.round(F.avg((p > 70).cast("int")), 6).alias("top30"), F.round(100 * (1 - F.avg(F.col("is_ref").cast("int")) / 2), 6).alias("best"))


def criteria(spark, sf):
    c = clustered(spark, sf).withColumns({"slope_mean": (F.col("size") % 30).cast("double"), "log_dist_major": F.log1p(F.col("col") * 90.0), "log_dist_built": F.log1p(F.col("row") * 70.0), "log_dist_water": F.log1p((F.col("size") % 7) * 40.0)})
    return suitability.mcda_criteria(c)


_CRITERIA = (
    "SELECT cell_id, greatest(0, least(1, 1 - (size % 30) / 15)) AS c_slope, greatest(0, least(1, 1 - (exp(ln(1 + c * 90.0::DOUBLE)) - 1) / 3000)) AS c_road, greatest(0, least(1, 1 - (exp(ln(1 + r * 70.0::DOUBLE)) - 1) / 2000)) AS c_built, greatest(0, least(1, (exp(ln(1 + (size % 7) * 40.0::DOUBLE)) - 1 - 100) / 100)) AS c_water, greatest(0, least(1, frac_range + frac_bare + 0.6::DOUBLE * frac_crop + 0.2::DOUBLE * frac_tree)) AS c_cover FROM clustered"
)
_CS = ["c_slope", "c_road", "c_built", "c_water", "c_cover"]
_W3 = dict(zip(("c_slope", "c_road", "c_cover"), WEIGHTS.tolist(), strict=True))


@query(sql("cell frac", f"SELECT cell_id, {rounds(_CS)} FROM crit", clustered=_CLUSTERED, crit=_CRITERIA))
def mcda_criteria(spark, sf):
    return criteria(spark, sf).select("cell_id", *[F.round(c, 6).alias(c) for c in _CS])


@query(sql("cell frac", f"SELECT cell_id, round({' + '.join(f'{c} * {w!r}::DOUBLE' for c, w in _W3.items())}, 6) AS score FROM crit", clustered=_CLUSTERED, crit=_CRITERIA))
def mcda_score(spark, sf):
    return criteria(spark, sf).select("cell_id", F.round(suitability.weighted(_W3), 6).alias("score"))


@query(
    "WITH RECURSIVE p(k, a, b, c) AS (SELECT 0, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE UNION ALL SELECT k + 1, x / (x + y + z), y / (x + y + z), z / (x + y + z) FROM (SELECT k, a + 3 * b + 5 * c AS x, a / 3 + b + 3 * c AS y, a / 5 + b / 3 + c AS z FROM p) WHERE k < 60) SELECT 'c_slope' AS criterion, round(a, 6) AS weight FROM p WHERE k = 60 UNION ALL SELECT 'c_road', round(b, 6) FROM p WHERE k = 60 UNION ALL SELECT 'c_cover', round(c, 6) FROM p WHERE k = 60"
)
def ahp_weights_power_iter(spark, sf):
    return spark.createDataFrame([(k, round(float(w), 6)) for k, w in _W3.items()], "criterion string, weight double")


_W5, _W4 = suitability.default_weights(), suitability.default_weights(cover=False)


@query(sql("cell frac", f"SELECT cell_id, round({' + '.join(f'{c} * {w!r}::DOUBLE' for c, w in _W5.items())}, 6) AS mcda, round({' + '.join(f'{c} * {w!r}::DOUBLE' for c, w in _W4.items())}, 6) AS mcda_no_cover FROM crit", clustered=_CLUSTERED, crit=_CRITERIA))
def mcda_variants(spark, sf):
    return criteria(spark, sf).select("cell_id", F.round(suitability.weighted(_W5), 6).alias("mcda"), F.round(suitability.weighted(_W4), 6).alias("mcda_no_cover"))


# Two scores and a label on the lattice, for the metrics.
_SCORED = "SELECT cell_id, r, c, elev, size, (size * 13 + cell_id * 7) % 101 AS a, (elev * 3 + cell_id * 11) % 97 AS b, (size * 13 + cell_id * 7) % 101 + cell_id % 41 > 75 AS y, CASE WHEN cell_id % 3 = 0 THEN 'adjacent' ELSE 'outlying' END AS kind FROM cell"


def scored(spark, sf):
    return views.cell(spark, sf).selectExpr("cell_id", "row", "col", "elev", "size", "(size * 13 + cell_id * 7) % 101 as a", "(elev * 3 + cell_id * 11) % 97 as b", "(size * 13 + cell_id * 7) % 101 + cell_id % 41 > 75 as y", "if(cell_id % 3 = 0, 'adjacent', 'outlying') as kind")


_RANKED = f"SELECT *, {_PCT.format(by='1', v='a')} AS ra, {_PCT.format(by='1', v='b')} AS rb FROM scored".replace("PARTITION BY 1, ", "PARTITION BY ").replace("PARTITION BY 1 ", "").replace("PARTITION BY 1", "")
_AUC = "(sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y))"
_MID = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE"


@query(sql("cell", "SELECT cell_id, round(0.3::DOUBLE * ra + 0.7::DOUBLE * rb, 6) AS score FROM ranked", scored=_SCORED, ranked=_RANKED))
def combine_scores(spark, sf):
    r = ranks.pct_rank(ranks.pct_rank(scored(spark, sf), "a", out="ra"), "b", out="rb")
    return r.select("cell_id", F.round(0.3 * F.col("ra") + 0.7 * F.col("rb"), 6).alias("score"))


_GRID = {
    "scored": _SCORED,
    "ranked": _RANKED,
    "grid": "SELECT *, round(w * ra + (1 - w) * rb, 12) AS s FROM ranked, (SELECT unnest(range(11)) / 10.0::DOUBLE AS w)",
    "aucs": f"SELECT w AS weight, {_AUC} AS auc FROM (SELECT w, y, {_MID.format(by='w', v='s')} AS rk FROM grid) GROUP BY w",
}


def _aucs(spark, sf):
    return suitability.combine(scored(spark, sf), ["a", "b"], [i / 10 for i in range(11)], "y")


@query(sql("cell", "SELECT weight, round(auc, 6) AS auc FROM aucs", **_GRID))
def weight_grid(spark, sf):
    return _aucs(spark, sf).select("weight", F.round("auc", 6).alias("auc"))


@query(sql("cell", "SELECT weight, round(auc, 6) AS auc FROM aucs ORDER BY round(auc, 4) DESC, round(abs(weight - 0.5), 9), weight LIMIT 1", **_GRID))
def choose_weight(spark, sf):
    return suitability.best_weight(_aucs(spark, sf)).select("weight", F.round("auc", 6).alias("auc"))


_CLASSES = "SELECT scored.*, CASE WHEN a >= q9 THEN 1 WHEN a >= q7 THEN 2 WHEN a >= q4 THEN 3 ELSE 4 END AS class FROM scored, (SELECT quantile_cont(a, 0.9) AS q9, quantile_cont(a, 0.7) AS q7, quantile_cont(a, 0.4) AS q4 FROM scored)"


@query(sql("cell", "SELECT class, count(*) AS n FROM classes GROUP BY class", scored=_SCORED, classes=_CLASSES))
def suitability_class(spark, sf):
    return ranks.quantile_classes(scored(spark, sf), "a").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_SITES = {
    "scored": _SCORED,
    "classes": _CLASSES,
    "mark": "SELECT * FROM classes WHERE class <= 2",
    "reach": "SELECT cell_id, r, c, cell_id AS root FROM mark UNION SELECT m.cell_id, m.r, m.c, reach.root FROM reach JOIN mark m ON abs(m.r - reach.r) + abs(m.c - reach.c) = 1",
    "patch": "SELECT p, count(*) AS n_cells, avg(a) AS mean_score, max(a) AS max_score FROM (SELECT cell_id, min(root) AS p FROM reach GROUP BY cell_id) g JOIN scored ON g.cell_id = scored.cell_id GROUP BY p",
    "site": "SELECT *, row_number() OVER (ORDER BY mean_score DESC, n_cells DESC, p) AS site_id FROM patch WHERE n_cells >= 2",
}


def _sites(spark, sf):
    best = ranks.quantile_classes(scored(spark, sf), "a").where("class <= 2")
    labelled = best.join(patches.patches(best, COLS), "cell_id")
    return suitability.sites(patches.patch_stats(labelled, "a", 1e4), 2.0, 20, 3.0)


@query(sql("cell", "SELECT site_id, n_cells, n_cells::DOUBLE AS area_ha, round(mean_score, 4) AS mean_score, max_score, CASE WHEN n_cells >= 3 AND k <= 20 THEN k END AS top_site_rank FROM (SELECT *, row_number() OVER (PARTITION BY n_cells >= 3 ORDER BY mean_score DESC, n_cells DESC, p) AS k FROM site)", **_SITES))
def candidate_sites(spark, sf):
    s = _sites(spark, sf)
    return s.select("site_id", "n_cells", F.col("area_ha").cast("double").alias("area_ha"), F.round("mean_score", 4).alias("mean_score"), "max_score", "top_site_rank")


@query(sql("cell", "SELECT site_id, n_cells FROM site WHERE n_cells >= 3 ORDER BY mean_score DESC, n_cells DESC, p LIMIT 20", **_SITES))
def top_sites(spark, sf):
    return _sites(spark, sf).where("top_site_rank is not null").select("site_id", "n_cells")


_MODELS = "SELECT cell_id, y, kind, unnest(['a', 'b']) AS model, unnest([a, b]) AS score FROM scored"


def models(spark, sf):
    return scored(spark, sf).select("cell_id", "y", "kind", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("model", "score"))


@query(sql("cell", f"SELECT model, round({_AUC}, 6) AS auc, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg FROM (SELECT *, {_MID.format(by='model', v='score')} AS rk FROM models) GROUP BY model", scored=_SCORED, models=_MODELS))
def roc_auc_by_model(spark, sf):
    return ranks.auc(models(spark, sf), "y", "score", ["model"]).withColumn("auc", F.round("auc", 6))


@query(sql("evaluation", f"SELECT round({_AUC}, 6) AS auc FROM (SELECT *, {_MID.format(by='1', v='score')} AS rk FROM evaluation)"))
def evaluation_auc(spark, sf):
    return ranks.auc(views.evaluation(spark, sf), "y", "score").select(F.round("auc", 6).alias("auc"))


@query(sql("cell", "SELECT model, score AS threshold, round(sum(sum((NOT y)::INT)) OVER w / sum(sum((NOT y)::INT)) OVER (PARTITION BY model), 6) AS fpr, round(sum(sum(y::INT)) OVER w / sum(sum(y::INT)) OVER (PARTITION BY model), 6) AS tpr FROM models GROUP BY model, score WINDOW w AS (PARTITION BY model ORDER BY score DESC)", scored=_SCORED, models=_MODELS))
def roc_curve(spark, sf):
    return ranks.roc_curve(models(spark, sf), "y", "score", ["model"]).select("model", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    sql(
        "cell",
        "SELECT model, f AS fraction, top AS n, hits, round(hits / top, 6) AS precision, round(hits / p, 6) AS recall, round(hits / top / (p / n_all), 6) AS lift FROM (SELECT r.model, f, top, p, n_all, count(*) FILTER (y) AS hits FROM r JOIN (SELECT model, n_all, p, f, greatest(1, round_even(f * n_all, 0))::BIGINT AS top FROM (SELECT model, count(*) AS n_all, count(*) FILTER (y) AS p FROM models GROUP BY model), (SELECT unnest([0.1::DOUBLE, 0.3]) AS f)) t ON r.model = t.model AND k <= top GROUP BY ALL)",
        scored=_SCORED,
        models=_MODELS,
        r="SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cell_id) AS k FROM models",
    )
)
def top_n_lift(spark, sf):
    out = ranks.top_n(models(spark, sf), "y", "score", [0.1, 0.3], ["model"])
    return out.select("model", "fraction", "n", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "lift")])


@query(
    sql(
        "cell",
        "SELECT model, j AS point, round(pos / n_all, 4) AS flagged, round(count(k) / p, 4) AS hit_share FROM (SELECT model, n_all, p, j, round_even(j * n_all / 100, 0)::BIGINT AS pos FROM (SELECT model, count(*) AS n_all, count(*) FILTER (y) AS p FROM models GROUP BY model), (SELECT unnest(range(101)) AS j)) t LEFT JOIN (SELECT model AS m, k FROM r WHERE y) h ON m = model AND k <= pos GROUP BY model, j, pos, n_all, p",
        scored=_SCORED,
        models=_MODELS,
        r="SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, cell_id) AS k FROM models",
    )
)
def toc_curve(spark, sf):
    return ranks.toc_curve(models(spark, sf), "y", "score", ["model"]).withColumn("point", F.col("point").cast("long"))


@query(sql("cell", f"SELECT kind, round({_AUC}, 6) AS auc FROM (SELECT k.kind, y, {_MID.format(by='k.kind', v='a')} AS rk FROM scored JOIN (SELECT unnest(['adjacent', 'outlying']) AS kind) k ON NOT y OR scored.kind = k.kind) GROUP BY kind", scored=_SCORED))
def auc_by_growth_type(spark, sf):
    return suitability.auc_by_type(scored(spark, sf), "y", "a", "kind", ["adjacent", "outlying"]).select("kind", F.round("auc", 6).alias("auc"))


@query(sql("cell", "SELECT round(h / p, 6) AS hit_rate, round(h / k, 6) AS precision, round(h / k / (p / n), 6) AS lift, round(k / n, 6) AS flagged FROM (SELECT count(*) AS n, count(*) FILTER (y) AS p, count(*) FILTER (class <= 2) AS k, count(*) FILTER (y AND class <= 2) AS h FROM classes)", scored=_SCORED, classes=_CLASSES))
def s1s2_hit_rate(spark, sf):
    out = suitability.class_hits(ranks.quantile_classes(scored(spark, sf), "a"), "y")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(sql("cell", f'SELECT l AS "limit", round({_AUC}, 6) AS auc FROM (SELECT l, y, {_MID.format(by="l", v="a")} AS rk FROM scored JOIN (SELECT unnest([10.0::DOUBLE, 20.0, 30.0]) AS l) ON size <= l) GROUP BY l', scored=_SCORED))
def slope_sensitivity(spark, sf):
    return suitability.slope_sweep(scored(spark, sf), [10.0, 20.0, 30.0], "y", "a", "size").select("limit", F.round("auc", 6).alias("auc"))


@query(sql("frac", "SELECT a, b, round(r, 5) AS r FROM (SELECT " + ", ".join(f"corr({x}, {y}) AS {x}__{y}" for i, x in enumerate(FRACS[:5]) for y in FRACS[i + 1 : 5]) + " FROM frac) UNPIVOT (r FOR pair IN (" + ", ".join(f"{x}__{y}" for i, x in enumerate(FRACS[:5]) for y in FRACS[i + 1 : 5]) + ")) , LATERAL (SELECT split_part(pair, '__', 1) AS a, split_part(pair, '__', 2) AS b)"))
def correlation_pairs(spark, sf):
    f = fractions(spark, sf)
    pairs = [(x, y) for i, x in enumerate(FRACS[:5]) for y in FRACS[i + 1 : 5]]
    one = f.agg(*[F.corr(x, y).alias(f"{x}__{y}") for x, y in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(f"{x}__{y}", 5).alias("r")) for x, y in pairs])))


@query(sql("frac", " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS med, round(stddev_pop({x}), 6) AS sd, round(min({x}), 6) AS low, round(max({x}), 6) AS high FROM frac" for x in FRACS)))
def feature_summary(spark, sf):
    one = fractions(spark, sf).agg(*[F.struct(F.round(F.avg(x), 6).alias("mean"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("med"), F.round(F.stddev_pop(x), 6).alias("sd"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high")).alias(x) for x in FRACS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), *[F.col(f"{x}.{k}").alias(k) for k in ("mean", "med", "sd", "low", "high")]) for x in FRACS])))


@query(sql("frac", "SELECT round(count(*) FILTER (grew) / nullif(count(*) FILTER (candidate), 0), 6) AS growth_share, round(count(*) FILTER (built_baseline) / count(*), 6) AS built_share FROM growth", yearly=_YEARLY, growth=_GROWTH))
def persistent_growth_share(spark, sf):
    g = labels.growth(by_year(spark, sf))
    return g.agg(F.round(F.try_divide(F.count_if("grew"), F.count_if("candidate")), 6).alias("growth_share"), F.round(F.count_if("built_baseline") / F.count(F.lit(1)), 6).alias("built_share"))


@query(sql("pixel", "SELECT code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pixel WHERE code NOT IN (0, 10) AND yr = 2001 GROUP BY code"))
def class_shares(spark, sf):
    from pyspark.sql import Window

    n = views.pixel(spark, sf).where("code not in (0, 10) and yr = 2001").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(sql("frac", "SELECT CASE WHEN a.cell_id IS NULL THEN 'only_b' WHEN b.cell_id IS NULL THEN 'only_a' ELSE 'changed' END AS difference, count(*) AS n FROM (SELECT * FROM frac WHERE yr = 2000) a FULL JOIN (SELECT * FROM frac WHERE yr = 2001) b ON a.cell_id = b.cell_id WHERE a.cell_id IS NULL OR b.cell_id IS NULL OR abs(a.frac_built - b.frac_built) > 1e-9 OR abs(a.frac_crop - b.frac_crop) > 1e-9 GROUP BY 1"))
def project_diff(spark, sf):
    f = fractions(spark, sf)
    d = suitability.project_diff(f.where("yr = 2000"), f.where("yr = 2001"), "cell_id", ["frac_built", "frac_crop"])
    return d.groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


@query(sql("cell", "SELECT cell_id, round_even((elev - lo) / (hi - lo) * 65535, 0)::INT AS elev, round_even((size - slo) / (shi - slo) * 65535, 0)::INT AS size FROM cell, (SELECT min(elev)::DOUBLE AS lo, max(elev)::DOUBLE AS hi, min(size)::DOUBLE AS slo, max(size)::DOUBLE AS shi FROM cell)"))
def quantised_profiles(spark, sf):
    c = views.cell(spark, sf).select("cell_id", F.col("elev").cast("double").alias("elev"), F.col("size").cast("double").alias("size"))
    return similarity.quantised(c, ["elev", "size"])


def _ordered_area(spark, sf):
    return vector.buildings_per_cell(views.building(spark, sf).withColumn("cell_id", F.col("bldg_id") % 100), 1e4)


assert np.allclose(WEIGHTS, [0.637, 0.258, 0.105], atol=1e-3)
assert raster.ring_cells(250, 100) == 2 and raster.ring_cells(500, 100) == 5
