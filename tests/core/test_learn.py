import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith import contracts
from terralith.operators import learn


@pytest.fixture(scope="module")
def town(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(240):
        k = i % 3
        x, y = r.normal((0, 4, 8)[k], 0.5), r.normal((0, 5, 0)[k], 0.5)
        rows.append((i, float(x), float(y), bool(x + r.normal(0, 0.5) > 3), i % 4))
    return spark.createDataFrame(rows, "cell_id long, elev_mean double, slope_mean double, y boolean, fold int").cache()


def test_scan_finds_three_clusters(town):
    scan = learn.k_scan(town, ["elev_mean", "slope_mean"], (2, 3), starts=2)
    best = max((s for s in scan if s["method"] == "kmeans"), key=lambda s: s["silhouette"])
    assert best["k"] == 3 and best["silhouette"] > 0.7
    assert {s["method"] for s in scan} == {"kmeans", "gmm"}


def test_silhouette_against_the_definition(spark):
    pts = [(0, 0, 0.0), (1, 0, 1.0), (2, 1, 5.0), (3, 1, 7.0), (4, 2, 20.0)]
    got = learn.silhouette(spark.createDataFrame(pts, "cell_id long, c int, x double"), "c", ["x"]).first().silhouette
    want = []
    for i, c, x in pts:
        own = [abs(x - b) for j, k, b in pts if k == c and j != i]
        if not own:
            want.append(0)
            continue
        a = np.mean(own)
        b = min(np.mean([abs(x - v) for _, k, v in pts if k == o]) for o in {0, 1, 2} - {c})
        want.append((b - a) / max(a, b))
    assert np.isclose(got, np.mean(want))


def test_pca_variance(town):
    share, n = learn.pca_variance(town, ["elev_mean", "slope_mean"])
    assert np.isclose(sum(share), 1) and n in (1, 2)


def test_out_of_fold_importance_and_ablation(town):
    cols = ["elev_mean", "slope_mean"]
    scores, models = learn.out_of_fold(town, cols, "y", trees=10, depth=4)
    assert scores.count() == 240 and len(models) == 4
    assert learn.mean_fold_auc(scores, "y") > 0.85
    imp = {r.feature: r.drop for r in learn.permutation_importance(town, cols, "y", models[:1], [0], repeats=1).collect()}
    assert imp["elev_mean"] > imp["slope_mean"]
    abl = {r.group: r.change for r in learn.ablation(town, {"terrain": ("elev_mean",)}, cols, "y", trees=5, depth=3).collect()}
    assert abl["none"] == 0 and abl["terrain"] < 0
    with pytest.raises(contracts.ContractError):
        learn.out_of_fold(town.withColumn("frac_built", F.lit(1.0)), ["frac_built"], "y")


def test_holdout_never_sees_the_folds_references(town):
    seen = []

    def scorer(cells, refs, there):
        seen.append((sorted(r[0] for r in refs.select("fold").distinct().collect()), sorted(r[0] for r in there.select("fold").distinct().collect())))
        return there.select("cell_id", F.col("elev_mean").alias("score"))

    out = learn.holdout(town.withColumn("is_ref", F.col("y")), scorer)
    assert out.count() == 240 and all(set(a).isdisjoint(b) for a, b in seen)
    assert out.agg(F.max("percentile")).first()[0] == 100


def test_shuffling_keeps_values(town):
    a, b = town.agg(F.sum("elev_mean")).first()[0], learn.shuffled(town, "elev_mean", 1)
    assert np.isclose(b.agg(F.sum("elev_mean")).first()[0], a)
    assert b.join(town.select("cell_id", F.col("elev_mean").alias("o")), "cell_id").where("o <> elev_mean").count() > 200


def test_ranked_features(town):
    r = learn.ranked_features(town, ["elev_mean"])
    assert r.agg(F.max("elev_mean")).first()[0] == 1.0 and r.count() == 240


def test_queries_use_all_folds_and_default_settings(spark, monkeypatch):
    from terralith.plans import extra

    sf, seen = "/root/testdata/sf0.001", {}
    folds = sorted(r[0] for r in extra._training(spark, sf).select("fold").distinct().collect())

    def note(name, out=None):
        def call(df, *args, **kw):
            seen[name] = (args, kw)
            return out

        monkeypatch.setattr(learn, name, call)

    models = [f"model {f}" for f in folds]
    note("out_of_fold", ("scores", models))
    note("permutation_importance")
    note("ablation")
    note("tune", {"leaf": 1, "features": "sqrt", "auc": 0.5})
    note("k_scan", [{"k": 3, "method": "kmeans", "cost": 1, "silhouette": 1, "davies_bouldin": 1}])
    reduced = {"trees", "depth", "repeats", "starts", "sample"}
    extra.rf_importance(spark, sf)
    assert len(folds) > 1 and seen["permutation_importance"][0][2:] == (models, folds)
    for q in (extra.rf_oof, extra.rf_ablation, extra.rf_tune, extra.k_scan):
        q(spark, sf)
    assert len(seen) == 5 and not any(reduced & set(kw) for _, kw in seen.values())
    assert seen["tune"][0][2:] == ((1, 5, 20), ("sqrt", "0.5"))
    assert list(seen["k_scan"][0][1]) == list(range(3, 11)) and len(seen["k_scan"][0][0]) > 2


def test_forests_grown_by_tasks_are_as_good_as_spread_ones(spark, town, monkeypatch):
    from terralith.operators import trees

    cols, auc = ["elev_mean", "slope_mean"], {}
    for most in (trees.VALUES, 0):
        monkeypatch.setattr(trees, "VALUES", most)
        scores, models = learn.out_of_fold(town, cols, "y", trees=20, depth=5, leaf=2)
        assert all(isinstance(m, trees.Trees) == (most > 0) for m in models)
        auc[most] = learn.mean_fold_auc(scores, "y")
        assert np.argmax(models[0].featureImportances.toArray()) == 0 and scores.agg(F.max("score") <= 1, F.min("score") >= 0).first() == (True, True)
    assert abs(auc[0] - auc[max(auc)]) < 0.05


def test_a_tree_keeps_leaves_and_weights():
    from terralith.operators import trees

    x = np.arange(2000.0)[:, None] % 1000
    bins, bounds = trees.binned(x)
    assert len(bounds[0]) < 256 and (np.diff(bins[0][:1000].astype(int)) >= 0).all()
    label = x[:, 0] >= 500
    feature, cut, left, share, gain = trees.grow(bins, label, np.ones(2000), np.random.default_rng(1), 5, 1, 12)
    assert feature[0] == 0 and gain[0] == 1 and share[left[0]] < 0.05 and share[left[0] + 1] > 0.95
    assert trees.drawn("sqrt", 4) == 2 and trees.drawn("0.5", 3) == 2


def test_scan_takes_few_jobs_and_agrees_with_spread_fits(spark, town, monkeypatch):
    from terralith.operators import labels

    cols, both = ["elev_mean", "slope_mean"], town.unionByName(town.withColumn("cell_id", F.col("cell_id") + 1000))  # every row twice
    spark.sparkContext.setJobGroup("scan", "scan")
    got = {(r["k"], r["method"]): r for r in learn.k_scan(both, cols, range(2, 6))}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scan"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 8 and jobs < 40

    z = learn.assembled(learn.scaled(both, cols), cols).cache()
    km, gm = learn.kmeans(z, 3, starts=3), learn.gmm(z, 3)
    assert np.isclose(got[3, "kmeans"]["cost"], km.summary.trainingCost)
    assert np.isclose(got[3, "gmm"]["cost"], learn.bic(gm.summary.logLikelihood, 480, 3, 2), rtol=1e-3)
    labelled = km.transform(z)
    assert np.isclose(got[3, "kmeans"]["silhouette"], learn.silhouette(labelled, "prediction", cols).first().silhouette)
    assert np.isclose(got[3, "kmeans"]["davies_bouldin"], labels.davies_bouldin(labelled, "prediction", cols).first().davies_bouldin)

    from terralith.operators import clusters

    monkeypatch.setattr(clusters, "VALUES", 0)
    for r in learn.k_scan(both, cols, (3,)):
        assert all(np.isclose(r[v], got[3, r["method"]][v], rtol=1e-6) for v in ("cost", "silhouette", "davies_bouldin"))


def test_scan_of_odd_tables(spark):
    # On a line, with copies, a constant column and fewer distinct rows than clusters.
    few = spark.createDataFrame([(i, float(i % 3), 2.0 * (i % 3), 7.0) for i in range(30)], "cell_id long, x double, n double, c double")
    got = {(r["k"], r["method"]): r for r in learn.k_scan(few, ["x", "n", "c"], (1, 2, 5))}
    assert got[5, "kmeans"]["cost"] == 0 and np.isclose(got[5, "kmeans"]["silhouette"], 1) and got[5, "kmeans"]["davies_bouldin"] == 0
    assert got[1, "kmeans"]["davies_bouldin"] is None and np.isclose(got[1, "kmeans"]["cost"], 60)
    cov = np.cov(np.array([[i % 3, 2 * (i % 3), 7] for i in range(30)]).T, bias=True)
    s = np.sqrt(np.diag(cov))
    s[2] = 1
    cov = cov / np.outer(s, s) + 1e-6 * np.eye(3)  # one component: the normal density in closed form
    assert np.isclose(got[1, "gmm"]["cost"], 30 * (3 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.trace(np.linalg.solve(cov, cov - 1e-6 * np.eye(3)))) + 9 * np.log(30))
    assert learn.k_scan(few.where("false"), ["x"], (2,)) == []
    with pytest.raises(ValueError):
        learn.k_scan(few.withColumn("x", F.when(F.col("cell_id") > 3, F.col("x"))), ["x"], (2,))


def test_leaves_find_the_nearest_among_ties_copies_and_gaps():
    from terralith.operators.similarity import Leaves

    r = np.random.default_rng(3)
    for m, ids in ((r.normal(size=(9000, 2)), np.arange(9000)), (r.integers(0, 5, (9000, 3)).astype(float), np.arange(9000)), (np.exp(5 * r.normal(size=(500, 4))), np.arange(500) // 3), (np.zeros((3, 2)), np.arange(3))):
        m[0] = np.nan
        near = Leaves(ids, m, 10)
        x, own = np.concatenate([m[1:200], r.normal(size=(100, m.shape[1])), np.full((1, m.shape[1]), np.nan)]), np.concatenate([ids[1:200], np.full(101, -1)])
        got = near.nearest(own, x)
        for v, key, row in zip(x, own, got, strict=True):
            d = np.sqrt(((v - m[ids != key]) ** 2).sum(1))
            d = np.sort(d[np.isfinite(d)])[:10]
            assert np.allclose(row[: len(d)], d, rtol=1e-12, atol=0) and np.isnan(row[len(d) :]).all()
    m, seen = r.normal(size=(20_000, 2)), []
    near = Leaves(np.arange(20_000), m, 10)
    rows = near.rows
    near.rows = lambda leaves: seen.append(len(out := rows(leaves))) or out
    near.nearest(np.arange(20_000), m)
    assert sum(seen) * 64 < 20_000**2 / 5  # few pairs of all are compared


def test_holdout_takes_whole_forests_and_makes_ranks_once(town, spark, monkeypatch):
    from terralith.plans import more

    seen, ranked = [], learn.ranked_features
    monkeypatch.setattr(learn, "ranked_features", lambda *a: seen.append("ranks") or ranked(*a))
    rf = learn.scorers(["elev_mean", "slope_mean"], "elev_mean", ["elev_mean"], trees=5, depth=3)["rf"]
    cells = town.withColumn("is_ref", F.col("y"))
    scores = [rf(cells, cells.where(f"is_ref and fold <> {f}"), cells.where(f"fold = {f}")) for f in (0, 1)]
    assert seen == ["ranks"] and [s.count() for s in scores] == [60, 60]
    monkeypatch.setattr(learn, "scorers", lambda *a, **kw: seen.append(kw) or {})
    more.holdout_scorers(spark, "/root/testdata/sf0.001")
    assert "trees" not in seen[-1]


def test_run_model_searches_the_whole_grid_and_fits_nothing_twice(town, spark, monkeypatch):
    from terralith.operators import trees
    from terralith.plans import more

    cols, fits, fit = ["elev_mean", "slope_mean"], [], trees.Forest.fit
    monkeypatch.setattr(trees.Forest, "fit", lambda self, df: fits.append((self.leaf, self.features)) or fit(self, df))
    monkeypatch.setattr(learn, "permutation_importance", lambda *a: town.select(F.lit(0.0).alias("drop"), F.lit("x").alias("feature")))
    two = town.where("fold < 2").withColumn("all", F.lit(True))
    got = learn.run_model(two, two, cols, "y", "all", "all", leaves=(1, 60), shares=("onethird", "0.5"), trees=5, depth=3)
    best = got["metrics"].first()
    assert fits[:4] == [(1, "onethird")] * 2 + [(60, "onethird")] * 2 and fits[4:] == [(best.leaf, best.features)]  # both shares draw one of two features
    again = learn.out_of_fold(two, cols, "y", leaf=best.leaf, features=best.features, trees=5, depth=3)[0]
    assert got["validation"].join(again.withColumnRenamed("score", "s"), "cell_id").where("score = s").count() == 120
    monkeypatch.setattr(learn, "run_model", lambda *a, **kw: fits.append(kw) or {"validation": two, "final": two})
    more.rf_run_model(spark, "/root/testdata/sf0.001")
    assert not {"trees", "leaves", "shares", "depth"} & set(fits[-1])
