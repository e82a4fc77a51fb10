"""Operators against hand-made cases and brute force, and the stage pipeline on the synthetic town."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith import contracts
from terralith.config import MCDA_MATRIX, Config, ConfigError, Years
from terralith.functions import geodesy, ranks
from terralith.operators import labels, lattice, patches, proximity, raster, similarity, suitability, vector
from terralith.plans import pipeline
from terralith.sources import files, sinks, synthetic


def cells(spark, values, name="v"):
    rows = [(r * len(values[0]) + c, r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"cell_id long, row long, col long, {name} double")


def test_class_fractions_skip_clouds_and_empty_cells(spark):
    px = [(0, 10)] * 2 + [(0, 2)] * 2 + [(1, 0)] * 4
    got = {r.cell_id: r for r in raster.class_fractions(spark.createDataFrame(px, "cell_id long, code int"), ["cell_id"]).collect()}
    assert got[0].frac_tree == 1.0 and got[0].nodata_frac == 0.5
    assert got[1].frac_tree == 0.0 and got[1].nodata_frac == 1.0


def test_ring_mean_of_one_and_of_a_constant(spark):
    v = np.zeros((5, 5))
    v[2, 2] = 1
    got = {r.cell_id: r for r in raster.ring_means(cells(spark, v), ["v"], {"1": 1}).collect()}
    assert got[12].ring1_v == 0 and got[11].ring1_v == 1 / 8
    assert {round(r.ring1_v, 12) for r in raster.ring_means(cells(spark, np.full((4, 5), 0.3)), ["v"], {"1": 2}).collect()} == {0.3}


def test_ring_width_rounds_half_to_even():
    assert [raster.ring_cells(250, c) for c in (50, 100, 200)] == [5, 2, 1]
    with pytest.raises(ValueError):
        raster.ring_cells(40, 100)


def test_disk_holds_81_cells_at_five(spark):
    got = raster.disk_sums(cells(spark, np.ones((13, 13))), "v", 5)
    assert got.where("row = 6 and col = 6").first().disk == 81
    assert math.isclose(vector.disk_area(5, 100.0), 0.81)


def test_horn_on_a_plane(spark):
    z = [[3 * c - 4 * r for c in range(6)] for r in range(5)]
    got = raster.horn(cells(spark, z), "v", 1.0).collect()
    assert all(math.isclose(r.slope, math.degrees(math.atan(5))) for r in got)
    flat = raster.horn(cells(spark, np.ones((3, 3))), "v", 1.0).collect()
    assert {(r.slope, r.aspect) for r in flat} == {(0.0, None)}


def test_bilinear_leaves_missing_cells_out(spark):
    src = cells(spark, [[0, 10], [20, 30]]).where("cell_id <> 3")
    t = spark.createDataFrame([(0, 1.0, -1.0), (1, 1.5, -1.5), (2, -9.0, 9.0)], "pixel_id long, x double, y double")
    got = {r.pixel_id: r.v for r in raster.resample_bilinear(t, src, "v", 1.0).collect()}
    assert got == {0: 10.0, 1: None, 2: None}


def test_patches(spark):
    c = spark.createDataFrame([(r, k) for r, k in ((0, 0), (0, 1), (1, 1), (3, 3), (4, 4))], "row long, col long")
    four = patches.patches(c, 5)
    assert four.select("patch").distinct().count() == 3
    assert patches.patches(c, 5, eight=True).select("patch").distinct().count() == 2


def test_patches_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    m = rng.random((30, 40)) < 0.55
    got = {r.cell_id: r.patch for r in patches.patches(spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(m))], "row long, col long"), 40).collect()}
    seen = {}
    for s in sorted(got):
        if s in seen:
            continue
        todo = [s]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen[x] = s
            r, c = divmod(x, 40)
            todo += [a * 40 + b for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= a < 30 and 0 <= b < 40 and m[a, b]]
    assert got == seen


def test_nearest_point_and_line(spark):
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(1).uniform(-3000, 3000, (80, 2)))], "cell_id long, x double, y double")
    p = spark.createDataFrame([(float(x), float(y)) for x, y in np.random.default_rng(2).uniform(-3000, 3000, (25, 2))], "x double, y double")
    a, b = np.array(q.select("x", "y").collect()), np.array(p.collect())
    want = np.minimum(np.sqrt(((a[:, None] - b) ** 2).sum(2)).min(1), 900)
    got = {r.cell_id: r.distance for r in proximity.nearest_point(q, p, 900.0, bucket=250.0).collect()}
    assert np.allclose([got[i] for i in range(80)], want)
    line = spark.createDataFrame([(0.0, 0.0, 1000.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0, 500.0, 0.0), (1, 500.0, 120.0), (2, -300.0, 400.0), (3, 9000.0, 0.0)], "cell_id long, x double, y double")
    assert {r.cell_id: r.distance for r in proximity.nearest_line(pts, line, 3000.0).collect()} == {0: 0.0, 1: 120.0, 2: 500.0, 3: 3000.0}


def test_whole_tables_against_brute_force(spark):
    from terralith.plans import model, registry
    from terralith.sources import views

    sf = "/root/testdata/sf0.001"
    run = lambda name: registry.QUERIES[name](spark, sf).toPandas()
    v = views.vertex(spark, sf).toPandas().sort_values(["line_id", "seq"])
    v["x2"], v["y2"] = v.groupby("line_id").x.shift(-1), v.groupby("line_id").y.shift(-1)
    seg = v.dropna()[["x", "y", "x2", "y2"]].to_numpy()
    cell, got = views.cell(spark, sf).select("cell_id", "x", "y").toPandas(), run("nearest_line_dist").set_index("cell_id").distance
    a, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    for r in cell.itertuples():
        t = np.clip(np.nan_to_num(((np.array([r.x, r.y]) - a) * d).sum(1) / np.where((d**2).sum(1) > 0, (d**2).sum(1), 1)), 0, 1)
        assert math.isclose(got[r.cell_id], min(800, np.hypot(*(a + t[:, None] * d - [r.x, r.y]).T).min(initial=800)), abs_tol=2e-6)
    assert len(got) == len(cell) and (v.line_id % 10 != 3).any()

    z = model.standardised(spark, sf).select("cell_id", "z").toPandas().set_index("cell_id").z
    got = run("explain_gap").set_index("cell_id")
    assert sorted(got.index) == sorted(z.index) and (z.index >= 20).any()
    for i, p in z.items():
        gap = np.abs(np.array(p) - np.array(z[7]))
        # Positions of explain count from 0.
        assert list(got.closest[i]) == np.lexsort((np.arange(len(gap)), gap))[:3].tolist()
        assert list(got.most_different[i]) == np.lexsort((np.arange(len(gap)), -gap))[:3].tolist()

    t = views.read(spark, sf, "lineitem").toPandas()
    want = t[t.l_quantity > 5].sort_values(["l_suppkey", "l_orderkey", "l_linenumber"]).groupby("l_partkey").l_quantity.first()
    got = run("mosaic_first_valid").set_index("pixel").v
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all() and (t.l_suppkey % 3 != 0).any()


def test_own_points_do_not_count(spark):
    q = spark.createDataFrame([(0, 50.0, -50.0), (1, 150.0, -50.0)], "cell_id long, x double, y double")
    p = spark.createDataFrame([(0, 60.0, -50.0), (0, 5.0, -5.0)], "own long, x double, y double")
    got = {r.cell_id: r.distance for r in proximity.nearest_point(q, p, 5000.0, outside="own").collect()}
    assert got[0] == 5000.0 and got[1] == 90.0


def test_line_length_is_kept(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i // 6, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 900, (60, 2)))], "line_id long, seq long, x double, y double")
    s = vector.segments(v)
    total = s.agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0]
    per = vector.length_per_cell(s.withColumns({"y1": -F.col("y1"), "y2": -F.col("y2")}), lattice.cell_of(F.col("x"), F.col("y"), 9, 9, 100.0))
    assert math.isclose(per.agg(F.sum("metres")).first()[0], total, rel_tol=1e-9)


def test_clip(spark):
    s = spark.createDataFrame([(0, -1.0, 1.0, 5.0, 1.0), (1, -1.0, 9.0, 5.0, 9.0)], "line_id int, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in vector.clip_lines(s, 0, 0, 2, 2).collect()] == [(0, 0.0, 1.0, 2.0, 1.0)]


def test_road_and_building_tags(spark):
    tags = ["primary;secondary", "track", "footway", " service", None]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in df.select(vector.road_class(F.col("t"))).collect()] == ["major", None, None, "minor", None]
    assert df.where("t = 'track'").select(vector.road_class(F.col("t"), tracks=True)).first()[0] == "minor"
    groups = spark.createDataFrame([(t,) for t in ("apartments", "yes", None, "temple", "garage")], "t string").select(vector.type_group(F.col("t"))).collect()
    assert [g[0] for g in groups] == ["residential", "unknown", "unknown", "institutional", "other"]


def test_utm_known_points(spark):
    # The central meridian, the equator, and published coordinates of the CN Tower (zone 17).
    pts = spark.createDataFrame([(75.0, 0.0, 43), (-79.387139, 43.642567, 17)], "lon double, lat double, zone int")
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    got = pts.select(e, n).collect()
    assert np.allclose(got[0], [500000, 0], atol=1e-6)
    assert np.allclose(got[1], [630084, 4833439], atol=1.0)


def test_ranks_match_pandas(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": rng.integers(0, 20, 300).astype(float)})
    df["cell_id"] = range(300)
    got = ranks.pct_rank(spark.createDataFrame(df), "v", ["g"]).toPandas().sort_values("cell_id")
    assert np.allclose(got.pct.to_numpy(), df.groupby("g").v.rank(pct=True).to_numpy())
    n = ranks.row_numbers(spark.createDataFrame(df), [F.col("v").desc(), F.col("cell_id")], ["g"]).toPandas().sort_values("cell_id")
    want = df.sort_values(["v", "cell_id"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert (n.n.to_numpy() == want.to_numpy()).all()


def test_auc_and_growth_types(spark):
    df = spark.createDataFrame([(1, True, 0.9, "adjacent"), (2, True, 0.1, "outlying"), (3, False, 0.5, None), (4, False, 0.4, None)], "cell_id long, y boolean, s double, kind string")
    assert ranks.auc(df, "y", "s").first().auc == 0.5
    assert {r.kind: r.auc for r in suitability.auc_by_type(df, "y", "s", "kind", ["adjacent", "outlying"]).collect()} == {"adjacent": 1.0, "outlying": 0.0}
    one = ranks.auc(df.where("y"), "y", "s").first()
    assert one.auc is None and one.n_pos == 2


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i, i < 2, -float(i)) for i in range(10)], "cell_id long, y boolean, s double")
    r = ranks.top_n(df, "y", "s", [0.2]).first()
    assert (r.n, r.precision, r.lift) == (2, 1.0, 5.0)
    toc = {r.point: (r.flagged, r.hit_share) for r in ranks.toc_curve(df, "y", "s").collect()}
    assert toc[0] == (0.0, 0.0) and toc[20] == (0.2, 1.0) and toc[100] == (1.0, 1.0)


def test_quantile_classes(spark):
    df = spark.range(10_000).select((F.col("id") / 10_000).alias("score"))
    got = {r["class"]: r.n for r in ranks.quantile_classes(df, "score").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 1000, 2: 2000, 3: 3000, 4: 4000}


def test_ahp_of_the_textbook():
    w, top, ratio = suitability.priorities(suitability.comparisons("1 3 5; 1/3 1 3; 1/5 1/3 1"))
    assert np.allclose(w, [0.637, 0.258, 0.105], atol=1e-3) and math.isclose(top, 3.039, abs_tol=1e-3) and math.isclose(ratio, 0.033, abs_tol=1e-3)
    with pytest.raises(ValueError):
        suitability.priorities(suitability.comparisons("1 2; 2 1"))
    # Published weights and ratio of the default matrix.
    w, top, ratio = suitability.priorities(suitability.comparisons(MCDA_MATRIX))
    assert np.allclose(w, [0.158, 0.298, 0.298, 0.089, 0.158], atol=1e-3) and math.isclose(top, 5.013, abs_tol=1e-3) and math.isclose(ratio, 0.003, abs_tol=1e-3)


def test_labels_of_a_planted_scene(spark):
    names = ["baseline", "confirm", "train1", "train2", "latest_confirm", "latest"]
    scene = {0: [1, 1, 1, 1, 1, 1], 1: [0, 0, 1, 1, 1, 1], 2: [0, 0, 0, 0, 1, 1], 3: [0, 1, 0, 0, 0, 0], 4: [0, 0, 0, 0, 0, 1], 5: [0, 0, 0, 0, 0.3, 0.3], 6: [0, 0, 0, 0, None, 1]}
    df = spark.createDataFrame([(k, *[None if x is None else float(x) for x in v]) for k, v in scene.items()], "cell_id long, " + ", ".join(f"{n} double" for n in names))
    g = {r.cell_id: r for r in labels.growth(df).collect()}
    assert [k for k in g if g[k].built_baseline] == [0]
    assert [k for k in g if g[k].grew] == [1, 2] and [k for k in g if g[k].ambiguous] == [4, 5]
    assert [k for k in g if g[k].chg_train_pos] == [1] and not g[3].candidate and not g[6].candidate


def test_later_years_do_not_reach_the_validation_run():
    assert labels.run_years("validation", Years()) == (2018, 2019)
    assert labels.run_years("final", Years()) == (2022, 2023)
    with pytest.raises(ValueError):
        labels.run_years("other", Years())


def test_growth_types_outlying_and_adjacent(spark):
    old = {(0, 0), (0, 1)}
    new = {(0, 2), (6, 6), (6, 7)}
    px = spark.createDataFrame([(r, c, (r, c) in old, (r, c) in new) for r in range(8) for c in range(8)], "row long, col long, old boolean, new boolean")
    got = {r.cell_id: r.lei_type for r in patches.growth_types(px, 8, 1, 1, 2).collect()}
    assert got == {1: "adjacent", 15: "outlying"}


def test_knn_leaves_itself_out(spark):
    z = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 3, 7))], "cell_id long, z array<double>")
    got = {r.cell_id: r.distance for r in similarity.knn_distance(z, z, 2).collect()}
    assert got == {0: 2.0, 1: 1.5, 2: 2.5, 3: 5.0}


def test_knn_beyond_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    z = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, z array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = [np.sort(np.delete(d[i], i))[:5].mean() for i in range(60)]
    for limit in (10**6, 40):
        monkeypatch.setattr(similarity, "BROADCAST_VALUES", limit)
        got = {r.cell_id: r.distance for r in similarity.knn_distance(z, z, 5).collect()}
        assert np.allclose([got[i] for i in range(60)], want)


def test_contracts(spark):
    grid = spark.createDataFrame([(0, 0, 0, 1.0, 2.0), (0, 0, 1, float("nan"), 2.0), (-1, 0, 0, 1.0, None)], "cell_id long, row long, col long, x double, y double")
    found = contracts.problems(grid, contracts.CONTRACTS["grid"])
    assert any("cell_id >= 0" in p for p in found) and any("not finite" in p for p in found) and any("y is null" in p for p in found) and any("not unique" in p for p in found)
    with pytest.raises(contracts.ContractError):
        contracts.model_inputs(["ring250_built", "frac_built"])
    a = spark.createDataFrame([(1, 2), (1, 3)], "cell_id long, v int")
    with pytest.raises(Exception, match="not unique"):
        contracts.one_to_one(a, a.limit(1), ["cell_id"]).collect()


def test_config(tmp_path):
    assert Config().but(cell=50.0).cell == 50.0
    with pytest.raises(ConfigError):
        Config(cell=15.0)
    (tmp_path / "c.yaml").write_text("cell: 200\n")
    from terralith.config import load

    pytest.importorskip("yaml")
    assert load(str(tmp_path / "c.yaml")).cell == 200
    (tmp_path / "c.yaml").write_text("sell: 200\n")
    with pytest.raises(ConfigError):
        load(str(tmp_path / "c.yaml"))


def test_tiff_round_trip(spark, tmp_path):
    a = (np.arange(12).reshape(3, 4) * 1.5).astype("f4")
    (tmp_path / "a.tif").write_bytes(files.tiff(a))
    assert np.array_equal(files.tiff_array(files.tiff(a)), a)
    got = files.raster(spark, str(tmp_path / "a.tif"), nodata=3.0).orderBy("pixel_row", "pixel_col").collect()
    assert [r.value for r in got] == [None if v == 3.0 else v for v in a.ravel().tolist()]


def test_geojson_layer(spark, tmp_path):
    def doc(*f):
        return json.dumps({"type": "FeatureCollection", "features": [{"id": i, "properties": p, "geometry": {"type": t, "coordinates": c}} for i, p, t, c in f]})

    (tmp_path / "a.geojson").write_text(doc(("1", {"highway": "primary"}, "LineString", [[0, 0], [1, 1]]), ("2", {}, "Point", [0, 0])))
    (tmp_path / "b.geojson").write_text(doc(("1", {"highway": "again"}, "LineString", [[5, 5], [6, 6]]), ("3", {}, "Polygon", [[[0, 0], [2, 0], [2, 2], [0, 0]]])))
    f = files.layer(spark, {"a": str(tmp_path / "a.geojson"), "b": str(tmp_path / "b.geojson")}, ["highway"], ("LineString", "Polygon"))
    assert {(r.osm_id, r.highway) for r in f.collect()} == {("1", "primary"), ("3", None)}
    assert {(r.osm_id, r.seq, r.x, r.y) for r in files.vertices(f).collect()} >= {("1", 1, 1.0, 1.0), ("3", 1, 2.0, 0.0)}
    (tmp_path / "aoi.geojson").write_text(doc(("1", {}, "Polygon", [[[0, 0], [2, 0], [2, 2], [0, 0]]])))
    assert files.aoi(str(tmp_path / "aoi.geojson")) == [[(0, 0), (2, 0), (2, 2)]]
    with pytest.raises(contracts.ContractError):
        files.aoi(str(tmp_path / "b.geojson"))


def test_mosaic_checksums_and_retry(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, 7)], "pixel int, tile int, v int")
    assert files.mosaic(t, ["pixel"], "v", "tile").first().v == 5 and files.mosaic(t, ["pixel"], "v", "tile", first=False).first().v == 7
    (tmp_path / "x").write_bytes(b"abc")
    s = files.checksums(spark, str(tmp_path / "x"))
    m = s.withColumn("extent", F.lit("e"))
    assert files.stale(m, s, "e").count() == 0 and files.stale(m, s, "other").count() == 1
    calls, slept = [], []

    @files.retry(3, 2.0, sleep=slept.append)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert f() == "ok" and slept == [2.0, 4.0]


def test_sinks(spark):
    lat = lattice.grid(spark, 2, 3, 100.0)
    v = spark.createDataFrame([(0, 1.0), (5, 2.0)], "cell_id long, s double")
    rows = sinks.image_rows(lat, v, "s", -1)
    assert [r.cells for r in rows.orderBy("row").collect()] == [[1.0, -1.0, -1.0], [-1.0, -1.0, 2.0]]
    assert files.tiff_array(sinks.image_tiff(rows)).tolist() == [[1.0, -1.0, -1.0], [-1.0, -1.0, 2.0]]
    f = json.loads(lat.select(sinks.feature(F.col("x"), F.col("y"), 100.0, ["cell_id"])).first()[0])
    assert f["geometry"]["coordinates"][0][0] == [0.0, -100.0] and f["properties"] == {"cell_id": 0}
    assert sinks.strict_json({"a": float("nan"), "b": [1.0]}) == '{"a": null, "b": [1.0]}'
    assert sinks.leaves({"a": [1, {"b": 2}]}) == {"/a/0": 1, "/a/1/b": 2}


def test_pipeline_on_files_elsewhere(spark, tmp_path):
    """The town 20 km east and 30 km south, with a gap in its lattice and columns of the user's, gives what the town gives."""
    town = pipeline.Context(spark, str(tmp_path / "town"), n=20)
    pipeline.run(town, {"features", "labels"})
    paths = {t: str(tmp_path / f"{t}.parquet") for t in pipeline.INPUTS}
    far = {"x": 20000, "y": -30000, "x1": 20000, "x2": 20000, "y1": -30000, "y2": -30000}
    for t, path in paths.items():
        df = town.read(t)
        df.withColumns({k: F.col(k) + v for k, v in far.items() if k in df.columns}).withColumn("other", F.lit(1)).write.parquet(path)
    c = pipeline.Context(spark, str(tmp_path / "out"), files=paths)
    pipeline.run(c, {"features", "labels"})
    assert c.lattice() == (20, 20, 20000.0, -30000.0)
    a, b = (x.read("features").drop("x", "y").select(*[F.round(k, 6) if k not in ("cell_id", "yr") else F.col(k) for k in x.read("features").columns if k not in ("x", "y")]) for x in (town, c))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    gap = pipeline.Context(spark, str(tmp_path / "gap"), files=paths)
    spark.read.parquet(paths["cover"]).where("col < 15").write.parquet(f"{gap.folder}/cover")
    assert gap.lattice()[1] == 20
    with pytest.raises(ValueError, match="lacks yr"):
        pipeline.cover(pipeline.Context(spark, "", files=paths | {"cover": paths["roads"]}))
    with pytest.raises(ValueError, match="years"):
        pipeline.cover(pipeline.Context(spark, "", Config(years=Years(latest=2030)), files=paths))
    with pytest.raises(ValueError, match="no file"):
        pipeline.cover(pipeline.Context(spark, "", files={"cover": paths["cover"]}))


def test_pipeline_on_the_town(spark, tmp_path):
    c = pipeline.Context(spark, str(tmp_path), n=20)
    assert pipeline.run(c, dry=True) == {}
    assert set(pipeline.run(c)) == {s.name for s in pipeline.STAGES}
    auc = {r.model: r.auc for r in c.read("auc").collect()}
    assert auc["knn"] > 0.6 and auc["distance"] > 0.6
    contracts.validate(c.read("scores").where("model = 'knn'").select("cell_id", "score"), contracts.CONTRACTS["scores"])
    contracts.validate(c.read("clusters").select("cell_id", "cluster_id", "class_3"), contracts.CONTRACTS["classes"])
    town = c.read("cover").where("yr = 2023").join(c.read("clusters"), "cell_id")
    share = {r.class_3: r.b for r in town.groupBy("class_3").agg(F.avg("frac_built").alias("b")).collect()}
    assert share[1] > 0.5 > max(v for k, v in share.items() if k != 1) and town.count() == 400
    best = max(r.auc for r in c.read("weights").collect())
    both = c.read("combined").join(c.read("labels").where("candidate and not ambiguous").select("cell_id", "grew"), "cell_id")
    assert c.read("weights").count() == 11 and ranks.auc(both, "grew", "score").first().auc == pytest.approx(best, abs=1e-4)
    contracts.validate(c.read("labels").withColumn("lei_type", F.lit("none")), contracts.CONTRACTS["labels"])
    assert [s.name for s in pipeline.plan({"scores"})] == ["cover", "features", "labels", "scores"]
    assert [s.name for s in pipeline.plan({"auc"}, have={"scores", "labels"})] == ["validate"]
    assert pipeline.plan({"auc"}, have={"auc"}) == []
    with pytest.raises(ValueError, match="no stage"):
        pipeline.plan({"nothing"})
    t = synthetic.town(spark, 20, 2018)
    assert t.where("abs(frac_built + frac_water + frac_tree + frac_crop + frac_range + frac_bare - 1) > 1e-9").count() == 0
