import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.config import ConfigError, load
from terralith.functions import ranks
from terralith.operators import geometry, labels, lattice, present, suitability, vector, warp
from terralith.sources import files, sinks


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_quantiles_and_curves_against_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), int(i % 3), float(np.round(r.normal(), 1)), bool(r.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame([*rows, (999, 0, None, False)], "cell_id long, g int, v double, y boolean").repartition(5)
    got = {(x.g, x.share): x.quantile for x in ranks.quantiles(df, "v", [0.0, 0.37, 0.99, 1.0], ["g"]).collect()}
    for g in range(3):
        for q in (0.0, 0.37, 0.99, 1.0):
            assert math.isclose(got[g, q], np.quantile([x[2] for x in rows if x[1] == g], q), abs_tol=1e-12)
    known = df.where("v is not null")
    curve = {x.point: (x.flagged, x.hit_share) for x in ranks.toc_curve(known, "y", "v").collect()}
    order = sorted(rows, key=lambda x: (-x[2], x[0]))
    for p in range(101):
        n = round(p * 400 / 100)
        assert curve[p] == (round(n / 400, 4), round(sum(x[3] for x in order[:n]) / sum(x[3] for x in rows), 4))
    few = spark.createDataFrame([(i, float(-i), i in (0, 3)) for i in range(7)], "cell_id long, v double, y boolean")
    assert {x.point: x.hit_share for x in ranks.toc_curve(few, "y", "v").collect()}[100] == 1.0
    assert [tuple(x) for x in ranks.perfect_line(few, "y").orderBy("corner").collect()] == [(0, 0.0, 0.0), (1, 2 / 7, 1.0), (2, 1.0, 1.0)]


def test_rings_are_cut_repaired_and_traced(spark):
    df = spark.createDataFrame([(1, ring((-1, -1), (3, -1), (3, 3), (-1, 3))), (2, ring((5, 5), (6, 5), (6, 6))), (3, []), (4, None), (5, ring((0, 0), (4, 0), (0, 4)))], f"id long, ring {geometry.POINTS}")
    box = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    got = {r.id: r.a for r in geometry.cut(df, *box).select("id", vector.shoelace(F.col("ring")).alias("a")).collect()}
    assert got == {1: 4.0, 5: 4.0}
    crossed = spark.createDataFrame([(1, ring((0, 0), (2, 2), (2, 0), (0, 2))), (2, ring((0, 0), (1, 0), (2, 0))), (3, ring((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))), (4, None)], f"id long, ring {geometry.POINTS}")
    parts = geometry.valid(crossed).select("id", "part", vector.shoelace(F.col("ring")).alias("a")).collect()
    assert sorted(tuple(r) for r in parts) == [(1, 0, 1.0), (1, 1, 1.0), (3, 0, 1.0)]
    # A frame of cells with a hole, and two cells that touch at a corner.
    frame = [(0, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(1, 0, 5), (1, 1, 6)]
    rings = geometry.outlines(geometry.directed_sides(spark.createDataFrame(frame, "patch long, row long, col long"))).collect()

    def area(p):
        return sum(p[i - 1].x * p[i].y - p[i].x * p[i - 1].y for i in range(len(p))) / 2

    assert sorted((r.patch, len(r.ring), area(r.ring)) for r in rings) == [(0, 4, -1.0), (0, 4, 9.0), (1, 4, 1.0), (1, 4, 1.0)]


def test_a_raster_in_degrees_shows_the_nearest_cells(spark):
    source = lattice.grid(spark, 20, 30, 100.0).select("row", "col", F.col("cell_id").cast("double").alias("v"))
    corner = spark.range(1).select(F.lit(700_000.0).alias("x"), F.lit(2_000_000.0).alias("y"))
    lon, lat = warp.projected(corner, 32643, warp.DEGREES).first()
    target = warp.points(spark, lon - 0.002, lat + 0.002, 0.001, 25, 35)
    got = {r.pixel_id: r.v for r in warp.warp(target, source, "v", 100.0, 700_000.0, 2_000_000.0, warp.DEGREES, 32643).collect()}
    there = {r.pixel_id: (r.x, r.y) for r in warp.projected(target, warp.DEGREES, 32643).collect()}
    for k, (x, y) in there.items():
        c, r = math.floor((x - 700_000) / 100), math.floor((2_000_000 - y) / 100)
        assert got[k] == (r * 30 + c if 0 <= r < 20 and 0 <= c < 30 else None)
    assert len({v for v in got.values() if v is not None}) > 400
    with pytest.raises(ValueError, match="UTM"):
        warp.project(F.lit(0.0), F.lit(0.0), 3857, warp.DEGREES)


def test_geopackage_csv_and_metrics(spark, tmp_path):
    cells = lattice.grid(spark, 2, 2, 100.0).withColumn("name", F.concat(F.lit("c'"), F.col("cell_id").cast("string")))
    (tmp_path / "a.gpkg").write_bytes(sinks.geopackage(cells, "cells", 100.0, 32643, ["cell_id", "name"]))
    got = files.geopackage(spark, str(tmp_path / "a.gpkg"), "cells", ["cell_id", "name"]).orderBy("fid").collect()
    assert [(r.cell_id, r.name, r.kind) for r in got] == [(str(i), f"c'{i}", "Polygon") for i in range(4)]
    assert got[0].coordinates == "[[[0.0, -100.0], [100.0, -100.0], [100.0, 0.0], [0.0, 0.0], [0.0, -100.0]]]"
    assert files.geopackage(spark, str(tmp_path / "a.gpkg"), "cells", ["name"], geometry=False).columns == ["fid", "name"]
    sinks.write_csv(cells.select("cell_id", "name"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.csv(spark, str(tmp_path / "csv")).collect())) == [(i, f"c'{i}") for i in range(4)]
    for run, k in (("a", 1), ("b", 2), ("a", 3)):
        sinks.write_metrics(spark.createDataFrame([("auc", float(k))], "name string, value double"), str(tmp_path / "m"), run)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).select("run", "value").collect())) == [("a", 3.0), ("b", 2.0)]


def test_wkb_kinds():
    import struct

    def p(x, y):
        return struct.pack("<BIdd", 1, 1, x, y)

    assert files.wkb(p(1, 2))[:2] == ("Point", [1.0, 2.0])
    assert files.wkb(struct.pack("<BII", 1, 4, 2) + p(1, 2) + p(3, 4))[:2] == ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]])
    assert files.wkb(struct.pack(">BII", 0, 1002, 2) + struct.pack(">6d", 1, 2, 9, 3, 4, 9))[:2] == ("LineString", [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(ValueError):
        files.wkb(struct.pack("<BI", 1, 7))


def test_mirrors():
    def fails():
        raise OSError("down")

    calls = []
    assert files.first_answer([fails, lambda: calls.append(1) or [7]]) == [7] and calls == [1]
    assert files.first_answer([lambda: [], lambda: []]) == []
    assert files.first_answer([lambda: [], lambda: [5]]) == [5]
    with pytest.raises(OSError, match="no mirror"):
        files.first_answer([lambda: [], fails])


def test_a_file_with_sections(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(
        "project: {name: x, random_seed: 7}\ngrid: {cell_size_m: 200}\nyears: {baseline: 2018, baseline_confirm: 2019, change_train_end: [2020, 2021], latest: 2023, latest_confirm: 2022}\n"
        "clustering: {k_min: 4, k_max: 6, k: 5}\nrf: {param_grid: {min_samples_leaf: [1, 9], max_features: [sqrt, 0.5]}}\npaths: {logs: logs}\nvector: {building_min_area_m2: 5, building_max_area_m2: 50}\n"
    )
    c = load(str(tmp_path / "c.yaml"))
    assert (c.seed, c.cell, c.k, c.k_range, c.leaf_sizes, c.feature_shares, c.building_area, c.years.train_end, c.years.confirm) == (7, 200, 5, (4, 5, 6), (1, 9), ("sqrt", "0.5"), (5.0, 50.0), (2020, 2021), 2019)
    (tmp_path / "d.yaml").write_text("cel: 5\n")
    with pytest.raises(ConfigError, match="cel"):
        load(str(tmp_path / "d.yaml"))


def test_names_units_and_codes(spark):
    df = spark.createDataFrame([("ring500_tree",), ("slope_mean",), ("other",)], "c string")
    assert [r[0] for r in df.select(present.readable(F.col("c"))).collect()] == ["tree share within 500 m", "slope (mean)", "other"]
    flags = spark.createDataFrame([(True, True, False, False, False), (False, False, True, True, False), (False, False, False, True, True), (False, False, False, True, False)], "e boolean, b boolean, g boolean, c boolean, a boolean")
    assert [r[0] for r in flags.select(present.label_code(*map(F.col, "ebgca"))).collect()] == [255, 4, None, 3]
    ids = labels.id_sets(spark.range(0, 5).toDF("cell_id"), spark.range(3, 8).toDF("cell_id"), spark.range(4, 6).toDF("cell_id"))
    assert {r.cell_id: r.kind for r in ids.collect()} == {0: "first", 1: "first", 2: "first", 3: "both", 6: "second", 7: "second"}


def test_priorities_of_any_size():
    for n in (1, 2, 8, 10):
        w, growth, ratio = suitability.priorities(np.ones((n, n)))
        assert np.allclose(w, 1 / n) and math.isclose(growth, n) and math.isclose(ratio, 0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        suitability.priorities(np.ones((11, 11)))


def test_overlap_sends_no_cells_to_every_task(spark):
    cells = spark.range(400).selectExpr("id % 20 * 10 + 5D as x", "id div 20 * 10 + 5D as y", "id % 3 as patch")
    squares = spark.range(30).selectExpr("array(struct(id * 5D as x, id * 3D as y), struct(id * 5D + 17 as x, id * 3D as y), struct(id * 5D + 17 as x, id * 3D + 17 as y), struct(id * 5D as x, id * 3D + 17 as y)) as ring")
    out = geometry.overlap_by(cells, squares, 10.0, "patch")
    want = {}
    for c in cells.collect():
        for i in range(30):
            w, h = (max(0.0, min(lo + 17, at + 5) - max(lo, at - 5)) for lo, at in ((i * 5.0, c.x), (i * 3.0, c.y)))
            want[c.patch] = want.get(c.patch, 0.0) + w * h
    assert {r.patch: round(r.area, 6) for r in out.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
