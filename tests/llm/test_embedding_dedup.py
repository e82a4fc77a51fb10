import math

import numpy as np
import pytest

from terralith.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, links int"


def data(n=160, dim=6, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    out = []
    for i in range(n):
        v = (centres[i % 8] + r.normal(size=dim) * r.choice([0, 0.05, 0.2, 1])).astype(np.float32)
        out.append((i, [float(x) for x in v * r.choice([1, 1, 3e-4, 2e5])], int(r.integers(0, 3)), "x", 1))
    out += [(1000, None, 1, "", 0), (1001, [0.0] * dim, 1, "", 0), (1002, [math.nan] + [1.0] * (dim - 1), 1, "", 0), (1003, [None] + [1.0] * (dim - 1), 1, "", 0), (1004, [math.inf] * dim, 1, "", 0)]
    out += [(1005, out[0][1], None, "", 0), (1006, out[0][1][:-1], out[0][2], "", 0), (1007, [], 1, "", 0), (None, out[0][1], out[0][2], "", 0)]
    out += [(2000 + i, out[3][1], out[3][2], "", 0) for i in range(5)] + [out[7], out[9]]
    return out


def brute(rows, threshold):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    out = []
    for i, r in enumerate(rows):
        c = None if r[0] is None else least[root(i)]
        out.append((r[0], links[i], c, r[0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize(("tile", "threshold"), [(2048, 0.98), (7, 0.98), (16, 0.8)])
def test_brute_force(spark, tile, threshold):
    rows = data()
    got = ed.near(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, tile, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, threshold)


@pytest.mark.parametrize("room", [1 << 20, 8 * 7 * 3, 1])
def test_the_number_of_pivots_changes_no_result(spark, monkeypatch, room):
    monkeypatch.setattr(ed, "PIVOT_BYTES", room)
    rows = data()
    got = ed.near(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.9, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 0.9)


def test_pivots_follow_the_vectors_within_their_bytes(spark, monkeypatch):
    reps = spark.range(500).selectExpr("id as rep", "array(cast(id + 1 as float), 1f) as vec", "2 as dim")
    assert len(ed._pivots(reps, 40)[2]) == 40
    monkeypatch.setattr(ed, "PIVOT_BYTES", 160)
    assert len(ed._pivots(reps, 40)[2]) == 10


def test_bounds_hold():
    r = np.random.default_rng(0)
    x, y = ed.unit(r.normal(size=(300, 64))), ed.unit(r.normal(size=(300, 64)) ** 5)
    (qx, sx, ex), (qy, sy, ey) = ed.quantise(x), ed.quantise(y)
    near = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy
    assert (np.abs(x @ y.T - near) <= ex[:, None] + ey + ex[:, None] * ey).all()


def test_empty_table(spark):
    assert ed.near(spark.createDataFrame([], SCHEMA)).count() == 0
