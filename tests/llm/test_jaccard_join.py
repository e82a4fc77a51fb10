import random

import numpy as np
import pytest

from terralith.llm import jaccard_join as jj

from .cases import SCHEMA, clashing, look_alikes, rows, table, unchanged

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(data, n, percent):
    sets = [shingles(r[1], n) for r in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if data[i][0] is None or data[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if data[i][0] == data[j][0] or 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[root(i)]) for i, r in enumerate(data)), key=str)


def variants(seed, n=150):
    """Groups of near copies at all distances round the thresholds, of all lengths."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocab) for _ in range(k)] for k in (3, 4, 6, 9, 12, 20, 33, 60, 90, 140, 200, 400)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(int(len(w) * r.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]) + r.choice([0, 0, 1]))):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice(vocab)], [w[k], r.choice(vocab)]])
        out.append((i, " ".join(w), "", "", 0, 0, ""))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_odd_rows(spark, n, percent):
    got = jj.classes(table(spark), n, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows(), n, percent)


@pytest.mark.parametrize(("n", "percent", "seed", "block"), [(3, 90, 1, jj.BLOCK), (5, 80, 2, jj.BLOCK), (1, 80, 3, 500)])
def test_variants(spark, n, percent, seed, block, monkeypatch):
    data = variants(seed)
    monkeypatch.setattr(jj, "SLICE", 4000)
    got = jj.classes(spark.createDataFrame(data, SCHEMA).repartition(4), n, percent, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data, n, percent)


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 4), (5, 80, 5), (1, 80, 6)])
def test_frequent_shingles_change_nothing(spark, n, percent, seed, monkeypatch):
    monkeypatch.setattr(jj, "SLICE", 4000)
    monkeypatch.setattr(jj, "FREQUENT_LEAST", 4)
    data = variants(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    data = [(i, f"{t} {passage}" if i % 3 == 0 else passage if i % 29 == 1 else t, *r) for i, t, *r in data]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert len(jj.frequent(df, n, len(data))) > 30
    assert sorted((tuple(r) for r in jj.classes(df, n, percent).collect()), key=str) == brute(data, n, percent)


@pytest.mark.parametrize("seed", range(6))
def test_traversal_finds_every_component(seed, monkeypatch):
    monkeypatch.setattr(jj.Tree, "LEAF", 3)
    monkeypatch.setattr(jj.Tree, "FAN", 2)
    r = np.random.default_rng(seed)
    base = [r.integers(0, 1 << 62, size=60, dtype=np.int64).astype(np.uint64) for _ in range(4)]
    sets = []
    for _ in range(70):
        b = base[r.integers(0, 4)]
        keep = r.random(60) > r.choice([0, 0.03, 0.08, 0.2])
        sets.append(np.unique(np.concatenate([b[keep], r.integers(0, 1 << 62, size=r.integers(0, 6), dtype=np.int64).astype(np.uint64)])))
    for sides in (None, r.integers(0, 2, size=70)):
        for percent in (80, 90):
            want, got = jj.Forest(), jj.Forest()
            for i in range(70):
                for j in range(i):
                    if (sides is None or sides[i] != sides[j]) and jj.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), percent):
                        want.join(i, j)
            for i, j in jj.span_links(sets, sides, percent):
                assert jj.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), percent)
                got.join(i, j)
            assert [want.root(i) for i in range(70)] == [got.root(i) for i in range(70)]


def test_representatives_and_empty_table(spark):
    docs = table(spark)
    got = jj.representatives(docs)
    assert got.columns == docs.columns
    keep = {d for d, _, c in brute(rows(), 5, 80) if d == c}
    assert {r.doc_id for r in got.collect()} == keep | {None}
    assert jj.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_that_weak_hashes_confuse(spark):
    got = jj.classes(spark.createDataFrame(look_alikes(), SCHEMA), 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(look_alikes(), 3, 90)
    assert all(r.component_id == r.doc_id for r in got.collect())


def test_clashing_columns_are_kept(spark):
    docs = clashing(spark)
    got = jj.representatives(docs)
    assert got.columns == docs.columns and unchanged(got)
    assert got.count() == jj.representatives(table(spark)).count()


def test_large_trees_are_cut_where_no_link_can_run(spark):
    """Long documents of different texts that share a few sentences are one tree by their single ranges, but need not meet."""
    lines = [[f"s{i}x{k}" for k in range(9)] for i in range(60)]
    data = []
    for i in range(60):
        w = [f"d{i // 2}x{k}" if k % 150 or i % 2 == 0 else f"e{i}x{k}" for k in range(900)]
        chosen = random.Random(i // 2).sample(range(60), 8)
        for j in chosen:
            w += lines[j]
        data.append((i, " ".join(w), "", "", 0, 0, ""))
    df = spark.createDataFrame(data, SCHEMA)
    sets = [shingles(d[1], 5) for d in data]
    some = {(x.a, x.b) for x in jj.strong_ties(df, 5, 80, np.zeros(0, np.uint64), jj.listed(df)).collect()}
    before = jj.connected_components(jj.ties(df, 5, 80, np.zeros(0, np.uint64)))
    assert before.select("component").distinct().count() < 15
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(links) == 30 and links <= some
    tree = spark.createDataFrame([(i, len(s), 0) for i, s in enumerate(sets)], "doc_id long, n long, tree long")
    cut = {x.doc_id: x.tree for x in jj.refined(df, tree, 5, 80, 2500).collect()}
    assert all(cut[i] == cut[j] for i, j in links) and len(set(cut.values())) > 20
    got = jj.classes(df, 5, 80, 2500)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(data, 5, 80)


def test_forests_are_not_grown_in_tasks_that_compare_texts(spark, monkeypatch):
    plans = []

    def looked_at(edges, *options):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, *options)

    components = jj.connected_components
    monkeypatch.setattr(jj, "connected_components", looked_at)
    jj.classes(table(spark)).collect()
    assert plans and "MapInArrow" not in plans[-1]
