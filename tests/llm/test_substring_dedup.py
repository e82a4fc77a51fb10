import hashlib
import random

import numpy as np
import pytest

from terralith.llm import substring_dedup as sd

from .cases import SCHEMA, alternating, look_alikes, rows, table


def brute(data, k):
    first = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in data]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), kept.decode()))
    return sorted(out, key=str)


def passages(seed, n=120):
    """Documents that share passages in several orders, overlap, and repeat within themselves."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    pool = [[r.choice(vocab) for _ in range(r.choice([3, 8, 13, 14, 20, 60]))] for _ in range(12)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts += r.choice([p, p[a:], [r.choice(vocab)] * r.randrange(30), [r.choice(vocab) for _ in range(9)]])
        out.append((r.randrange(n * 2), " ".join(parts), "en", "s", 0, 0, ""))
    return out


@pytest.mark.parametrize("k", [3, 13])
def test_brute_force(spark, k):
    got = sd.deduplicate(table(spark), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows(), k)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, monkeypatch):
    data = passages(seed)
    monkeypatch.setattr(sd, "SLICE", 1500)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in sd.deduplicate(df).collect()), key=str) == brute(data, 13)


def test_short_fingerprints_are_noticed_and_repeated(spark, monkeypatch):
    widths = []
    monkeypatch.setattr(sd, "fingerprint_bytes", lambda *a: 1)
    real = sd.edges
    monkeypatch.setattr(sd, "edges", lambda docs, k, b, g, width, seed: widths.append(width) or real(docs, k, b, g, width, seed))
    assert sorted((tuple(r) for r in sd.deduplicate(table(spark)).collect()), key=str) == brute(rows(), 13)
    assert widths[:2] == [1, 5]


def test_wide_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(sd, "fingerprint_bytes", lambda *a: 11)
    data = passages(5)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in sd.deduplicate(df).collect()), key=str) == brute(data, 13)


def test_digest_and_empty_table(spark):
    want = {(d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in brute(rows(), 13)}
    assert {(r.doc_id, r.kept) for r in sd.deduplicate(table(spark), digest=True).collect()} == want
    assert sd.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_that_weak_hashes_confuse(spark):
    got = sd.deduplicate(spark.createDataFrame(look_alikes(), SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(look_alikes(), 13)
    assert all(r.n_removed == 0 for r in got.collect())


def test_spans_are_compared_by_their_bytes():
    a, b = (sd.span_digests([alternating(1024, swap).encode(), b"x", b"y z"[:1]], np.array([0, 1]), np.array([3, 2])) for swap in (False, True))
    assert (a[0][0], a[1][0]) != (b[0][0], b[1][0]) and (a[0][1], a[1][1]) == (b[0][1], b[1][1])
    joined = hashlib.blake2b(b"x y", digest_size=16).digest()
    assert (int(a[0][1]), int(a[1][1])) == tuple(int.from_bytes(joined[i : i + 8], "little", signed=True) for i in (0, 8))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffles_go_when_their_work_is_done(spark, monkeypatch, adaptive):
    """Also while somebody refers to their plans, so that no garbage collector can help."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held, seen = [], []

    def files():
        every = manager.getAllFiles()
        names = [every.apply(i).getName() for i in range(every.length())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    def watched(name):
        real = getattr(sd, name)

        def call(*a):
            seen.append((name, files()))
            held.append(real(*a))
            return held[-1]

        monkeypatch.setattr(sd, name, call)

    for name in ("edges", "resolve", "removal", "failures"):
        watched(name)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = sd.deduplicate(table(spark))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows(), 13)
        assert [name for name, _ in seen] == ["edges", "resolve", "removal", "failures"]
        assert seen[2][1] <= seen[0][1] and seen[3][1] <= seen[0][1]
        assert sorted((r.doc_id, r.n_words) for r in held[2].where("kind = 0 and doc_id is not null").collect()) == sorted((r[0], r[1]) for r in brute(rows(), 13) if r[0] is not None)  # made again
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
