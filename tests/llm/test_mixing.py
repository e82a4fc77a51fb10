import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terralith.llm import mixing

from .cases import SCHEMA, clashing, rows, table, unchanged


def brute_targets(sizes, weights, share, most):
    """Shares again and again what lies above a cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, budget = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if budget * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: budget * w[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        budget -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_plan(spark, bucket_rows):
    quality = spark.range(0, 30).select(F.col("id").alias("doc_id"), (F.col("id") % 3 + 0.5).alias("weight"))
    got = mixing.plan_mix(table(spark), quality, bucket_rows=bucket_rows).collect()
    sizes, n = defaultdict(int), {}
    for r in rows():
        n[r[0]] = len((r[1] or "").encode().split())
        sizes[r[3]] += n[r[0]]
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.MAX_EPOCHS)
    taken = defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        assert (r["size"], r.source_size) == (n[r.doc_id], sizes[r.source])
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_and_buckets_agree(spark):
    a = sorted(map(str, mixing.plan_mix(table(spark), bucket_rows=2).collect()))
    b = sorted(map(str, mixing.plan_mix(table(spark).repartition(7)).collect()))
    assert a == b


def test_keys_favour_quality(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    quality = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.plan_mix(docs, quality, share=0.5).groupBy((F.col("doc_id") < 1000).alias("good")).agg(F.sum("taken").alias("t"))
    t = {r.good: r.t for r in got.collect()}
    assert t[True] > 1.8 * t[False]


def test_mix_emits_what_the_plan_takes(spark):
    docs = table(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = {r.source: r.t for r in mixing.plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect() if r.t}
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert dict(words) == plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = clashing(spark)
    got = mixing.mix(docs)
    assert got.columns == docs.columns and unchanged(got)
    plain = sorted((str(r.doc_id), r.text) for r in mixing.mix(table(spark)).collect())
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == plain


def test_many_sources_go_without_a_broadcast(spark, monkeypatch):
    want = sorted(map(str, mixing.plan_mix(table(spark)).collect()))
    monkeypatch.setattr(mixing, "small", lambda df: df)
    assert sorted(map(str, mixing.plan_mix(table(spark)).collect())) == want
