import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralith.llm import bpe, mixing, toxicity

from .cases import SCHEMA
from .test_exact_dedup import brute as brute_exact
from .test_jaccard_join import brute as brute_near
from .test_toxicity import corpus


def test_stages_against_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    data = []
    for i, t, _ in corpus(160):
        data.append((i, t, "en", f"s{i % 3}", len(t), 0, "x"))
        if i % 5 == 0:
            data.append((1000 + i, t.replace(" ", "\n"), "en", "s0", len(t), 0, "x"))
        if i % 7 == 0:
            data.append((2000 + i, t + " more", "en", "s1", len(t) + 5, 0, "x"))
    data += [(5000, None, None, None, None, 0, None), (5001, "", None, "s1", 0, 0, None)]
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, k, int(i % 2)) for i, _, k in corpus(160)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    model = toxicity.train(docs, labels)
    rows = [r for r in data if float(toxicity.score(model, *toxicity._flat([(r[1] or "").encode()]))[0]) < 0.5]
    assert len(rows) < len(data)
    keep = {d for d, k, *_ in brute_exact(rows) if d == k}
    rows = [r for r in rows if r[0] in keep]
    keep = {d for d, _, c in brute_near(rows, 5, 80) if d == c}
    rows = [r for r in rows if r[0] in keep]
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(spark.createDataFrame(rows, SCHEMA), mixing.label_weights(spark, str(tmp_path))).collect()}
    tok, want = tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), []
    for r in rows:
        words = (r[1] or "").split()
        left = plan[r[0]]
        while left:
            text = r[1] if left >= len(words) else " ".join(words[:left])
            left -= min(left, len(words))
            ids = tok.encode(text, add_special_tokens=False).ids
            want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 1, "h"), (2, None, None, None, None, None, None)], SCHEMA)
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
