import random
import zlib

import numpy as np
import pytest

from terralith.llm import toxicity as tx

from .cases import SCHEMA, clashing, rows, table, unchanged


def corpus(n=600, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["an", "ti", "re", "so", "lu", "me"]) for _ in range(r.randrange(1, 5))) for _ in range(300)]
    bad = ["dreadfulling", "abominator", "wretchedest"]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(20, 200))]
        toxic = i % 4 == 0
        for _ in range(r.randrange(2, 6) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad)
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in data] + [(3, None), (None, 1)], "doc_id long, toxic int")
    return tx.train(docs, labels)


def test_held_out_accuracy(spark, model):
    data = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    got = {r.doc_id: r for r in tx.scores(docs, model).collect()}
    held = [(got[i], k) for i, _, k in data if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    assert len(held) > 60 and np.mean([r.predicted == k for r, k in held]) > 0.95
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    data = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flip = lambda i, k: 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k
    a = tx.train(docs, spark.createDataFrame([(i, k) for i, _, k in data], "doc_id long, toxic int"))
    b = tx.train(docs, spark.createDataFrame([(i, flip(i, k)) for i, _, k in data], "doc_id long, toxic int"))
    assert a.toxic == b.toxic and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark, model):
    docs = table(spark)
    got = tx.scores(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    kept = tx.reject(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in got)


def test_slices_do_not_change_scores(spark, model, monkeypatch):
    from terralith.llm.text import flat
    import pyarrow as pa

    texts = [t for _, t, _ in corpus(50)]
    one = tx.score(model, *flat(pa.array(texts)))
    each = np.concatenate([tx.score(model, *flat(pa.array([t]))) for t in texts])
    assert np.allclose(one, each)


def test_no_labels_and_empty_table(spark):
    docs = table(spark)
    none = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.scores(docs, none).collect()} == {0.0}
    assert tx.scores(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_words_of_a_copied_text_are_no_marks():
    data = corpus(400)
    toxic, ordinary = [t.encode() for _, t, k in data if k], [t.encode() for _, t, k in data if not k]
    copied = b"plain harmless unusual wording here " + ordinary[0]
    model = tx.fit(toxic + [copied + b" %d" % i for i in range(300)], ordinary)
    assert b"harmless unusual" not in model.toxic and b"abominat" in model.toxic
    assert len(tx.distinct([copied, copied, ordinary[1], b"", copied + b" x"])) == 2


def test_score_is_calibrated_to_labelled_shares():
    data = corpus(400)
    toxic, ordinary = [t.encode() for _, t, k in data if k], [t.encode() for _, t, k in data if not k]
    a, b = (tx.fit(toxic, ordinary, labelled=n) for n in ((100, 300), (10, 300)))
    assert np.isclose(b.weights[0] - a.weights[0], np.log(0.1))


def test_the_sample_is_bounded_by_bytes_of_whole_texts(spark):
    docs = spark.createDataFrame([(i, "x " * (50 if i % 10 else 5000)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    toxic, ordinary, labelled = tx.sample(docs, labels, most=12_000)
    assert all(sum(map(len, side)) <= 12_000 and {len(t) for t in side} <= {100, 10_000} for side in (toxic, ordinary))
    assert labelled == tuple(sum(zlib.crc32(str(i).encode()) % 5 != 0 and i % 2 == k for i in range(100)) for k in (1, 0))


def test_classes_differ_without_any_telling_words():
    """No word is rarer in one class than twice as in the other: the order of words alone tells them apart."""
    r = random.Random(5)
    vocab = ["".join(r.choice(["an", "ti", "re", "so", "lu", "me"]) for _ in range(2)) for _ in range(40)]
    bad = [" ".join(r.sample(vocab, 4)) for _ in range(3)]
    toxic, ordinary = [], []
    for i in range(500):
        words = [r.choice(vocab) for _ in range(60)]
        for _ in range(4):
            at, phrase = r.randrange(len(words)), r.choice(bad).split()
            if i % 2:
                r.shuffle(phrase)
            words[at:at] = phrase
        (ordinary if i % 2 else toxic).append(" ".join(words).encode())
    model = tx.fit(toxic[:200], ordinary[:200])
    got = [tx.score(model, *tx._flat(side[200:])) for side in (toxic, ordinary)]
    assert np.mean(got[0][:, None] > got[1][None, :]) > 0.6


def test_clashing_columns_are_kept(spark, model):
    docs = clashing(spark)
    got = tx.reject(docs, model)
    assert got.columns == docs.columns and unchanged(got)
