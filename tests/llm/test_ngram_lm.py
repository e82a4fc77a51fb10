import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terralith.llm import ngram_lm as lm

from .cases import SCHEMA, look_alikes, rows, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def held(d):
    return (zlib.crc32(str(d).encode()) if d is not None else 0) % 7 == 2


class Brute:
    """The same model from the definition, with dictionaries and exact recursion."""

    def __init__(self, texts, order):
        self.order = order
        c, v = Counter(), set()
        for t in texts:
            v.update([*words(t), "end"])
            s = ["start"] * (order - 1) + [*words(t), "end"]
            c.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
        self.vocabulary = v
        self.counts = {order: c}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {k: lm.discounts_of([sum(n == i for n in v.values()) for i in (1, 2, 3, 4)]) for k, v in self.counts.items()}
        self.by = {k: defaultdict(list) for k in self.counts}
        for k, v in self.counts.items():
            for g, n in v.items():
                self.by[k][g[:-1]].append(n)

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (len(self.vocabulary) + 1)
        seen = self.by[k].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        take = lambda n: self.d[k][min(n, 3) - 1]
        n = self.counts[k].get(g, 0)
        return ((n - take(n) if n else 0) + sum(map(take, seen)) * self.p(g[1:])) / sum(seen)

    def score(self, text):
        s = ["start"] * (self.order - 1) + [*words(text), "end"]
        return sum(math.log10(self.p(tuple(s[i : i + self.order]))) for i in range(len(s) - self.order + 1))


def compare(got, data, order):
    train = [r[1] for r in data if not held(r[0])]
    brute, c = Brute(train, order), Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(words(r[1])) + 1, sum(c[w] > 0 for w in [*words(r[1]), None]), n) for r in data)
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == want
    text = {r[0]: r[1] for r in data}
    for r in got:
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(text[r.doc_id]), None]), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, brute.score(text[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(spark, order):
    compare(lm.scores(table(spark), lm.train(table(spark), order)).collect(), rows(), order)
    compare(lm.scored(table(spark), order).collect(), rows(), order)


@pytest.mark.parametrize("order", [2, 3])
def test_slices_and_shards_change_nothing(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 2000)
    small = table(spark).repartition(9)
    compare(lm.scored(small, order).collect(), rows(), order)


def test_words_that_weak_hashes_confuse(spark):
    data = look_alikes()
    assert any(held(r[0]) for r in data)
    df = spark.createDataFrame(data, SCHEMA)
    compare(lm.scored(df).collect(), data, 2)


def test_a_model_scores_another_table(spark):
    model = lm.train(table(spark))
    other = spark.createDataFrame([(1, "alpha the zebra"), (2, None), (3, "the the of")], "doc_id long, text string")
    brute = Brute([r[1] for r in rows() if not held(r[0])], 2)
    for r in lm.scores(other, model).collect():
        assert math.isclose(r.score, brute.score({1: "alpha the zebra", 2: None, 3: "the the of"}[r.doc_id]), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute([r[1] for r in rows()], 2)
    for context in ("start", b"the", b"never seen"):
        known = sum(brute.p((context, w)) for w in brute.vocabulary)
        assert math.isclose(known + brute.p((context, b"unknown")), 1, rel_tol=1e-9)


def test_held_out_texts_gain_by_context(spark):
    r = np.random.default_rng(1)
    after = {i: r.integers(0, 60, 3).tolist() for i in range(60)}
    data = []
    for i in range(150):
        w = [int(r.integers(0, 60))]
        for _ in range(60):
            w.append(after[w[-1]][int(r.integers(0, 3))])
        data.append((i, " ".join(f"w{x}" for x in w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [x for x in lm.scores(df, lm.train(df)).collect() if x.held_out]
    assert sum(x.score for x in got) > 0.5 * sum(x.base_score for x in got)


def test_a_table_lies_in_a_mapped_file():
    arrays = lm.mapped([np.arange(5, dtype="<u8"), np.zeros(0, "<i8"), np.arange(3, dtype="<i8")])
    assert isinstance(arrays[0], np.memmap) and isinstance(arrays[2], np.memmap)
    assert [a.tolist() for a in arrays] == [[0, 1, 2, 3, 4], [], [0, 1, 2]]
    assert lm.found(arrays[0], np.arange(5) * 2, np.array([4, 9, 0], np.uint64)).tolist() == [8, 0, 0]


def test_orders_below_two_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        lm.train(table(spark), 1)


def test_empty_table_and_no_training_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.scores(empty, lm.train(empty)).count() == 0
    only = next(i for i in range(100) if held(i))
    one = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    got = lm.scores(one, lm.train(one)).collect()
    assert got == lm.scored(one).collect() and lm.scored(empty).count() == 0
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
