import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings

from terralith.llm import text as tx

from .cases import alternating


def hashes(words, **options):
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = tx.word_bounds(data, np.array([0, len(data)]))
    assert len(starts) == len(words)
    return tx.word_hashes(data, starts, ends, **options).tolist()


@pytest.mark.parametrize("n", [2, 16, 64, 128, 1024, 2048, 4096])
@pytest.mark.parametrize("seed", [1, 5, 9])
def test_alternating_words_differ(n, seed):
    a, b = hashes([alternating(n).encode(), alternating(n, True).encode()], seed=seed)
    assert a != b


@given(st.lists(st.text("ab\0é\U0001f600", min_size=1, max_size=90), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_a_hash_depends_on_the_bytes_alone(words):
    words = [w.encode() for w in words]
    got = hashes(words)
    assert len(set(got)) == len(set(words))
    assert got == [hashes([w])[0] for w in words]
    assert hashes(words, seed=2) != got


def test_lower_case():
    assert hashes([b"ABCz"], lower=True) == hashes([b"abcz"]) != hashes([b"ABCz"])


def test_windows_of_swapped_words_differ():
    w = np.array(hashes([b"a", b"b"]), np.uint64)
    pattern = np.array([int(c) for c in "0110100110010110"])
    a, b = tx.window_hashes(w[pattern], 16), tx.window_hashes(w[1 - pattern], 16)
    assert a[0] != b[0]


def test_a_slice_does_not_hold_its_batch():
    texts = [None, "", "é" * 900, "x" * 3000] * 1000
    before = pa.total_allocated_bytes()
    got = []
    for part in tx.slices((pa.record_batch({"n": list(range(4000)), "text": texts}) for _ in range(2)), "text", 100_000):
        got.append((part.num_rows, part["n"][0].as_py(), part["text"][-1].as_py()))
    assert pa.total_allocated_bytes() - before < 1_000_000  # of 4.8 MB in a batch
    assert sum(n for n, _, _ in got) == 8000
    at = 0
    for n, first, last in got:
        assert (first, last) == (at % 4000, texts[(at + n - 1) % 4000])
        at += n
