"""Vectorised word handling shared by the text operators.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything
here works on one Arrow column as a flat byte buffer with offsets, so the cost
per byte is a handful of numpy operations and memory is bounded by the slice
size, never by the length of a document.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
#: Bytes of text handled at once by ``slices``.
SLICE_BYTES = 3 << 20
#: Bytes from which on a word is hashed on its own.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def tidy() -> None:
    """Gives freed memory back to the machine: workers live on between tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each.

    Slices are copies: who still holds one does not hold its batch, of up to 64 MB.
    With the last slice of a task the batch goes too, and its memory back to the machine.
    """
    for batch in batches:
        if batch.num_rows:
            offs = flat(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
            yield pa.ipc.read_record_batch(batch.slice(start, stop - start).serialize(), batch.schema)
            start = stop
            tidy()
        batch = offs = None
    tidy()


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _seeded(seed: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([seed], U64) * U64(0xD1342543DE82EF95) + U64(0x9E3779B97F4A7C15))[0]


#: By the number of bytes that a word has left, what of the next eight is its own.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    Up to ``LONG`` bytes are mixed in eight at a time, each time by a bijection of
    the whole state, after the length; longer words are hashed by keyed BLAKE2b.
    So no pattern of the bytes makes two words agree, only chance.
    """
    if not len(starts):
        return np.zeros(0, U64)
    if lower:
        data = LOWER[data]
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        key = _seeded(seed)
        out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) ^ key)
        at = None
        for k in range(0, min(int(size.max()), LONG), 8):
            at = np.flatnonzero((size > k) & (size <= LONG)) if k else (np.flatnonzero(size <= LONG) if size.max() > LONG else slice(None))
            out[at] = mix((out[at] ^ (eight[starts[at] + k] & _OWN[np.minimum(size[at] - k, 8)])) + key)
    raw = None
    for i in np.flatnonzero(size > LONG).tolist():
        raw = raw if raw is not None else memoryview(data)
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=int(key).to_bytes(8, "little")).digest(), "little")
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of k consecutive words, also of runs across documents (callers mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):  # an odd factor of its own for each place: powers of one would cancel in patterns
            out += words[j : j + n] * (_seeded(seed * 1_000_003 + j) | U64(1))
        return mix(out)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit value, little-endian."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").reshape(-1)
