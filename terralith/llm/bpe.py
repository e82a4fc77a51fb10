"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, so that passages shared by
documents give the same chunks.  Each worker encodes a chunk once and keeps it
(bounded memory, cleared when full).  A cut may fall inside a word: a kept chunk
is its first fragment, the ids between its outer white space, and its last
fragment, and a join is repaired by re-encoding fragment + fragment, widened
over further chunks until white space stands on both sides.  There the ids
agree with those of the whole text: the pre-tokenizer never joins across white
space, and neither do its normaliser and merges.  A vocabulary whose file does not say so (``separable``),
or whose library disagrees on probes, is encoded and decoded by the library, whole text by whole text.

One scan, no shuffle.  Results in unusual cases: null counts as empty, an empty
text has no ids and decodes to an empty text; special tokens written in a text
are encoded as the library does; repeated rows are rows of their own; an empty
table gives no rows; other columns are ignored (``encode``) or, with ``keep``,
carried along.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .text import flat, slices, tidy

VOCABULARY = "word_bpe_49k.json"
#: Mean bytes of a chunk (a power of two), bytes the hash looks back over, and bounds of what a worker keeps.
CHUNK_BYTES = 512
WINDOW = 16
KEEP_CHUNK_BYTES = 12 << 20
KEEP_WORDS = 100_000
_SPACES = b" \t\n\x0b\f\r"
_FIRST = re.compile(rb"[ \t-\r]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, mean: int = CHUNK_BYTES) -> np.ndarray:
    """Positions after which a chunk ends: the rolling hash of the last WINDOW bytes has its low bits zero."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    out = []
    for a in range(0, len(data) - WINDOW + 1, 1 << 18):
        part = data[a : a + (1 << 18) + WINDOW - 1].astype(np.uint32)
        h = part.copy()
        step = 1
        with np.errstate(over="ignore"):
            while step < WINDOW:  # doubling: a polynomial over 2, 4, 8, 16 bytes
                h = h[:-step] * np.uint32(pow(0x01000193, step, 1 << 32)) + h[step:]
                step *= 2
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        out.append(np.flatnonzero((h >> np.uint32(12)) % np.uint32(mean) == 0) + a + WINDOW)
    return np.concatenate(out)


#: Texts on which the parts and the library must agree before parts are used.
PROBES = ("", " ", "a", "it's  one\tTwo\nthree\r\x0b\x0cfour", "caf\u00e9 na\u0131ve 12 3.5 -- !!! x_y", "\u6f22\u5b57 \u03a3\u0391\u03a3 \u05d0\u05d1", "<|endoftext|> b", "e\u0301 a\u200bb \u00a0c")


def separable(path: str) -> bool:
    """Whether a tokenizer's file says that white space is dropped before anything is merged and that tokens are decoded one by one."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = told.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    return told.get("decoder") is None and told.get("post_processor") is None and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, mean: int = CHUNK_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; before the library looks
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.mean = mean
        self.words: dict[bytes, bytes] = {b"": b""}
        self.chunks: dict[bytes, tuple] = {}
        self.kept = 0
        # What each id decodes to, with the blank that the library puts between tokens.
        names = [(self.tok.id_to_token(i) or "").encode() + b" " for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.length = np.array([len(n) for n in names], np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.whole = not separable(path) or not self.agrees()

    def library(self, text: bytes) -> tuple[bytes, bytes]:
        ids = self.tok.encode(text.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes(), self.tok.decode(ids, skip_special_tokens=False).encode()

    def agrees(self) -> bool:
        ids = [self.encode([t.encode()]) for t in PROBES]
        return list(zip(ids, self.decode(ids), strict=True)) == [self.library(t.encode()) for t in PROBES]

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that are not known yet, some thousands in a call."""
        new = [w for w in words if w not in self.words]
        for i in range(0, len(new), 4000):
            part = new[i : i + 4000]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.words[w] = array("I", e.ids).tobytes()

    def ids(self, words: list[bytes]) -> bytes:
        """ids of words that stand between white space."""
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return b"".join([known[w] for w in words])

    def prepare(self, texts: list[bytes]) -> None:
        """Makes room, then learns all words of the chunks to come; what they need stays."""
        seen: set[bytes] = set()
        for t in texts:
            words = t.split()
            seen.update(words[t[0] not in _SPACES : len(words) - (t[-1] not in _SPACES)])  # fragments aside
        if len(self.words) > KEEP_WORDS:
            self.words = {w: v for w in seen if (v := self.words.get(w)) is not None} | {b"": b""}
        self.learn(seen)
        if self.kept > KEEP_CHUNK_BYTES:
            self.chunks, self.kept = {}, 0

    def forget(self) -> None:
        """What a task has kept goes with it: the worker lives on, beside a JVM that needs the memory."""
        self.words, self.chunks, self.kept = {b"": b""}, {}, 0
        tidy()

    def chunk(self, raw: bytes) -> tuple:
        """(first fragment, ids, last fragment), or (raw,) if it has no white space."""
        got = self.chunks.get(raw)
        if got is None:
            first = _FIRST.search(raw)
            if first is None:
                got = (raw,)
            else:
                words = raw[first.start() :].split()
                tail = b"" if raw[-1] in _SPACES else words.pop()
                got = (raw[: first.start()], self.ids(words), tail)
            self.chunks[raw] = got
            self.kept += len(raw) + 4 * len(raw)
        return got

    def encode(self, chunks: list[bytes]) -> bytes:
        """ids, as little-endian 32-bit integers, of the chunks of one text."""
        ids, open_ = [], b""
        for raw in chunks:
            got = self.chunk(raw) if raw else (raw,)
            if len(got) == 1:  # no white space yet: the join widens
                open_ += got[0]
                continue
            head, body, tail = got
            if open_ or head:
                ids.append(self.ids([open_ + head]))
            ids.append(body)
            open_ = tail
        if open_:
            ids.append(self.ids([open_]))
        return b"".join(ids)

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The decoded texts of several lists of ids, by one gather for some of them at a time."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 1 << 18):
                size += len(texts[stop])
                stop += 1
            ids = np.frombuffer(b"".join(texts[at:stop]), "<u4")
            length = self.length[ids]
            ends = np.cumsum(length, dtype=np.int64)
            shown = self.names[np.repeat(self.start[ids] - (ends - length), length) + np.arange(ends[-1] if len(ids) else 0)].tobytes()
            n = np.cumsum([len(t) // 4 for t in texts[at:stop]])
            first = 0
            for k in n.tolist():
                last = int(ends[k - 1]) if k else 0
                out.append(shown[first : max(first, last - 1)])
                first = last
            at = stop
        return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str, mean: int = CHUNK_BYTES) -> Codec:
    if (path, mean) not in _codecs:
        _codecs.clear()
        _codecs[path, mean] = Codec(path, mean)
    return _codecs[path, mean]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, mean: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    own = codec(vocabulary_path(vocabulary) if "/" not in vocabulary else vocabulary, mean)
    for batch in slices(batches, "text"):
        data, offs = flat(batch.column("text"))
        if own.whole:
            raw = data.tobytes()
            yield batch, [own.library(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            continue
        at = cuts(data, mean)
        first = np.searchsorted(at, offs, "right")
        last = np.searchsorted(at, offs[1:])
        raw, texts = data.tobytes(), []
        for i in range(batch.num_rows):
            ends = [int(offs[i]), *at[first[i] : last[i]].tolist(), int(offs[i + 1])]
            texts.append([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        own.prepare(list({c for t in texts for c in t if c and c not in own.chunks}))
        ids = [own.encode(t) for t in texts]
        yield batch, list(zip(ids, own.decode(ids), strict=True))
        del raw, texts, ids
    own.forget()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array of int), decoded text."""

    def run(batches):
        for batch, rows in encoded(batches, vocabulary, chunk_bytes):
            lengths = np.concatenate([[0], np.cumsum([len(a) // 4 for a, _ in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(lengths, pa.array(np.frombuffer(b"".join(a for a, _ in rows), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([b.decode() for _, b in rows], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as from ``encode``, hashed where they are made."""

    def run(batches):
        for batch, rows in encoded(batches, vocabulary, chunk_bytes):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(a) // 4 for a, _ in rows], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows]), pa.array([hashlib.sha256(b).hexdigest() for _, b in rows])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir))
