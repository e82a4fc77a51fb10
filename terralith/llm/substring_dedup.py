"""Removal of long passages that an earlier document has, by De Bruijn compaction.

The edges of the graph are the k-word windows of all documents.  Their
fingerprints meet in buckets, where an edge that several documents hold is
repeated; its earliest holder is its source, with the coordinates (document,
word position).  Repeated edges go back to their documents, where edges whose
source coordinates run on together, which is a path that does not branch, are
compacted to one span; a span covers its words.  Last, every span is verified
at its source coordinates, in a join of spans with source texts: the words' own
bytes are compared, through their 128-bit BLAKE2b digests, which have nothing in
common with the fingerprints.  Should one fail, two windows have shared a
fingerprint and the whole run is repeated with longer ones: the result is
exact at every size.

Before the shuffle each slice of input resolves what repeats within it and sends
an edge for its earliest holder only, so that a passage of a third of all
documents costs a row per slice.  Blobs of packed arrays, not rows, are moved:
about 8 bytes an edge; texts are moved once, compressed.

Results in unusual cases: null and short texts lose nothing; rows with a null
doc_id lose nothing and are no source; rows that share a doc_id are never
sources of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, moved
from .text import U64, flat, mix, pack, slices, tidy, unpack, window_hashes, word_bounds, word_hashes

K = 13
SLICE = 8 << 20
#: Bytes of text that are worth a document group of their own; blobs number slices or buckets times groups.
GROUP = 8 << 20


def _z():
    import zstandard

    return zstandard


def put(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed, with their lengths before them."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return _z().ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], "<u8").tobytes() + b"".join(raw))


def get(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _z().ZstdDecompressor().decompress(blob)
    lengths = np.frombuffer(raw, "<u8", len(kinds))
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], k) for k, a, b in zip(kinds, at, at[1:], strict=False)]


def deltas(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Differences along x that start anew with each row."""
    out = x.copy()
    if len(x):
        same = rows[1:] == rows[:-1]
        out[1:][same] -= x[:-1][same]
    return out


def undeltas(d: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if not len(d):
        return d.astype(np.int64)
    total = np.cumsum(d.astype(np.int64))
    new = np.ones(len(d), bool)
    new[1:] = rows[1:] != rows[:-1]
    at = np.flatnonzero(new)
    base = total[at] - d[at]
    return total - np.repeat(base, np.diff(np.append(at, len(d))))


def tags_of(data: np.ndarray, offs: np.ndarray, seed: int) -> np.ndarray:
    """16 bits that tell rows with the same doc_id and different texts apart."""
    raw = memoryview(data)
    return np.array([zlib.crc32(raw[offs[i] : offs[i + 1]], seed) & 0xFFFF for i in range(len(offs) - 1)], np.int64)


class Slice:
    """Words, windows and identities of the rows of one piece of input."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, k: int, seed: int):
        self.starts, self.ends, self.first = word_bounds(data, offs)
        self.words = word_hashes(data, self.starts, self.ends, seed)
        self.n_rows = len(offs) - 1
        self.tags = tags_of(data, offs, seed)
        self.k = k
        row = np.repeat(np.arange(self.n_rows, dtype=np.int32), np.diff(self.first))
        n = max(0, len(row) - k + 1)
        self.inside = row[:n] == row[k - 1 : k - 1 + n]
        self.row_of = row[:n]

    def windows(self, seed: int = 1) -> np.ndarray:
        return window_hashes(self.words, self.k, seed)


def leaders(h: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by edge; and for each place in it the place of the first of its edge."""
    order = np.argsort(h, kind="stable") if extra is None else np.lexsort((extra, h))
    new = np.ones(len(h), bool)
    a = h[order]
    new[1:] = a[1:] != a[:-1]
    if extra is not None:
        b = extra[order]
        new[1:] |= b[1:] != b[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(np.int64).view(U64) + U64(77)), groups)


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the positions that have it, in their order."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.diff(keys[order], prepend=-1)) if len(keys) else []
    for a, b in zip(at, np.append(at[1:], len(keys)), strict=True) if len(keys) else []:
        yield int(keys[order[a]]), order[a:b]


def _flags(ids, tags, pos, src, src_tag, src_pos, groups: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Repeated edges by document group, packed: sorted by document and position, as differences."""
    g = group_of(ids, groups)
    order = np.lexsort((pos, tags, ids, g))
    g, ids, tags, pos, src, src_tag, src_pos = (x[order] for x in (g, ids, tags, pos, src, src_tag, src_pos))
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(new)
    for a, b in zip(at, np.append(at[1:], len(g)), strict=True):
        one = np.zeros(b - a, np.int64)
        yield int(g[a]), kind, put(*[deltas(x[a:b].astype(np.int64), one) for x in (ids, tags, pos, src, src_tag, src_pos - pos)])


def _unflags(blob: bytes) -> list[np.ndarray]:
    out = [np.cumsum(x) for x in get(blob, *["<i8"] * 6)]
    out[5] = out[5] + out[2]
    return out


def _rows(rows: list[tuple], names=("key", "kind", "blob")) -> pa.RecordBatch:
    keys, kinds, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], list(names))


def edges(docs: DataFrame, k: int, buckets: int, groups: int, width: int, seed: int) -> DataFrame:
    """Kind 0: edges by bucket; kind 1: edges whose source is in the same slice, by document group."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            by = np.lexsort((tags_of(*flat(batch.column("text")), seed), ids))  # rows, and so edges, in the order of sources
            batch, ids = batch.take(pa.array(by)), ids[by]
            s = Slice(*flat(batch.column("text")), k, seed)
            h = s.windows()
            extra = s.windows(3) if width > 8 else None
            del s.words, s.starts, s.ends
            null = np.asarray(batch.column("doc_id").is_null())
            use = np.flatnonzero(s.inside & ~null[s.row_of]) if len(h) else np.zeros(0, np.int64)
            if not len(use):
                continue
            h, row, extra = h[use], s.row_of[use], None if extra is None else extra[use]
            pos = (use - s.first[row]).astype(np.int32)
            del use
            order, lead = leaders(h, extra)
            rs = row[order]
            late = ids[rs] > ids[rs[lead]]
            if late.any():
                me, to = order[late], order[lead[late]]
                out = list(_flags(ids[row[me]], s.tags[row[me]], pos[me], ids[row[to]], s.tags[row[to]], pos[to], groups, 1))
                yield _rows(out)
            send = np.sort(order[~late])  # by row and position again
            for b, at in _split(bucket_of(h[send], buckets)):
                at = send[at]
                r = row[at]
                new = np.ones(len(r), bool)
                new[1:] = r[1:] != r[:-1]
                one = np.flatnonzero(new)
                n = np.diff(np.append(one, len(r)))
                yield _rows([(b, 0, put(deltas(ids[r[one]], n * 0), s.tags[r[one]].astype("<u2"), n.astype("<u4"), deltas(pos[at], r).astype("<u4")) + pack(h[at], min(width, 8)) + (b"" if extra is None else pack(extra[at], width - 8)) + np.array([len(at)], "<u8").tobytes())])

    return docs.select("doc_id", "text").mapInArrow(run, "key int, kind int, blob binary")


def resolve(found: DataFrame, groups: int, width: int) -> DataFrame:
    """In each bucket, edges that several documents hold, for all but the first; and who is a source."""

    def bucket(blobs: list[bytes]):
        ids, tags, counts, pos, fps, more = [], [], [], [], [], []
        for blob in blobs:
            n = int(np.frombuffer(blob[-8:], "<u8")[0])
            cut = len(blob) - 8 - n * width
            a, b, c, d = get(blob[:cut], "<i8", "<u2", "<u4", "<u4")
            own = np.repeat(np.arange(len(c)), c)
            ids.append(np.cumsum(a)), tags.append(b.astype(np.int64)), counts.append(c)
            pos.append(undeltas(d, own)), fps.append(unpack(blob[cut : cut + n * min(width, 8)], min(width, 8)))
            if width > 8:
                more.append(unpack(blob[cut + n * 8 : -8], width - 8))
        ids, tags, counts, pos, h = map(np.concatenate, (ids, tags, counts, pos, fps))
        by = np.lexsort((tags, ids))  # rows, and so edges, in the order of sources
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)[by]
        ids, tags, counts = ids[by], tags[by], counts[by].astype(np.int64)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(len(row))
        pos, h = pos[at], h[at]
        order, lead = leaders(h, np.concatenate(more)[at] if more else None)
        rs = row[order]
        late = ids[rs] > ids[rs[lead]]
        if late.any():
            me, to = order[late], order[lead[late]]
            yield from _flags(ids[row[me]], tags[row[me]], pos[me], ids[row[to]], tags[row[to]], pos[to], groups, 1)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for k, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    yield _rows([(k, 1, blob)])
                    continue
                if k != key and held:
                    if rows := list(bucket(held)):
                        yield _rows(rows)
                    held = []
                key = k
                held.append(blob)
        if held and (rows := list(bucket(held))):
            yield _rows(rows)
        tidy()

    return found.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, "key int, kind int, blob binary")


def notes(flags: DataFrame, groups: int) -> DataFrame:
    """Kind 0, by the source's group: the documents that are somebody's source."""

    def run(batches):
        src = np.zeros(0, np.int64)
        for batch in batches:
            src = np.unique(np.concatenate([src, *(_unflags(blob)[3] for blob in batch.column("blob").to_pylist())]))
        for g, at in _split(group_of(src, groups)):
            yield _rows([(g, 0, put(src[at]))])

    return flags.mapInArrow(run, "key int, kind int, blob binary")


def packed_texts(docs: DataFrame, groups: int) -> DataFrame:
    """Kind 2, by group: each text, compressed."""

    def run(batches):
        coder = _z().ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            data, offs = flat(batch.column("text"))
            raw = memoryview(data)
            keys = group_of(np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64), groups).astype(np.int32)
            blobs = pa.array([coder.compress(raw[offs[i] : offs[i + 1]]) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(batch.num_rows, 2, np.int32)), blobs, batch.column("doc_id").cast(pa.int64())], ["key", "kind", "blob", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key int, kind int, blob binary, doc_id long")


def spans(pos, src, src_tag, src_pos) -> list[np.ndarray]:
    """Edges of one document, sorted by position, compacted: start, source, source tag, source position, edges."""
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_tag[1:] != src_tag[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    at = np.flatnonzero(new)
    return [pos[at], src[at], src_tag[at], src_pos[at], np.diff(np.append(at, len(pos)))]


def span_digests(words: list[bytes], start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of the words of each span, joined by one space, as two 64-bit integers."""
    raw = b"".join(hashlib.blake2b(b" ".join(words[a : a + m]), digest_size=16).digest() for a, m in zip(start.tolist(), n.tolist(), strict=True))
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


OUT = "kind int, key int, doc_id long, n_words long, n_removed long, kept string, blob binary"


def removal(rows: DataFrame, k: int, groups: int, seed: int, digest: bool) -> DataFrame:
    """Kind 0: results; kind 1: spans to verify, by the source's group; kind 2: texts of sources."""

    def texts(items, flags, sources):
        unz = _z().ZstdDecompressor()
        raw = [unz.decompress(b) if b else b"" for _, b in items]
        data, offs = flat(pa.array(raw, pa.large_binary()))
        first, tags = word_bounds(data, offs)[2], tags_of(data, offs, seed)
        ids = [d for d, _ in items]
        out, asked = [], []
        for i, d in enumerate(ids):
            words = raw[i].split()
            lo = hi = 0
            if d is not None and flags is not None:
                lo, hi = np.searchsorted(flags[0], [d, d + 1])
            if hi > lo:
                a, b = lo + np.searchsorted(flags[1][lo:hi], [tags[i], tags[i] + 1])
                lo, hi = int(a), int(b)
            removed = 0
            if hi > lo:
                pos = flags[2][lo:hi]
                start, src, tag, at, n = spans(pos, *(x[lo:hi] for x in flags[3:]))
                asked.append((np.full(len(start), d), src, tag, at, n + k - 1, *span_digests(words, start, n + k - 1)))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n + k - 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                removed = len(words) - int(keep.sum())
                words = compress(words, keep.tolist())
            kept = b" ".join(words)
            out.append((0, 0, d, int(first[i + 1] - first[i]), removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode(), None))
            if d is not None and sources is not None and len(sources) and sources[min(np.searchsorted(sources, d), len(sources) - 1)] == d:
                out.append((2, int(group_of(np.array([d]), groups)[0]), d, None, None, None, items[i][1]))
        if asked:
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*asked, strict=True)]
            for g, at in _split(group_of(columns[1], groups)):
                out.append((1, g, None, None, None, None, put(*[c[at] for c in columns])))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "key", "doc_id", "n_words", "n_removed", "kept", "blob"])

    def run(batches):
        key, held, src, flags, sources, items, size = None, [], [], None, None, [], 0
        for batch in batches:
            for g, kind, blob, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != key:
                    if items:
                        yield texts(items, flags, sources)
                    key, held, src, flags, sources, items, size = g, [], [], None, None, [], 0
                if kind == 0:
                    src.append(get(blob, "<i8")[0])
                elif kind == 1:
                    held.append(blob)
                else:
                    if held:
                        flags = [np.concatenate(x) for x in zip(*map(_unflags, held), strict=True)]
                        order = np.lexsort((flags[2], flags[1], flags[0]))
                        flags, held = [x[order] for x in flags], []
                    if src:
                        sources, src = np.unique(np.concatenate(src)), []
                    items.append((d, blob))
                    size += len(blob)
                    if size > SLICE // 4:
                        yield texts(items, flags, sources)
                        items, size = [], 0
                        tidy()
        if items:
            yield texts(items, flags, sources)
        tidy()

    return rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, OUT)


def failures(done: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id of spans whose words are not those at their source coordinates."""

    def run(batches):
        unz = _z().ZstdDecompressor()
        key, asked = None, None
        held: list[bytes] = []
        sought = 0
        for batch in batches:
            bad: list[int] = []
            for g, kind, d, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "doc_id", "blob")), strict=True):
                if g != key:
                    if asked is not None and sought:
                        bad.append(-1)  # a source that was not found
                    key, asked, held, sought = g, None, [], 0
                if kind == 1:
                    held.append(blob)
                    continue
                if held:
                    asked = [np.concatenate(x) for x in zip(*(get(b, *["<i8"] * 7) for b in held), strict=True)]
                    order = np.lexsort((asked[2], asked[1]))
                    asked, held, sought = [x[order] for x in asked], [], len(order)
                    seen = np.zeros(len(order), bool)
                if asked is None:
                    continue
                lo, hi = np.searchsorted(asked[1], [d, d + 1])
                if hi <= lo:
                    continue
                raw = unz.decompress(blob)
                mine = lo + np.flatnonzero(asked[2][lo:hi] == tags_of(*flat(pa.array([raw], pa.large_binary())), seed)[0])
                mine = mine[~seen[mine]]
                if not len(mine):
                    continue
                seen[mine] = True
                sought -= len(mine)
                a, b = span_digests(raw.split(), asked[3][mine], asked[4][mine])
                ok = (a == asked[5][mine]) & (b == asked[6][mine])
                bad += asked[0][mine][~ok].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], ["doc_id"])
        if held or (asked is not None and sought):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64())], ["doc_id"])

    rows = done.where("kind > 0").select("key", "kind", "doc_id", "blob")
    return rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, "doc_id long")


def fingerprint_bytes(words: int, buckets: int) -> int:
    """Bytes that make a shared fingerprint unlikely (one in 500 runs) among so many windows; the bucket counts as bits."""
    return min(16, max(4, math.ceil((2 * math.log2(max(words, 2)) + 8 - math.log2(buckets)) / 8)))


def deduplicate(docs: DataFrame, k: int = K, digest: bool = False, seed: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the kept words joined by one space, or their SHA-256 with ``digest``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, size // GROUP)
    buckets = 2 * groups
    width = fingerprint_bytes(size // 6, buckets)
    while True:
        flags = resolve(edges(docs, k, buckets, groups, width, seed), groups, width)
        flags = moved(flags)  # small: differences, compressed; the edges have done their work
        rows = flags.select("key", "kind", "blob", F.lit(None).cast("long").alias("doc_id"))
        rows = rows.unionByName(notes(flags, groups).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(packed_texts(docs, groups))
        done = moved(removal(rows, k, groups, seed, digest))  # and so have the texts
        if failures(done, k, seed).isEmpty():
            return done.where("kind = 0").select("doc_id", "n_words", "n_removed", "kept")
        width, seed = min(width + 4, 16), seed + 4


def op4_substring_dedup(spark, sf_dir):
    return deduplicate(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")
