"""Line deduplication by pairwise alignment.

A line's key is the hash of the line without white space at its ends; blank
lines have none.  Documents overlap when they share a line.  A document's partners are
the first holders of its shared lines, of all of them however many documents hold
the line, which makes at most one pair a line: every line with an earlier
holder is judged against the first.  (With ``rare`` only lines count that at most so many
hold, or that are as rare as any shared line of the document.)  With each earlier partner it is
aligned by patience diff, and lines of aligned blocks are deleted from it, the
later one.  Alignment sees the input, not what is left of the partner.

Lines are hashed once, to a narrow table that statistics, partners and their
arrays of line hashes are taken from; statistics are partial aggregates, and texts travel once, compressed.

Results in unusual cases: null text has no lines and an empty result; a null
doc_id is no partner and keeps all; rows that share a doc_id are never partners
of each other and each is one when another document's line leads to it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved
from .text import SLICE_BYTES, slices

#: Holders up to which a line leads to a partner: no limit.
RARE = (1 << 63) - 1
HOT = 1000
#: Words of an aligned block that are worth deleting it.
LEAST_WORDS = 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal elements, rising in both: common ends, then unique common elements in the longest rising run, and so on between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i >= p or j >= q:
            continue
        na, nb = Counter(a[i:p]), Counter(b[j:q])
        place = {x: k for k, x in enumerate(a[i:p], i) if na[x] == 1 and nb.get(x) == 1}
        tops: list[int] = []  # last element of the best run of each length
        ends: list[int] = []
        back: dict[int, int] = {}
        for k in range(j, q):
            at = place.get(b[k])
            if at is None:
                continue
            n = bisect_left(tops, at)
            back[k] = ends[n - 1] if n else -1
            if n == len(tops):
                tops.append(at)
                ends.append(k)
            else:
                tops[n], ends[n] = at, k
        k = ends[-1] if ends else -1
        while k >= 0:
            at = place[b[k]]
            out.append((at, k))
            todo.append((at + 1, p, k + 1, q))
            p, q = at, k
            k = back[k]
        if ends:
            todo.append((i, p, j, q))
    return sorted(out)


def aligned(partner: list[int], own: list[int], words: list[int], least: int) -> set[int]:
    """Lines of ``own`` in blocks aligned with the partner that have ``least`` words; key 0 is a blank line."""
    gone: set[int] = set()
    block: list[int] = []
    n, last = 0, (-2, -2)
    for i, j in [*patience(partner, own), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if block and n >= least:
                gone.update(block)
            block, n = [], 0
        block.append(j)
        n += words[j] if j >= 0 else 0
        last = (i, j)
    return gone


def line_key(line: bytes) -> int:
    line = line.strip(b" \t\n\x0b\f\r")
    return (int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True) or 1) if line else 0


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id and the key of every line in order; null text has no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys = [[] if t is None else [line_key(x) for x in t.split(b"\n")] for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            blobs = [coder.compress(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, blob binary")


def pairs(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_id, partner: a document and the first holder of a shared line of it."""
    held = lines.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0")
    stats = held.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first"))
    stats = saved(stats.where("df > 1"))
    # A line that more than one in HOT of all have meets its holders by broadcast: there are fewer than HOT.
    hot = F.col("df") > held.count() / HOT
    often = F.broadcast(stats.where(hot))
    others = held.join(often.select("key"), "key", "left_anti").join(stats.where(~hot), "key")
    shared = held.join(often, "key").unionByName(others).groupBy("doc_id").agg(F.min("df").alias("least"), F.collect_set(F.struct("df", "first")).alias("lines"))
    found = shared.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x.df <= F.greatest(F.lit(rare), F.col("least"))), lambda x: x.first))).alias("partner"))
    return found.where("partner < doc_id")


def deduplicate(docs: DataFrame, rare: int = RARE, least_words: int = LEAST_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept: the kept lines, or the SHA-256 of them with ``digest``."""
    lines = saved(line_keys(docs))  # narrow: 8 bytes a line
    keys = lines.select(F.col("doc_id").alias("partner"), F.col("keys").alias("theirs")).where("partner is not null").distinct()
    asked = pairs(lines, rare).join(keys, "partner").select("doc_id", F.lit(0).alias("kind"), "theirs", F.lit(None).cast("binary").alias("blob"))
    texts = packed_texts(docs).select("doc_id", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("theirs"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unz = zstandard.ZstdDecompressor()

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_lines", "n_removed", "kept"])

        key, partners, rows, size = None, [], [], 0
        for batch in batches:
            ids, kinds, blobs = (batch.column(c).to_pylist() for c in ("doc_id", "kind", "blob"))
            theirs = batch.column("theirs")
            for at, (d, kind, blob) in enumerate(zip(ids, kinds, blobs, strict=True)):
                if d != key:
                    key, partners = d, []
                if kind == 0:
                    partners.append(np.asarray(theirs[at].values).tolist())
                    continue
                text = unz.decompress(blob)
                parts = text.split(b"\n") if text else []
                gone: set[int] = set()
                if partners:
                    own = [line_key(x) for x in parts]
                    words = [len(x.split()) for x in parts]
                    for p in partners:
                        gone |= aligned(p, own, words, least_words)
                    text = b"\n".join(x for i, x in enumerate(parts) if i not in gone)
                rows.append((d, len(parts), len(gone), hashlib.sha256(text).hexdigest() if digest else text.decode()))
                size += len(text)
                if len(rows) >= 2000 or size > SLICE_BYTES:
                    yield done(rows)
                    rows, size = [], 0
        if rows:
            yield done(rows)

    both = asked.unionByName(texts)
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept string")


def op2_line_dedup(spark, sf_dir):
    return deduplicate(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")
