"""N-gram Jaccard join: documents whose word shingle sets overlap, by signature trees.

1. Copies (equal shingle sets) are taken together under their smallest doc_id.
2. A forest of trees is planted so that no link runs between two trees.  Sets of a
   pair that reaches the threshold differ in at most d shingles, so of d + 1 ranges
   of the hash space one holds the same shingles in both.  Documents that share
   the content of a range are tied to the first of them, and what is tied
   together, over all ranges, becomes one tree.  Frequent shingles (passages
   that many documents share) are left out of both sides first, which keeps the
   bound d, so that they do not tie strangers; a document of little else ties by
   its empty ranges.  A tree over a block is then looked at again: as more ranges
   than d + 1 are cut for large sets, a linked pair agrees in many, which are
   counted pair by pair (keys that many hold tie without a count), after
   shingles that are frequent among these documents alone are left out too.
3. A tree's nodes hold the OR of their documents' token bitmaps and the range of
   their sizes; a dual traversal skips pairs of nodes by their
   largest possible overlap, or when both lie within one component already, and
   leaves are compared exactly.  Trees over a size limit are cut into blocks and
   traversed as pairs of blocks, in tasks of bounded memory.

Step 2 moves about 8 bytes a range, resolved within each slice of input before
the shuffle; texts are moved once, compressed, and only for documents that
are tied to another.

Results in unusual cases: null, empty and wordless texts have no shingles and
link with nothing; a null doc_id has a null component and links with nothing;
rows that share a doc_id are one document, linked to itself; an empty table
gives no rows; other columns are ignored (``classes``) or kept, whatever their names (``representatives``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.components import Forest, connected_components

from .common import documents, own_names, partitions, release, saved
from .substring_dedup import _rows, _split, bucket_of, deltas, get, put
from .text import U64, flat, mix, pack, slices, tidy, unpack, window_hashes, word_bounds, word_hashes

SLICE = 3 << 20
#: A shingle is frequent in this share of documents, and in FREQUENT_LEAST of them: at most 1 / FREQUENT times
#: the mean number of shingles are.  Which are found changes the work only, not the result.
FREQUENT = 3e-4
FREQUENT_LEAST = 20
#: Hashes that a task holds while it counts.
COUNTED = 2_500_000
#: Shingles (8 bytes each) of a block; a task holds two.
BLOCK = 1_000_000
KEY_BYTES = 7
#: Shingles held by so many documents of large trees are left out when these are looked at again, one number after another.
AGAIN = (20, 200, 2000)
#: Holders of a key up to which pairs are counted; beyond, all are tied to the first.
COUNTED_HOLDERS = 32
#: Document ids (8 bytes each) up to which a list of them goes to every task.
ONLY = 2_000_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles, sorted, and each document's first (one more at the end)."""
    starts, ends, first = word_bounds(data, offs)
    words = word_hashes(data, starts, ends, lower=True)
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    grams = window_hashes(words, n)
    inside = row[: len(grams)] == row[n - 1 : n - 1 + len(grams)]
    h, r = grams[inside], row[: len(grams)][inside]
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n)):  # fewer words: the whole sequence is one
        w = words[first[i] : first[i + 1]]
        h = np.append(h, window_hashes(w, len(w)) ^ U64(len(w)))
        r = np.append(r, i)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(rows + 1))


def size_classes(percent: int, most: int) -> np.ndarray:
    """Bounds of size classes; sizes of a linked pair lie in the same class or in two that adjoin."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, np.int64)


def ranges_of(percent: int, low: int, high: int) -> tuple[int, int]:
    """Ranges to cut the hash space into for sets of low to high shingles, and most differences d of a linked pair.

    More than d + 1 are cut for larger sets, so that only empty ranges agree in none but odd cases.
    """
    d = (100 - percent) * 2 * high // (100 + percent)
    spare = (d + 1) * (30 if percent < 85 else 10) // 100 if low >= 40 else 0
    empty = (d + 1 + spare) * math.exp(-low / (d + 1 + spare))
    return d + 1 + max(spare, math.ceil(empty + 4 * math.sqrt(empty)) if low >= 40 else 0), d


def range_keys(h: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key for the content of each range of each document, the document it is from, and in how many keys each document agrees with any it is linked with, at least.

    h: shingles without the frequent ones; size: of the whole sets.
    """
    need = np.full(len(first) - 1, np.iinfo(np.int64).max)
    n = np.diff(first)
    own = np.searchsorted(bounds, size, "right")  # class of a size: bounds[own - 1] <= size < bounds[own]
    keys, docs = [], []
    row = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
        for step in (0, 1):
            cls = own + step
            cut = {int(c): ranges_of(percent, int(bounds[max(c - 2, 0)]), int(bounds[c]) - 1) for c in np.unique(cls)}
            s = np.array([cut[int(c)][0] for c in cls], np.int64)
            d = np.array([cut[int(c)][1] for c in cls], np.int64)
            seg = ((h >> U64(32)) * s[row].astype(U64)) >> U64(32)
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(h))
            r = row[at]
            keys.append(mix(sums[end] - sums[at] + mix(seg[at] * U64(0x9E3779B97F4A7C15) + cls[r].astype(U64))))
            docs.append(r)
            full = np.bincount(r, minlength=len(n))
            begin = np.concatenate([[0], np.cumsum(full)])
            need = np.minimum(need, np.maximum(full - d, 1))  # of s ranges d differ at most, and s - full may agree as empty ones
            for i in np.flatnonzero((size > 0) & (s - full >= s - d)):  # all ranges that agree might be empty ones
                gone = np.ones(s[i], bool)
                gone[seg[at[begin[i] : begin[i + 1]]].astype(np.int64)] = False
                gone = np.flatnonzero(gone).astype(U64)
                keys.append(mix(mix(gone * U64(0x9E3779B97F4A7C15) + U64(int(cls[i])))))
                docs.append(np.full(len(gone), i))
    return np.concatenate(keys), np.concatenate(docs), need


def among(batches: Iterator[pa.RecordBatch], only) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id is in ``only``, a broadcast of sorted ids; all rows without one."""
    for batch in batches:
        if only is not None:
            ids, listed = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64), only.value
            held = listed[np.minimum(np.searchsorted(listed, ids), len(listed) - 1)] == ids if len(listed) else np.zeros(len(ids), bool)
            batch = batch.filter(pa.array(held & ~np.asarray(batch.column("doc_id").is_null())))
        yield batch


def listed(members: DataFrame):
    """The doc_ids of ``members`` as a broadcast of sorted ids, or None if they are more than ONLY."""
    ids = members.select("doc_id").distinct().limit(ONLY + 1).toArrow().column("doc_id").to_numpy()  # of checked size
    return members.sparkSession.sparkContext.broadcast(np.sort(ids).astype(np.int64)) if len(ids) <= ONLY else None


def frequent(docs: DataFrame, n: int, documents_: int, least: int = FREQUENT_LEAST, only=None) -> np.ndarray:
    """Hashes of shingles that many documents (of ``only``) hold, sorted; counted over all of them, by task and then together."""
    least = max(least, int(FREQUENT * documents_))

    def run(batches):
        held, size, seen = [], 0, set()

        def counts():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            some = c > 2
            return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(c[some])], ["h", "c"])

        for batch in slices(among(batches, only), "text", SLICE):
            h, first = shingle_sets(*flat(batch.column("text")), n)
            d1 = set_digest(h, first)[0].tolist()
            fresh = np.array([not (d in seen or seen.add(d)) for d in d1], bool)  # copies count once in a task
            held.append(h[np.repeat(fresh, np.diff(first))])
            size += len(held[-1])
            if size > COUNTED:
                yield counts()
                held, size, seen = [], 0, set()
        if held:
            yield counts()
        tidy()

    found = docs.select("doc_id", "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(U64)) if documents_ else np.zeros(0, U64)


def set_digest(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.diff(np.concatenate([[U64(0)], np.cumsum(mix(h + U64(k)), dtype=U64)])[first]).view(np.int64) for k in (1, 2))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the shingle set."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            h, first = shingle_sets(*flat(batch.column("text")), n)
            d1, d2 = set_digest(h, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first)), pa.array(d1), pa.array(d2)], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's smallest id as (order, is first) and the distinct pairs (smallest, other)."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    lead = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    other = lead != d
    pairs = np.unique(np.column_stack([lead[other], d[other]]), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return order, new, pairs


def ties(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """a, b: documents that hold the same shingles in some range, each with the first that does; ``common`` ones aside."""
    buckets = partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        for batch in slices(batches, "text", SLICE):
            h, first = shingle_sets(*flat(batch.column("text")), n)
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            use = ~np.asarray(batch.column("doc_id").is_null()) & (np.diff(first) > 0)
            d1, d2 = set_digest(h, first)
            order = np.lexsort((ids, d2, d1))
            copy = np.zeros(len(ids), bool)
            copy[order[1:]] = (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]]) & use[order[:-1]]
            use &= ~copy
            keep = np.repeat(use, np.diff(first))
            size = np.where(use, np.diff(first), 0)[use]
            h, ids = h[keep], ids[use]
            if not len(h):
                continue
            row = np.repeat(np.arange(len(ids)), size)
            if len(shared.value):
                at = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                rare = shared.value[at] != h
                h, row = h[rare], row[rare]
            first = np.searchsorted(row, np.arange(len(ids) + 1))
            keys, row, _ = range_keys(h, first, size, percent, size_classes(percent, int(size.max()) * 2 + 2))
            order, new, pairs = _stars(keys, ids[row])
            if len(pairs):
                yield _rows([(int(pairs[0, 0]) % buckets, 1, put(pairs[:, 0], pairs[:, 1]))])
            keys, who = keys[order[new]], ids[row[order[new]]]
            for b, at in _split(bucket_of(keys, buckets)):
                at = at[np.argsort(who[at], kind="stable")]
                w = who[at]
                one = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                count = np.diff(np.append(one, len(w)))
                yield _rows([(b, 0, put(deltas(w[one], count * 0), count.astype("<u4")) + pack(keys[at], KEY_BYTES) + np.array([len(at)], "<u8").tobytes())])

    def meet(batches):
        def bucket(blobs):
            keys, ids = [], []
            for blob in blobs:
                m = int(np.frombuffer(blob[-8:], "<u8")[0])
                cut = len(blob) - 8 - m * KEY_BYTES
                w, count = get(blob[:cut], "<i8", "<u4")
                ids.append(np.repeat(np.cumsum(w), count))
                keys.append(unpack(blob[cut:-8], KEY_BYTES))
            return _stars(np.concatenate(keys), np.concatenate(ids))[2]

        # A pair that shares many ranges meets in many buckets: once a task is enough.
        key, held, pairs = None, [], np.zeros((0, 2), np.int64)
        for batch in batches:
            for k, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    pairs = np.unique(np.concatenate([pairs, np.column_stack(get(blob, "<i8", "<i8"))]), axis=0)
                    continue
                if k != key and held:
                    pairs = np.unique(np.concatenate([pairs, bucket(held)]), axis=0)
                    held = []
                key = k
                held.append(blob)
        if held:
            pairs = np.unique(np.concatenate([pairs, bucket(held)]), axis=0)
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16), 0]), pa.array(pairs[i : i + (1 << 16), 1])], ["a", "b"])
        tidy()

    found = docs.select("doc_id", "text").mapInArrow(emit, "key int, kind int, blob binary")
    return found.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(meet, "a long, b long").distinct()


def strong_ties(docs: DataFrame, n: int, percent: int, common: np.ndarray, only) -> DataFrame:
    """a, b: documents of ``only`` that agree in as many ranges as a linked pair does at least, or share a key with many; ``common`` shingles aside.

    A linked pair of which no key has many holders is counted in each key that it agrees in, so it is found.
    """
    buckets = partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        for batch in slices(among(batches, only), "text", SLICE):
            h, first = shingle_sets(*flat(batch.column("text")), n)
            size, ids = np.diff(first), np.asarray(batch.column("doc_id")).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), size)
            if len(shared.value):
                rare = shared.value[np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)] != h
                h, row = h[rare], row[rare]
            keys, row, need = range_keys(h, np.searchsorted(row, np.arange(len(ids) + 1)), size, percent, size_classes(percent, int(size.max()) * 2 + 2))
            for b, at in _split(bucket_of(keys, buckets)):
                at = at[np.argsort(row[at], kind="stable")]
                one, count = np.unique(row[at], return_counts=True)
                yield _rows([(b, 0, put(ids[one], need[one].astype("<i8"), count.astype("<u4")) + pack(keys[at], KEY_BYTES) + np.array([len(at)], "<u8").tobytes())])

    def pairs(blobs):
        keys, ids, need = [], [], []
        for blob in blobs:
            m = int(np.frombuffer(blob[-8:], "<u8")[0])
            cut = len(blob) - 8 - m * KEY_BYTES
            w, least, count = get(blob[:cut], "<i8", "<i8", "<u4")
            ids.append(np.repeat(w, count))
            need.append(np.repeat(least, count))
            keys.append(unpack(blob[cut:-8], KEY_BYTES))
        keys, ids, need = np.concatenate(keys), np.concatenate(ids), np.concatenate(need)
        order = np.lexsort((ids, keys))
        keys, ids, need = keys[order], ids[order], need[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        holders = np.diff(np.append(new, len(keys)))
        many, lead = np.repeat(holders > COUNTED_HOLDERS, holders), np.repeat(new, holders)
        found = [(lead[many], np.flatnonzero(many), True)]
        for step in range(1, min(int(holders.max()), COUNTED_HOLDERS)):
            a = np.flatnonzero((keys[step:] == keys[:-step]) & ~many[step:])
            found.append((a, a + step, False))
        for a, b, tied in found:
            a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                least = np.where(tied, 0, np.maximum(need[x], need[y]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(least)], ["a", "b", "need"])

    def meet(batches):
        key, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key and held:
                    yield from pairs(held)
                    held = []
                key = k
                held.append(blob)
        if held:
            yield from pairs(held)
        tidy()

    found = docs.select("doc_id", "text").mapInArrow(emit, "key int, kind int, blob binary")
    found = found.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, need long")
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b")


def refined(docs: DataFrame, members: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """``members`` (doc_id, n, tree and others) with trees of more than ``block`` shingles cut where no link can run; documents that link with none go."""
    for least in AGAIN:
        large = saved(members.join(members.groupBy("tree").agg(F.sum("n").alias("_s")).where(F.col("_s") > block).select("tree"), "tree", "left_semi"))
        only = listed(large)
        if only is None or not len(only.value):
            break
        some = strong_ties(docs, n, percent, frequent(docs, n, len(only.value), least, only), only)
        trees = connected_components(some).withColumnsRenamed({"component": "_tree"})
        again = large.join(trees, F.col("doc_id") == F.col("node")).withColumn("tree", F.col("_tree")).select(*members.columns)
        members = saved(members.join(large.select("tree").distinct(), "tree", "left_anti").select(*members.columns).unionByName(again))
        release(docs.sparkSession)
    return members


class Tree:
    """Signature tree over shingle sets: documents in order, nodes with OR bitmaps and size ranges."""

    LEAF, FAN = 32, 8

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.order = order
        self.size = np.array([len(sets[i]) for i in order], np.int64)
        self.maps = np.zeros((len(order), bits // 64), U64)
        for k, i in enumerate(order):
            b = (sets[i] >> U64(20)) % U64(bits)
            np.bitwise_or.at(self.maps[k], (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
        self.spare = self.size - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)  # shingles beyond one a bit
        edge = np.arange(0, len(order), self.LEAF)
        self.levels = [self._nodes(edge, self.maps, self.size, self.size, self.spare, len(order))]
        while len(self.levels[-1][0]) > 1:
            at, ors, lo, hi, spare = self.levels[-1]
            self.levels.append(self._nodes(np.arange(0, len(at), self.FAN), ors, lo, hi, spare, len(at)))

    @staticmethod
    def _nodes(edge, ors, lo, hi, spare, n):
        return edge, np.bitwise_or.reduceat(ors, edge, axis=0), np.minimum.reduceat(lo, edge), np.maximum.reduceat(hi, edge), np.maximum.reduceat(spare, edge)

    def span(self, level: int, node: int) -> tuple[int, int]:
        """The documents below a node, as places in the order."""
        width = self.LEAF * self.FAN**level
        return node * width, min(len(self.order), (node + 1) * width)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def span_links(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``sides``, of links between the two sides only."""
    n, links, forest = len(sets), [], Forest()
    sizes = np.array([len(s) for s in sets], np.int64)
    flat_, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])

    def try_centre(c: int, others: np.ndarray) -> int:
        """Links one set with many at a stroke."""
        others = others[(100 * sizes[others] >= percent * sizes[c]) & (percent * sizes[others] <= 100 * sizes[c])]
        if not len(others):
            return 0
        if len(others) < n // 4:
            both = np.array([overlap(sets[c], sets[o]) for o in others])
        else:
            at = np.minimum(np.searchsorted(sets[c], flat_), sizes[c] - 1)
            both = np.add.reduceat((sets[c][at] == flat_).astype(np.int64), first[:-1])[others]
        got = others[100 * both >= percent * (sizes[c] + sizes[others] - both)]
        for o in got.tolist():
            if forest.join(c, o):
                links.append((c, o))
        return len(got)

    # Centres: most members of a group of near copies link with one of a few of them.
    free = np.ones(n, bool)
    for _ in range(min(n - 1, 6)):
        left = np.flatnonzero(free)
        if not len(left):
            break
        c = int(left[0])
        free[c] = False
        others = np.flatnonzero(free) if sides is None else np.flatnonzero(free & (sides != sides[c]))
        others = others[others != c]
        try_centre(c, others)
        root = forest.root(c)
        for o in others.tolist():
            if forest.root(o) == root:
                free[o] = False
    if n <= 2:
        return links
    roots = np.array([forest.root(i) for i in range(n)])
    if sides is None and (roots == roots[0]).all():
        return links
    order = np.lexsort((sizes, roots))
    bits = 1 << min(16, max(8, math.ceil(math.log2(4 * max(1, int(np.median(sizes)))))))
    tree = Tree(sets, order, bits)

    def alone(lo: int, hi: int) -> int:
        """The one component of these documents, or -1."""
        r = forest.root(int(order[lo]))
        if forest.root(int(order[hi - 1])) != r:
            return -1
        return r if all(forest.root(i) == r for i in order[lo + 1 : hi - 1].tolist()) else -1

    def leaves(a: int, b: int) -> None:
        (p, q), (u, v) = tree.span(0, a), tree.span(0, b)
        x, y = np.arange(p, q), np.arange(u, v)
        sx, sy = tree.size[x][:, None], tree.size[y][None, :]
        lost = np.bitwise_count(tree.maps[x][:, None, :] & ~tree.maps[y][None, :, :]).sum(axis=2).astype(np.int64)
        most = np.minimum(sx - lost, sy)
        may = 100 * most >= percent * (sx + sy - most)
        if a == b:
            may &= x[:, None] < y[None, :]
        for i, j in zip(*np.nonzero(may), strict=True):
            i, j = int(order[x[i]]), int(order[y[j]])
            if (sides is None or sides[i] != sides[j]) and forest.root(i) != forest.root(j) and linked(len(sets[i]), len(sets[j]), overlap(sets[i], sets[j]), percent):
                forest.join(i, j)
                links.append((i, j))

    def visit(level: int, a: int, b: int) -> None:
        _, ors, lo, hi, spare = tree.levels[level]
        if 100 * hi[a] < percent * lo[b] or 100 * hi[b] < percent * lo[a]:
            return
        most = int(np.bitwise_count(ors[a] & ors[b]).sum()) + int(min(spare[a], spare[b]))
        if (100 + percent) * most < percent * (lo[a] + lo[b]):
            return
        (p, q), (u, v) = tree.span(level, a), tree.span(level, b)
        r = alone(p, q)
        if r >= 0 and r == alone(u, v):
            return
        if level == 0:
            leaves(a, b)
            return
        below = len(tree.levels[level - 1][0])
        for x in range(a * tree.FAN, min((a + 1) * tree.FAN, below)):
            for y in range(max(x, b * tree.FAN) if a == b else b * tree.FAN, min((b + 1) * tree.FAN, below)):
                visit(level - 1, x, y)

    visit(len(tree.levels) - 1, 0, 0)
    return links


def verified(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the true links; texts has task, side, doc_id, d1, d2, blob."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        import zstandard

        unz = zstandard.ZstdDecompressor()
        rows = list({(d, d1, d2): (side, d, blob) for side, d, d1, d2, blob in sorted(rows, key=lambda r: r[1])}.values())
        sets, piece, size = [], [], 0
        for i, r in enumerate(rows):  # a few texts at a time
            piece.append(unz.decompress(r[2]))
            size += len(piece[-1])
            if size > SLICE // 2 or i == len(rows) - 1:
                h, first = shingle_sets(*flat(pa.array(piece, pa.large_binary())), n)
                sets += [h[first[k] : first[k + 1]].copy() for k in range(len(piece))]
                piece, size = [], 0
        sides = np.array([r[0] for r in rows])
        got = span_links(sets, None if (sides == sides[0]).all() else sides, percent)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in got], pa.int64()), pa.array([rows[j][1] for _, j in got], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "side", "doc_id", "d1", "d2", "blob")]
            for task, *row in zip(*columns, strict=True):
                if task != key:
                    if len(held) > 1:
                        yield links(held)
                    if len(held) > 100:
                        tidy()
                    key, held = task, []
                held.append(row)
        if len(held) > 1:
            yield links(held)
        tidy()

    return texts.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def packed(docs: DataFrame, n: int, only=None) -> DataFrame:
    """doc_id, digest and the compressed text of each document (of ``only``)."""

    def run(batches):
        import zstandard

        coder = zstandard.ZstdCompressor(level=3)
        for batch in slices(among(batches, only), "text", SLICE):
            data, offs = flat(batch.column("text"))
            d1, d2 = set_digest(*shingle_sets(data, offs, n))
            raw = memoryview(data)
            blobs = pa.array([coder.compress(raw[offs[i] : offs[i + 1]]) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(d1), pa.array(d2), blobs], ["doc_id", "d1", "d2", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, blob binary")


def classes(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; linked when 100 * intersection >= percent * union."""
    own = saved(sketches(docs, n))
    filled = own.where("n_shingles > 0 and doc_id is not null")
    copies = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    placed = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2").distinct().join(copies, ["d1", "d2"])
    placed = saved(placed)  # doc_id, d1, d2, rep, n: narrow rows
    rep_of = placed.select("doc_id", "rep")
    tied = ties(docs, n, percent, frequent(docs, n, own.count()))
    tied = tied.join(rep_of.withColumnsRenamed({"doc_id": "a", "rep": "ra"}), "a").join(rep_of.withColumnsRenamed({"doc_id": "b", "rep": "rb"}), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    trees = saved(connected_components(tied).withColumnsRenamed({"component": "tree"}))
    del tied
    release(docs.sparkSession)  # what the ties have moved
    members = saved(placed.where("doc_id = rep").join(trees, F.col("rep") == F.col("node")).select("doc_id", "d1", "d2", "n", "tree"))
    members = refined(docs, members, n, percent, block)
    blocks = members.groupBy("tree").agg(F.ceil(F.sum("n") / F.lit(block)).alias("blocks"))
    members = members.join(blocks, "tree").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    texts = packed(docs, n, listed(members)).join(members.drop("n"), ["doc_id", "d1", "d2"])
    pair = texts.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64("tree", F.least("mine", "with"), F.greatest("mine", "with"))
    work = pair.select(task.alias("task"), F.when(F.col("mine") <= F.col("with"), 0).otherwise(1).alias("side"), "doc_id", "d1", "d2", "blob")
    links = saved(verified(work, n, percent))  # else its tasks hold a second Python worker each, for the forests, and executors keep those
    # A doc_id of several texts is one document.
    several = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = several.join(rep_of, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    component = connected_components(links.unionByName(same))
    final = placed.join(component, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("_d"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("component", "rep").alias("component"))
    rows = own.join(final, (F.col("doc_id") == F.col("_d")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id stands for its component; texts without shingles all stay."""
    (keep,) = own_names(docs, "keep")
    kept = classes(docs.select("doc_id", "text"), n, percent).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")


def op5_jaccard_join(spark, sf_dir):
    return classes(documents(spark, sf_dir), 3, 90)
