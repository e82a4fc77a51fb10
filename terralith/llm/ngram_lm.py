"""Scores texts with an interpolated modified Kneser-Ney n-gram model over words.

A text is its words, lower-cased in A-Z, and one end; ``order - 1`` start marks
stand before it.  A word's probability is
``(c - D(c)) / C + g * p'`` at each order, with the discounts D of counts 1, 2 and
3 or more, the context's total C, its share g of all that is discounted, and p'
of the next lower order; below the words' own distribution all known words and one
unknown one are alike.  The highest order counts n-grams, lower ones the distinct
words before them.

1. Slices of texts send their distinct n-grams, with counts of the training texts, to the
   shard of the context's hash.  A shard adds them up, sends what its types say
   of the next lower order to that order's shards, and is saved in the shared
   folder: sorted hashes of contexts, hashes of last words sorted within them, and
   counts.  Discounts come from sums over shards.
2. A worker that has a shard maps its sorted arrays (the number of the context above the
   hash of the last word) into memory and finds the n-grams it is asked for by binary search.
   Counts go back to the slice's texts in the order of the questions, and the
   slice interpolates.  The unigram baseline is answered beside it, from exact counts.
   A corpus that is learned from and scored asks where it is counted, in one exchange
   (``scored``); a model that is kept (``train``) answers any other texts (``scores``).

Nothing is cut off, the model grows with the corpus, and no worker holds more of it than a
shard: shards are of bounded size and as many as the corpus needs.  A context that a
third of all texts hold has as many n-grams as words follow it, since slices send
distinct ones.

Words are told apart by 64 bits of a hash in the baseline and by 48 in n-grams, where two words
would have to agree after the same context.

Results in unusual cases: null and empty texts are one end; a null doc_id
counts as crc32 0, in training; rows that repeat a doc_id are rows of their own;
without training texts every probability is 1, that of the one unknown word; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, saved
from .substring_dedup import _split, bucket_of, get, put
from .text import U64, flat, mix, pack, slices, tidy, unpack, word_bounds, word_hashes
from .toxicity import remainder

ORDER = 2
#: Bytes of text in a slice, and bytes of text whose n-grams a shard holds.
SLICE = 8 << 20
SHARD = 12 << 20
HELD_OUT, REMAINDER = 7, 2
START, END = (int(mix(np.array([x], U64))[0]) for x in (0x57A7, 0xE0D))
#: Bytes of a word's hash in n-grams.
WIDTH = 6
UPPER = U64(((1 << 8 * WIDTH) - 1) << (64 - 8 * WIDTH))
GRAMS, WORDS, TEXT, ANSWER, MODEL = range(5)
SCHEMA = "level int, key long, kind int, who long, blob binary"


class Slice:
    """The n-grams of the texts of one slice, distinct ones sorted by the hashes of context and word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, order: int):
        starts, ends, first = word_bounds(data, offs)
        n = np.diff(first)
        rows = len(n)
        self.n = n + 1
        # Start marks, words and the end of each text one after another.
        self.row = np.repeat(np.arange(rows, dtype=np.int32), self.n)
        begin = np.cumsum(n + order) - (n + order)
        words = np.full(int((n + order).sum()), START, U64)
        words[np.repeat(begin + order - 1 - first[:-1], n) + np.arange(len(starts))] = word_hashes(data, starts, ends, lower=True)
        words[begin + order - 1 + n] = END
        self.words = words
        self.at = np.repeat(begin + order - 1 - (np.cumsum(self.n) - self.n), self.n) + np.arange(len(self.row))
        self.types, self.number = np.unique(words[self.at], return_inverse=True)

    def contexts(self, k: int) -> np.ndarray:
        """Hashes of the k - 1 words before each word and end; their upper bits, as they are sent."""
        if k == 2:
            return self.words[self.at - 1] & UPPER
        with np.errstate(over="ignore"):
            h = np.full(len(self.at), k, U64)
            for j in range(k - 1, 0, -1):
                h = mix(h * U64(0x9E3779B97F4A7C15) ^ self.words[self.at - j])
        return h & UPPER

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts; numbers of context and word of each distinct n-gram; and the n-gram at each word and end."""
        contexts, of = np.unique(self.contexts(k), return_inverse=True)
        types, which = np.unique(of.astype(np.int64) * len(self.types) + self.number, return_inverse=True)
        return contexts, types // len(self.types), types % len(self.types), which


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["level", "key", "kind", "who", "blob"])


def tight(rising: np.ndarray) -> np.ndarray:
    """Rising 64-bit integers as differences, in as many bytes as the largest needs."""
    d = np.diff(rising, prepend=U64(0))
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return np.frombuffer(bytes([width]) + pack(d, width), np.uint8)


def untight(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(unpack(raw[1:].tobytes(), int(raw[0])), dtype=U64)


def packed_grams(contexts: np.ndarray, of: np.ndarray, last: np.ndarray, counts: np.ndarray, lower: list[np.ndarray]) -> bytes:
    """contexts: sorted; of: each n-gram's, sorted; last: hashes of last words; lower: hashes of its shorter contexts, longest first."""
    head = put(tight(contexts >> U64(64 - 8 * WIDTH)), np.bincount(of, minlength=len(contexts)).astype("<u4"), counts.astype("<i8"))
    return head + b"".join(pack(x >> U64(64 - 8 * WIDTH), WIDTH) for x in (last, *lower)) + np.array([len(of), len(lower)], "<u8").tobytes()


def unpacked_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts, n-grams of each, hashes of last words, counts, shorter contexts; hashes in their upper bits."""
    size, more = (int(x) for x in np.frombuffer(blob[-16:], "<u8"))
    cut = len(blob) - 16 - size * WIDTH * (1 + more)
    contexts, n, counts = get(blob[:cut], "u1", "<u4", "<i8")
    parts = [unpack(blob[cut + i * size * WIDTH : cut + (i + 1) * size * WIDTH], WIDTH) << U64(64 - 8 * WIDTH) for i in range(1 + more)]
    return untight(contexts) << U64(64 - 8 * WIDTH), n, parts[0], counts, parts[1:]


def gram_keys(of: np.ndarray, last: np.ndarray, contexts: int) -> np.ndarray:
    """The number of the context above as many bits of the word's hash as there is room for."""
    bits = U64(max(1, int(contexts).bit_length()))
    return (of.astype(U64) << (U64(64) - bits)) | (last >> bits)


def emitted(level: int, who: int | None, shards: int, contexts, of, last, counts, lower) -> list[tuple]:
    """Rows of n-grams by the shard of their context: contexts of a shard follow one another."""
    rows = []
    for b, at in _split(bucket_of(contexts, shards)):
        a, z = np.searchsorted(of, [at[0], at[-1] + 1])
        rows.append((level, b, GRAMS, who, packed_grams(contexts[at[0] : at[-1] + 1], of[a:z] - at[0], last[a:z], counts[a:z], [x[a:z] for x in lower])))
    return rows


def sent(docs: DataFrame, order: int, level: int, shards: int, asking: bool) -> DataFrame:
    """Distinct n-grams of slices, of level 1 words, by shard, with their counts in training texts; these alone unless the slices ask for counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offs = flat(batch.column("text"))
            who = slice_id(batch, data) if asking else None
            s = Slice(data, offs, order)
            training = np.repeat(~np.asarray(batch.column("held_out")), s.n)
            if level == 1:
                n = np.bincount(s.number, training, len(s.types)).astype("<i8")
                yield batch_of([(1, b, WORDS, who, put(tight(s.types[at]), n[at])) for b, at in _split(bucket_of(s.types, shards))])
                continue
            contexts, of, word, which = s.grams(level)
            n, lower = np.bincount(which, training, len(of)), []
            if level < order:  # counted by the shards of the next higher level
                n[:] = 0
            elif order > 2:
                place = np.empty(len(of), np.int64)
                place[which] = np.arange(len(which))
                lower = [s.contexts(k)[place] for k in range(order - 1, 1, -1)]
            yield batch_of(emitted(level, who, shards, contexts, of, s.types[word], n, lower))
            tidy()
        tidy()

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT) == REMAINDER).alias("held_out"), "text")
    return (rows if asking else rows.where("not held_out")).mapInArrow(run, SCHEMA)


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[tuple]]:
    """The rows (level, key, kind, who, blob) of each value of a column that they are sorted by."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("level", "key", "kind", "who", "blob")]
        for value, *row in zip(columns[("level", "key", "kind", "who").index(by)], *columns, strict=True):
            if value != now and held:
                yield held
                held = []
            now = value
            held.append(tuple(row))
    if held:
        yield held


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == c).sum()) for c in (1, 2, 3, 4)]


def sum_grams(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts; the context, hash of the last word, count and shorter contexts of each distinct n-gram that was counted."""
    more = max(len(p[4]) for p in parts)
    parts = sorted(parts, key=lambda p: -len(p[4]))  # what only asks has no shorter contexts and comes last
    contexts, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    of = np.repeat(of, np.concatenate([p[1] for p in parts]))
    last = np.concatenate([p[2] for p in parts])
    keys, at, which = np.unique(gram_keys(of, last, len(contexts)), return_index=True, return_inverse=True)
    n = np.bincount(which, np.concatenate([p[3] for p in parts]), minlength=len(keys)).astype(np.int64)
    at, n = at[n > 0], n[n > 0]
    some, number = np.unique(of[at], return_inverse=True)
    return contexts[some], number, last[at], n, [np.concatenate([p[4][i] for p in parts if p[4]])[at] for i in range(more)]


def summed(parts: DataFrame, level: int, shards: int) -> DataFrame:
    """Kind MODEL: the level's shards; GRAMS: what they say of the next lower level; ANSWER: to slices that ask; ``stats``: counts of counts, total and types, of words too."""

    def words(key: int, rows: list[tuple]) -> tuple[list[tuple], list[int]]:
        more = [get(r[4], "<u8", "<i8") for r in rows if r[2] == GRAMS]
        raw = [(untight(t), n) for t, n in (get(r[4], "u1", "<i8") for r in rows if r[2] == WORDS)]
        arrays, stats = [], []
        for got in (more, raw):
            hashes, which = np.unique(np.concatenate([np.zeros(0, U64), *(x[0] for x in got)]), return_inverse=True)
            n = np.bincount(which, np.concatenate([np.zeros(0, np.int64), *(x[1] for x in got)]), minlength=len(hashes)).astype(np.int64)
            arrays += [hashes[n > 0], n[n > 0]]
            stats += [*counts_of_counts(n), int(n.sum()), int((n > 0).sum())]
        return [(1, key, MODEL, None, put(tight(arrays[0]), arrays[1].astype("<i8"), tight(arrays[2]), arrays[3].astype("<i8")))], stats

    def grams(key: int, rows: list[tuple]) -> tuple[list[tuple], list[int]]:
        contexts, of, last, n, lower = sum_grams([unpacked_grams(r[4]) for r in rows])
        out = [(level, key, MODEL, None, packed_grams(contexts, of, last, n, []))]
        if level == 2:  # of unigrams
            types, which = np.unique(last, return_inverse=True)
            more = np.bincount(which, minlength=len(types)).astype("<i8")
            out += [(1, b, GRAMS, None, put(types[at], more[at])) for b, at in _split(bucket_of(types, shards))]
        elif len(of):
            short, of_short = np.unique(lower[0], return_inverse=True)
            order = np.lexsort((last, of_short))
            o, w = of_short[order], last[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
            at = np.flatnonzero(new)
            out += emitted(level - 1, None, shards, short, o[at], w[at], np.diff(np.append(at, len(o))), [x[order][at] for x in lower[1:]])
        return out, [*counts_of_counts(n), int(n.sum()), len(n), *[0] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "key"):
            out, stats = (words if level == 1 else grams)(rows[0][1], rows)
            if any(r[3] is not None for r in rows):
                shard = Shard(level, out[0][4])
                out += [(level, r[1], ANSWER, r[3], shard.answer(r[4])) for r in rows if r[3] is not None]
                del shard
            batch = batch_of(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([stats] + [None] * (len(out) - 1), pa.list_(pa.int64()))], [*batch.schema.names, "stats"])
            del out, rows, batch
            tidy()

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SCHEMA + ", stats array<long>")


def discounts_of(n: np.ndarray) -> np.ndarray:
    """Of counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n = np.asarray(n, float)
    if not (n > 0).all():
        return np.array([0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.05, [0.95, 1.95, 2.95])


@dataclass
class Model:
    """shards: rows of kind MODEL by level; discounts by level; of unigrams the total and the share discounted; N and V of the baseline."""

    order: int
    n_shards: int
    shards: DataFrame
    discounts: dict[int, np.ndarray]
    unigrams: int
    spare: float
    tokens: int
    types: int


def learned(docs: DataFrame, order: int, asking: bool) -> tuple[Model, DataFrame]:
    """The model of the training texts, its shards in the shared folder; and answers to all texts, if they ask."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, size // SHARD)
    rows, stats, above = None, {}, None
    for level in range(order, 0, -1):
        parts = sent(docs, order, level, shards, asking) if asking or level in (order, 1) else None
        parts = above if parts is None else parts if above is None else parts.unionByName(above)
        got = saved(summed(parts, level, shards))
        sums = got.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(12)]).first()
        stats[level] = list(sums)
        got = got.drop("stats")
        rows = got if rows is None else rows.unionByName(got)
        above = got.where((F.col("kind") == GRAMS) & (F.col("level") == level - 1))
        release(docs.sparkSession)
    d = {k: discounts_of(s[:4]) for k, s in stats.items()}
    one = stats[1]
    spare = float(d[1] @ [one[0], one[1], one[5] - one[0] - one[1]]) / one[4] if one[4] else 1.0
    return Model(order, shards, rows.where(F.col("kind") == MODEL), d, one[4], spare, one[10], one[11]), rows.where(F.col("kind") == ANSWER)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    return learned(docs, order, False)[0]


def slice_id(batch: pa.RecordBatch, data: np.ndarray) -> int:
    h = hashlib.blake2b(data, digest_size=8)
    h.update(repr(batch.column("doc_id").to_pylist()).encode() + repr(np.diff(flat(batch.column("text"))[1]).tolist()).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file without a name, mapped into memory: the system drops pages that a worker does not use."""
    with tempfile.TemporaryFile() as f:
        for a in arrays:
            f.write(a.tobytes() + b"\0" * 8)
        f.flush()
        out, at = [], 0
        for a in arrays:
            out.append(np.memmap(f, a.dtype, "r", at, (len(a),)) if len(a) else a)
            at += a.nbytes + 8
    return out


def found(table: np.ndarray, values: np.ndarray, asked_: np.ndarray) -> np.ndarray:
    """The values of the hashes asked for, 0 where the sorted table lacks them."""
    if not len(table):
        return np.zeros(len(asked_), np.int64)
    at = np.minimum(np.searchsorted(table, asked_), len(table) - 1)
    return np.where(table[at] == asked_, values[at], 0)


class Shard:
    """A shard's arrays, mapped, and what it answers: of n-grams the count, of each context the total and the numbers of counts; of words both counts."""

    def __init__(self, level: int, blob: bytes | None):
        self.level = level
        if blob is None:
            self.arrays = [np.zeros(0, x) for x in ("<u8", "<i8", "<u8", "<i8")] if level == 1 else [np.zeros(0, "<u8")] * 2 + [np.zeros(0, "<i8")] * 5
        elif level == 1:
            more, more_n, raw, raw_n = get(blob, "u1", "<i8", "u1", "<i8")
            self.arrays = mapped([untight(more), more_n, untight(raw), raw_n])
        else:
            contexts, size, last, n, _ = unpacked_grams(blob)
            of = np.repeat(np.arange(len(contexts)), size)
            sums = [np.bincount(of, w, minlength=len(contexts)).astype("<i8") for w in (n, n == 1, n == 2, n > 2)]
            self.arrays = mapped([contexts, gram_keys(of, last, len(contexts)), n, *sums])

    def answer(self, blob: bytes) -> bytes:
        if self.level == 1:
            more, more_n, raw, raw_n = self.arrays
            words = untight(get(blob, "u1", "<i8")[0])
            return put(found(raw, raw_n, words), found(more, more_n, words & UPPER))
        contexts, n, last, _, _ = unpacked_grams(blob)
        table, keys, counts, *sums = self.arrays
        if not len(table):
            return put(*[np.zeros(x, "<i8") for x in (len(last), *[len(contexts)] * 4)])
        at = np.minimum(np.searchsorted(table, contexts), len(table) - 1)
        known = table[at] == contexts
        got = np.where(np.repeat(known, n), found(keys, counts, gram_keys(np.repeat(at, n), last, len(table))), 0)
        return put(got.astype("<i8"), *[np.where(known, x[at], 0).astype("<i8") for x in sums])


def answered(docs: DataFrame, model: Model) -> DataFrame:
    """Answers to the slices of other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shard = None
        for batch in batches:  # a shard's own row comes first, so that questions need not be held
            rows = []
            for level, key, kind, who, blob in zip(*(batch.column(c).to_pylist() for c in ("level", "key", "kind", "who", "blob")), strict=True):
                if (level, key) != now:
                    now, shard = (level, key), Shard(level, blob if kind == MODEL else None)
                if kind != MODEL:
                    rows.append((level, key, ANSWER, who, shard.answer(blob)))
            if rows:
                yield batch_of(rows)
        tidy()

    both = model.shards
    for level in range(1, model.order + 1):
        both = both.unionByName(sent(docs, model.order, level, model.n_shards, True))
    first = F.when(F.col("kind") == MODEL, 0).otherwise(1)
    return both.repartition("level", "key").sortWithinPartitions("level", "key", first).mapInArrow(run, SCHEMA)


def texts(docs: DataFrame) -> DataFrame:
    """Each slice's rows, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offs = flat(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            yield batch_of([(0, 0, TEXT, slice_id(batch, data), put(np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_null()), np.asarray(batch.column("held_out")), offs.astype("<i8"), data))])
        tidy()

    return docs.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT) == REMAINDER).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts - np.concatenate([[0.0], d])[np.minimum(counts, 3)]


def interpolated(docs: DataFrame, model: Model, answers: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; perplexity a token is 10 ** (-score / n_tokens)."""
    order, d, total, spare, tokens, types = model.order, model.discounts, model.unigrams, model.spare, model.tokens, model.types

    def finish(blob: bytes, answers: dict[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
        ids, null, held, offs, data = get(blob, "<i8", "?", "?", "<i8", "u1")
        s = Slice(data, offs, order)
        told = {k: [np.concatenate(x) for x in zip(*(get(b, *["<i8"] * (2 if k == 1 else 5)) for _, b in sorted(v)), strict=True)] for k, v in answers.items()}
        raw, more = told[1]
        base = np.log10((raw + 1) / (tokens + types + 1))[s.number]
        known = (raw > 0)[s.number]
        p = (discounted(more, d[1]) / max(total, 1) + spare / (types + 1))[s.number]
        for k in range(2, order + 1):
            contexts, of, _, which = s.grams(k)
            n, all_, *few = told[k]
            some = np.maximum(all_, 1)
            seen = (all_ > 0)[of]
            alpha = np.where(seen, discounted(n, d[k]) / some[of], 0.0)
            share = np.where(seen, (d[k] @ np.array(few))[of] / some[of], 1.0)
            p = alpha[which] + share[which] * p
        at = np.cumsum(s.n) - s.n
        m = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(held), pa.array(s.n.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.full(m, tokens)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "who"):
            answers: dict[int, dict[int, bytes]] = {}
            for level, key, kind, _, blob in rows:
                if kind == ANSWER:
                    answers.setdefault(level, {})[key] = blob
            for _, _, kind, _, blob in rows:  # slices of equal rows share their answers
                if kind == TEXT:
                    yield finish(blob, {k: list(v.items()) for k, v in answers.items()})
                    tidy()

    both = texts(docs).unionByName(answers)
    return both.repartition("who").sortWithinPartitions("who").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Any texts by a model, with the columns of ``interpolated``."""
    return interpolated(docs, model, answered(docs, model))


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The texts by the model of their own training part."""
    model, answers = learned(docs, order, True)
    return interpolated(docs, model, answers)


def op7_ngram_lm(spark, sf_dir):
    return scored(documents(spark, sf_dir))
