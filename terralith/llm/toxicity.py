"""Toxicity by compression distance with zstandard dictionaries.

Dictionaries are trained by zstandard's own trainer, one on ordinary text and one on
toxic text; both stand behind the same large one of ordinary text, so that words
which any text has cost the same in both.  Every whole text is cut into windows at
word ends; the gain of a window is how many bytes shorter the toxic dictionary
makes it.  Gains at calibrated thresholds are the inputs of a logistic score that is
calibrated, as the thresholds are, on parts of the sample that a dictionary was not trained on.

Most of a toxic text is ordinary.  So training goes in rounds: first on the windows of
each class that the large dictionary compresses worst, then on the windows
of toxic texts that gain and on those of ordinary texts that gain wrongly, as dictionaries of
the other folds tell.  Nothing but compressed lengths chooses what a dictionary is trained on.

Fitting takes a bounded sample of labelled rows (``SAMPLE`` of each class by a
hash of the id, as far as their whole texts have ``SAMPLE_BYTES`` together); scoring
takes every row and whole text and is one scan without a shuffle.

Results in unusual cases: null and empty texts get the score of a text without
gains; a null doc_id counts as held out; without labels of both classes every
score is 0; repeated rows are rows of their own; an empty table gives no rows;
other columns are ignored (``scores``) or kept (``reject``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .text import LOWER, flat, mix, slices, tidy, window_hashes, word_bounds, word_hashes

SAMPLE = 3000
SAMPLE_BYTES = 24 << 20
WINDOW = 32
#: Bytes of text scored at once.
SLICE = 1 << 20
#: Bytes of the large dictionary of ordinary text, and of those of the classes; segments that the trainer picks for them.
DICTIONARY, CLASS = 112 << 10, 4 << 10
SEGMENT, CLASS_SEGMENT = 64, 32
FOLDS, ROUNDS = 4, 3
#: Windows of the first round: this share, those that the large dictionary compresses worst.
HARD = 0.3
#: A window gains if toxic windows reach its gain this many times as often as ordinary ones.
TIMES = 3
HELD_OUT = 5


def remainder(doc_id: Column, mod: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % mod


@dataclass
class Model:
    """common stands before both dictionaries of the classes."""

    common: bytes = b""
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    window: int = WINDOW


def windows(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the windows, and each document's first window (one more at the end)."""
    starts, ends, first = word_bounds(data, offs)
    if not len(starts):
        return starts, ends, np.zeros(len(offs), np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    slot = (starts - offs[doc]) // size
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:] - 1, len(starts) - 1)], np.searchsorted(at, first)


#: Stands at the end of dictionaries and before each window, so that a block always pays for its header.
_CARRIER = (mix(np.arange(40, dtype=np.uint64)) % np.uint64(56) + np.uint64(192)).astype(np.uint8)
_coders: dict = {}


def coder(content: bytes):
    import zstandard as z

    params = z.ZstdCompressionParameters(compression_level=1, window_log=18, hash_log=17, chain_log=17, search_log=6, target_length=0, min_match=5, strategy=z.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
    d = z.ZstdCompressionDict(content + _CARRIER.tobytes(), dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


def coders(model: Model):
    """Compressors with the ordinary dictionary and with the toxic one, both of the same length."""
    key = (hash(model.common), hash(model.ordinary), hash(model.toxic))
    if key not in _coders:
        _coders.clear()
        size = max(len(model.ordinary), len(model.toxic))
        _coders[key] = [coder(model.common + part.rjust(size, b"\xff")) for part in (model.ordinary, model.toxic)]
    return _coders[key]


def lengths(compressor, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Compressed bytes of each window; data is in lower case."""
    if not len(starts):
        return np.zeros(0, np.int64)
    import zstandard as z

    n, c = ends - starts, len(_CARRIER)
    at = np.concatenate([[0], np.cumsum(n + c)])
    buffer, own = np.empty(at[-1], np.uint8), np.ones(at[-1], bool)
    carrier = at[:-1, None] + np.arange(c)
    buffer[carrier], own[carrier] = _CARRIER, False
    buffer[own] = data[np.repeat((starts - np.cumsum(n) + n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
    joined = z.BufferWithSegments(buffer.tobytes(), np.column_stack([at[:-1], n + c]).astype(np.uint64).tobytes())
    return np.array([len(x) for x in compressor.multi_compress_to_buffer(joined)], np.int64)


def gains(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    ordinary, toxic = (lengths(x, LOWER[data], starts, ends) for x in coders(model))
    return ordinary - toxic


THRESHOLDS = (1, 2, 3, 4, 6)


def features(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: windows whose gain reaches each threshold, in all and as a share; all gains as a share."""
    n = np.diff(first)

    def sums(x):
        return np.diff(np.concatenate([[0], np.cumsum(x)])[first])

    some = np.maximum(n, 1)
    columns = [np.log1p(n)]
    for t in THRESHOLDS:
        hits = sums((gain >= t).astype(np.int64))
        columns += [np.log1p(hits), np.sqrt(hits / some)]
    columns.append(np.sqrt(np.maximum(sums(np.maximum(gain, 0)), 0) / some))
    return np.column_stack(columns).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge, classes as they come."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return flat(pa.array(texts, pa.large_binary()))


def distinct(texts: list[bytes], words: int = 4) -> list[bytes]:
    """One of each group of near copies: a text goes if any of three min-hashes of its word runs was there before.

    Else the words of a text that is copied a thousand times would pass for marks of its class.
    """
    kept, seen = [], [set(), set(), set()]
    for t in texts:
        data, offs = _flat([t])
        starts, ends, _ = word_bounds(data, offs)
        if not len(starts):
            continue
        h = window_hashes(word_hashes(data, starts, ends, lower=True), min(words, len(starts)))
        least = [int(mix(h ^ np.uint64(k + 1)).min()) for k in range(3)]
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            kept.append(t)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return kept


def dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """The trainer's; with longer segments where it gives up early."""
    import zstandard as z

    best = b""
    for k in range(segment, 2 * segment, max(1, segment // 4)):
        try:
            best = max(best, z.train_dictionary(size, samples, k=k, d=6).as_bytes(), key=len)
        except z.ZstdError:  # too little text to train on
            break
        if len(best) >= size // 2:
            break
    return best or b"".join(samples)[-size:]


class Fold:
    """Windows of a part of the sample, of toxic texts and of ordinary ones."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], window: int):
        self.sides = []
        for texts in (toxic, ordinary):
            data, offs = _flat(texts)
            self.sides.append((data, *windows(data, offs, window)))
        self.raw = [side[0].tobytes() for side in self.sides]
        self.picked: list[list[bytes]] = [[], []]

    def pick(self, side: int, which: np.ndarray) -> None:
        _, starts, ends, _ = self.sides[side]
        self.picked[side] = [b" " + self.raw[side][a:b] + b" " for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]

    def gains(self, model: Model) -> list[np.ndarray]:
        return [gains(model, *side[:3]) for side in self.sides]


def threshold(toxic: np.ndarray, ordinary: np.ndarray) -> int:
    """The least gain that toxic windows reach TIMES as often."""
    for g in range(1, 24):
        a, b = float((toxic >= g).mean()), float((ordinary >= g).mean())
        if a > 0 and a >= TIMES * b:
            return g
    return max(1, int(np.quantile(toxic, 0.99)))


def fit(toxic: list[bytes], ordinary: list[bytes], window: int = WINDOW, labelled: tuple[int, int] | None = None) -> Model:
    """Dictionaries of all folds, and a score calibrated on each fold with the dictionaries of the others.

    labelled: rows of each class; the score is calibrated to their shares, not to those of the sample.
    """
    toxic, ordinary = ([LOWER[np.frombuffer(t, np.uint8)].tobytes() for t in distinct(side)] for side in (toxic, ordinary))
    if len(toxic) < FOLDS or len(ordinary) < FOLDS:
        return Model()
    folds = [Fold(toxic[k::FOLDS], ordinary[k::FOLDS], window) for k in range(FOLDS)]
    common = dictionary(DICTIONARY, ordinary, SEGMENT)
    for k, fold in enumerate(folds):
        compressor = coder(dictionary(DICTIONARY, [t for j in range(FOLDS) if j != k for t in ordinary[j::FOLDS]], SEGMENT))
        cost = [lengths(compressor, *side[:3]) / (side[2] - side[1] + 8.0) for side in fold.sides]
        least = np.quantile(cost[1], 1 - HARD)
        for side in (0, 1):
            fold.pick(side, np.flatnonzero(cost[side] >= least))

    def trained(of: list[Fold]) -> Model:
        a, b = (dictionary(CLASS, [x for f in of for x in f.picked[side]], CLASS_SEGMENT) for side in (0, 1))
        return Model(common, b, a, window=window)

    for turn in range(ROUNDS + 1):
        found = [fold.gains(trained([f for f in folds if f is not fold])) for fold in folds]
        if turn < ROUNDS:
            for fold, (a, b) in zip(folds, found, strict=True):
                fold.pick(0, np.flatnonzero(a >= threshold(a, b)))
                fold.pick(1, np.flatnonzero(b >= 1))
    x = np.concatenate([features(g, side[3]) for fold, got in zip(folds, found, strict=True) for g, side in zip(got, fold.sides, strict=True)])
    y = np.concatenate([np.full(len(side[3]) - 1, label) for fold in folds for side, label in zip(fold.sides, (1.0, 0.0), strict=True)])
    model = trained(folds)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = logistic((x - model.centre) / model.scale, y)
    if labelled:
        model.weights[0] += math.log(labelled[0] / labelled[1] / (len(toxic) / len(ordinary)))
    return model


def score(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if not len(model.weights):
        return np.zeros(len(offs) - 1)
    a, b, first = windows(data, offs, model.window)
    x = (features(gains(model, data, a, b), first) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -700, 700)))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[bytes], list[bytes], tuple[int, int]]:
    """Training texts of each class, at most ``size`` and ``most`` bytes, chosen by a hash of the id; and how many are labelled."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id"), HELD_OUT) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = {k: [r.doc_id for r in known.where(F.col("toxic") == k).orderBy(*order).limit(size).select("doc_id").collect()] for k in (1, 0)}

    def of(wanted):
        few = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array(wanted, pa.int64())}))  # 2 x ``size`` rows at most; of a list, Python workers of their own would make it
        return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).where(F.col("text").isNotNull())

    length = {r.doc_id: r.n for r in of([*chosen[1], *chosen[0]]).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    taken = {}
    for k, ids in chosen.items():
        total = 0
        for d in ids:
            if d in length and total + length[d] <= most:
                total += length[d]
                taken[d] = k
    texts = sorted((r.doc_id, r.text.encode()) for r in of(list(taken)).select("doc_id", "text").toLocalIterator())
    return [t for d, t in texts if taken[d] == 1], [t for d, t in texts if taken[d] == 0], (there.get(1, 0), there.get(0, 0))


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    toxic, ordinary, labelled = sample(docs, labels, **options)
    return fit(toxic, ordinary, labelled=labelled)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            p = score(model, *flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield batch.filter(pa.array(score(model, *flat(batch.column("text"))) < threshold))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
