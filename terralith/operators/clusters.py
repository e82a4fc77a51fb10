"""The scan of k-means and Gaussian mixtures over k, on distinct rows with their counts.

While distinct rows are of a checked size (``VALUES``) they go to every task and whole fits are dealt out;
beyond, rows stay spread out and one pass over them moves all fits a step, with sums to the driver only.
Both ways read every row and share each formula.  K-means starts by k-means++, mixtures from a k-means fit;
covariances are full, with ``FLOOR`` added to variances, since shares of few pixels often lie on a plane.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import materialise

#: Values (distinct rows by columns and their count) up to which rows go to every task.
VALUES = 8_000_000
#: Rows that a step looks at together.
CHUNK = 16_384
#: Added to the variances of mixtures, of columns with deviation 1.
FLOOR = 1e-6
STEPS = 100


def squares(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def seeds(z: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++: the best of a few rows drawn by squared distance; fewer than k where rows are."""
    found = [z[min(np.searchsorted(w.cumsum(), rng.random() * w.sum(), "right"), len(z) - 1)]]
    near = squares(z - found[0])
    while len(found) < k and near.any():
        mass = (w * near).cumsum()
        best = None
        for i in np.searchsorted(mass, rng.random(2 + int(math.log(k))) * mass[-1], "right"):
            i = min(i, len(z) - 1)
            now = np.minimum(near, squares(z - z[i]))
            if best is None or w @ now < best[0]:
                best = w @ now, i, now
        found.append(z[best[1]])
        near = best[2]
    return np.array(found)


class Fit:
    """A fit in steps: ``sums`` over rows add up, ``move`` takes them; ``score`` is the cost, or the log likelihood."""

    def __init__(self, method: str, k: int, start: int, seed: int):
        self.method, self.k, self.rng = method, k, [seed, k, start, int(method == "gmm")]
        self.phase, self.step, self.still, self.score = "means", 0, False, None

    def begin(self, z: np.ndarray, w: np.ndarray) -> Fit:
        self.mean = seeds(z, w, self.k, np.random.default_rng(self.rng))
        return self

    def _log(self, z: np.ndarray) -> np.ndarray:
        """Logarithms of components' weighted densities, a row a component."""
        out = np.empty((len(self.mean), len(z)))
        for j, (m, c) in enumerate(zip(self.mean, self.cov, strict=True)):
            low = np.linalg.cholesky(c)
            v = (z - m) @ np.linalg.inv(low).T
            out[j] = math.log(self.share[j]) - 0.5 * (z.shape[1] * math.log(2 * math.pi) + squares(v)) - np.log(np.diag(low)).sum()
        return out

    def label(self, z: np.ndarray) -> np.ndarray:
        if self.phase == "means" or self.method == "kmeans":
            return np.stack([squares(z - m) for m in self.mean]).argmin(0)
        return self._log(z).argmax(0)

    def sums(self, z: np.ndarray, w: np.ndarray) -> tuple:
        """Score, and by cluster weight, sums and (mixtures) products of what rows differ from its mean by."""
        k, d = self.mean.shape
        if self.phase == "means":
            at = self.label(z)
            gap = z - self.mean[at]
            first = np.stack([np.bincount(at, w * gap[:, i], k) for i in range(d)], 1)
            if self.method == "kmeans" or not self.still:
                return w @ squares(gap), np.bincount(at, w, k), first, 0.0
            part = (at == np.arange(k)[:, None]).astype(float)
            total = 0.0
        else:
            part = self._log(z)
            top = part.max(0)
            part = np.exp(part - top)
            all_ = part.sum(0)
            total = w @ (top + np.log(all_))
            part /= all_
        part *= w
        first, second = np.empty((k, d)), np.empty((k, d, d))
        for j in range(k):
            gap = z - self.mean[j]
            first[j] = part[j] @ gap
            second[j] = (gap * part[j][:, None]).T @ gap
        return total, part.sum(1), first, second

    def move(self, sums: tuple) -> bool:
        """Whether the fit has ended; its score is then of the parameters it keeps."""
        total, weight, first, second = sums
        if self.phase == "means" and not (self.method == "gmm" and self.still):
            if self.still or self.step == STEPS:
                if self.method == "kmeans":
                    self.score = total
                    return True
                self.still = True  # the next sums are a mixture's first
                return False
            by = first / np.where(weight > 0, weight, 1)[:, None]
            self.mean = self.mean + by
            self.step += 1
            self.still = bool(((by * by).sum(1) <= 1e-12).all())
            return False
        if self.phase == "means":
            self.phase, self.step = "mixture", 0
        elif self.step == STEPS or (self.score is not None and abs(total - self.score) <= 1e-4):
            self.score = total
            return True
        else:
            self.score, self.step = total, self.step + 1
        weight = weight + 10 * np.finfo(float).eps
        by = first / weight[:, None]
        self.mean = self.mean + by
        self.cov = second / weight[:, None, None] - by[:, :, None] * by[:, None, :] + FLOOR * np.eye(by.shape[1])
        self.share = weight / weight.sum()
        return False


def added(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else tuple(x + y for x, y in zip(a, b, strict=True))


def whole(z: np.ndarray, w: np.ndarray, job: Callable) -> tuple:
    """A job's sums over all rows, a chunk at a time."""
    out = None
    for i in range(0, len(z), CHUNK):
        out = added(out, job(z[i : i + CHUNK], w[i : i + CHUNK]))
    return out


def centres(fit: Fit, z: np.ndarray, w: np.ndarray) -> tuple:
    """Weights and sums of rows by label."""
    at, k = fit.label(z), len(fit.mean)
    return np.bincount(at, w, k), np.stack([np.bincount(at, w * z[:, i], k) for i in range(z.shape[1])], 1)


def spreads(fit: Fit, mean: np.ndarray, z: np.ndarray, w: np.ndarray) -> tuple:
    """Sums of distances to the mean of the label."""
    at = fit.label(z)
    return (np.bincount(at, w * np.sqrt(squares(z - mean[at])), len(fit.mean)),)


def means(sums: tuple) -> np.ndarray:
    return sums[1] / np.where(sums[0] > 0, sums[0], 1)[:, None]


def davies_bouldin(weight: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> float | None:
    """As ``labels.davies_bouldin``: empty clusters and pairs without a gap do not count; None without pairs."""
    has = weight > 0
    mean, s, worst = mean[has], spread[has] / weight[has], []
    for i in range(len(mean)):
        gap = np.sqrt(squares(mean - mean[i]))
        if (gap > 0).any():
            worst.append(((s + s[i])[gap > 0] / gap[gap > 0]).max())
    return float(np.mean(worst)) if worst else None


def silhouette(x: np.ndarray, count: np.ndarray, label: np.ndarray) -> float:
    """The mean silhouette of rows that come ``count`` times, as ``learn.silhouette``."""
    names, at = np.unique(label, return_inverse=True)
    size, out = np.bincount(at, count), 0.0
    if len(names) < 2:
        return 0.0
    member = np.zeros((len(x), len(names)))
    member[np.arange(len(x)), at] = count
    step = max(1, 2_000_000 // len(x))
    for i in range(0, len(x), step):
        gap = np.zeros((len(x[i : i + step]), len(x)))
        for c in x.T:
            gap += (c[i : i + step, None] - c) ** 2
        sums, own = np.sqrt(gap) @ member, at[i : i + step]
        r = np.arange(len(own))
        a = sums[r, own] / np.maximum(size[own] - 1, 1)
        b = sums / size
        b[r, own] = np.inf
        b = b.min(1)
        most = np.maximum(a, b)
        out += count[i : i + step] @ np.where((size[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)
    return float(out / count.sum())


def dealt(spark, work: list, job: Callable) -> list:
    """The job's answers, a task for each piece of work."""
    shared = spark.sparkContext.broadcast(pickle.dumps(work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(job(pickle.loads(shared.value)[i]))], pa.binary())], ["i", "out"])

    got = spark.range(0, len(work), 1, len(work)).mapInArrow(run, "i long, out binary").toArrow()
    shared.unpersist()
    out = dict(zip(got.column("i").to_pylist(), got.column("out").to_pylist(), strict=True))
    return [pickle.loads(out[i]) for i in range(len(work))]


def matrix(part: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(part.column(c)) for c in columns], 1)


class Held:
    """Rows that every task has: a task runs a whole fit."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.spark, got = rows.sparkSession, rows.toArrow()  # of checked size
        z, w = matrix(got, columns), got.column("_n").to_numpy().astype(float)
        order = np.lexsort(z.T[::-1])  # draws do not depend on the order of the shuffle
        self.shared = self.spark.sparkContext.broadcast((z[order], w[order]))

    def fit(self, fits: list[Fit], first: tuple) -> list[Fit]:
        shared = self.shared

        def run(fit: Fit) -> Fit:
            z, w = shared.value
            fit.begin(z, w)
            while not fit.move(whole(z, w, fit.sums)):
                pass
            return fit

        return dealt(self.spark, fits, run)

    def index(self, fits: list[Fit]) -> list[float | None]:
        shared = self.shared

        def run(fit: Fit) -> float | None:
            z, w = shared.value
            sums = whole(z, w, lambda a, b: centres(fit, a, b))
            mean = means(sums)
            return davies_bouldin(sums[0], mean, whole(z, w, lambda a, b: spreads(fit, mean, a, b))[0])

        return dealt(self.spark, fits, run)

    def close(self) -> None:
        self.shared.unpersist()


class Spread:
    """Rows that stay where they are: a pass moves all fits that have not ended."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.rows, self.columns = rows, columns

    def run(self, jobs: list) -> list[tuple]:
        """The sums of each job, a pair of function and arguments before the rows."""
        shared, columns = self.rows.sparkSession.sparkContext.broadcast(pickle.dumps(jobs)), self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            jobs = pickle.loads(shared.value)
            sums: list = [None] * len(jobs)
            for batch in batches:
                if batch.num_rows:
                    z, w = matrix(batch, columns), batch.column("_n").to_numpy().astype(float)
                    sums = [added(s, job(*args, z, w)) for s, (job, args) in zip(sums, jobs, strict=True)]
            if sums[0] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], ["out"])

        out: list = [None] * len(jobs)
        for part in self.rows.mapInArrow(run, "out binary").collect():  # sums by cluster, a row a task
            out = [added(a, b) for a, b in zip(out, pickle.loads(part.out), strict=True)]
        shared.unpersist()
        return out

    def fit(self, fits: list[Fit], first: tuple) -> list[Fit]:
        live = [f.begin(*first) for f in fits]
        while live:
            live = [f for f, s in zip(live, self.run([(Fit.sums, (f,)) for f in live]), strict=True) if not f.move(s)]
        return fits

    def index(self, fits: list[Fit]) -> list[float | None]:
        sums = self.run([(centres, (f,)) for f in fits])
        mean = [means(s) for s in sums]
        spread = self.run([(spreads, (f, m)) for f, m in zip(fits, mean, strict=True)])
        return [davies_bouldin(s[0], m, t[0]) for s, m, t in zip(sums, mean, spread, strict=True)]

    def close(self) -> None:
        pass


def scan(z: DataFrame, columns: list[str], ks: list[int], seed: int, starts: int, sample: int, key: str = "cell_id") -> tuple[int, list[tuple]]:
    """Rows, and of each k and method its best fit by score, silhouette of ``sample`` rows and Davies-Bouldin index; z is scaled."""
    spark = z.sparkSession
    rows = materialise(z.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    distinct, n, *odd = rows.agg(F.count(F.lit(1)), F.sum("_n"), *[F.count(F.when(F.isnull(c) | F.isnan(c) | (F.abs(c) == math.inf), 1)) for c in columns]).first()
    if any(odd):
        raise ValueError(f"not a finite number in every row: {', '.join(c for c, o in zip(columns, odd, strict=True) if o)}")
    if not distinct:
        return 0, []
    some = z.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample).select(*columns).toArrow()
    x, count = np.unique(matrix(some, columns), axis=0, return_counts=True)
    count = count.astype(float)
    held = (Held if distinct * (len(columns) + 1) <= VALUES else Spread)(rows, columns)
    fits = [Fit(method, k, i, seed) for k in sorted(ks, reverse=True) for method, n in (("gmm", min(starts, 2)), ("kmeans", starts)) for i in range(n)]  # the longest first
    best: dict = {}
    for f in held.fit(fits, (x, count)):
        old = best.get((f.k, f.method))
        if old is None or (f.score > old.score if f.method == "gmm" else f.score < old.score):
            best[f.k, f.method] = f
    chosen = [best[k, method] for k in ks for method in ("kmeans", "gmm")]
    shared = spark.sparkContext.broadcast((x, count))
    smooth = dealt(spark, chosen, lambda f: silhouette(*shared.value, f.label(shared.value[0])))
    out = list(zip(chosen, smooth, held.index(chosen), strict=True))
    held.close()
    shared.unpersist()
    return n, out
