"""Clustering scans, random forests with spatially blocked folds, importances, ablation and hold-out checks.

Fits are pyspark.ml's, distributed over rows, but for scans over k (``clusters``) and forests, whose trees are dealt out while
rows fit a task as bytes; the driver holds these, trees, parameters and metrics only.  Out-of-fold scores of all folds are one table, so metrics are one plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import model_inputs
from ..functions import ranks
from . import clusters
from .components import materialise
from .trees import Forest, Trees, drawn


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores with population deviations; constant ones divide by 1."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_{c}.m")) / F.col(f"_{c}.s") for c in columns}).drop(*[f"_{c}" for c in columns])


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def pca_variance(df: DataFrame, columns: list[str], target: float = 0.9) -> tuple[list[float], int]:
    """Explained variance by component, and how many reach the target."""
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(assembled(scaled(df, columns), columns))
    share = model.explainedVariance.toArray()
    return share.tolist(), int(np.searchsorted(np.cumsum(share), target - 1e-12) + 1)


def kmeans(df: DataFrame, k: int, seed: int = 42, starts: int = 10):
    """The best of several seeded starts by training cost; df has ``features``."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=100, tol=1e-6).fit(df) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def gmm(df: DataFrame, k: int, seed: int = 42, starts: int = 2):
    fits = [GaussianMixture(k=k, seed=seed + i, maxIter=100, tol=1e-4).fit(df) for i in range(starts)]
    return max(fits, key=lambda m: m.summary.logLikelihood)


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    return -2 * log_likelihood + ((k - 1) + k * d + k * d * (d + 1) // 2) * math.log(n)


def silhouette(df: DataFrame, cluster: str, columns: list[str], sample: int = 10_000, key: str = "cell_id") -> DataFrame:
    """Mean Euclidean silhouette of at most ``sample`` rows, chosen by a hash of the key.

    The sample is bounded and goes to every task; rows of the sample are dealt out.
    """
    picked = df.select(key, F.col(cluster).cast("int").alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)
    rows = picked.toPandas()
    x, c = np.array(rows.x.tolist(), float).reshape(len(rows), -1), rows.c.to_numpy()
    names, at = np.unique(c, return_inverse=True)
    size = np.bincount(at)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in part.id:
                d = np.sqrt(((x - x[i]) ** 2).sum(1))
                sums = np.bincount(at, d, minlength=len(names))
                own = at[i]
                if size[own] < 2 or len(names) < 2:
                    out.append(0.0)
                    continue
                a = sums[own] / (size[own] - 1)
                b = np.delete(sums / size, own).min()
                out.append((b - a) / max(a, b) if max(a, b) else 0.0)
            yield pd.DataFrame({"s": out})

    return df.sparkSession.range(len(rows)).mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def k_scan(df: DataFrame, columns: list[str], ks: range | tuple, seed: int = 42, starts: int = 10, sample: int = 10_000) -> list[dict]:
    """Cost (mixtures: BIC), silhouette and Davies-Bouldin for each k and method; the last is None without two clusters."""
    rows = materialise(df.select("cell_id", *[F.col(c).cast("double").alias(c) for c in columns]))
    n, found = clusters.scan(scaled(rows, columns), columns, list(ks), seed, starts, sample)
    return [{"k": f.k, "method": f.method, "cost": bic(f.score, n, f.k, len(columns)) if f.method == "gmm" else float(f.score), "silhouette": s, "davies_bouldin": d} for f, s, d in found]


def forest(trees: int = 300, leaf: int = 1, features: str = "sqrt", seed: int = 42, depth: int = 12) -> Forest:
    """Trees grown by tasks over rows as bytes; beyond ``trees.VALUES``, pyspark.ml's over rows spread out."""

    def spread() -> RandomForestClassifier:
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=256, minInstancesPerNode=leaf, featureSubsetStrategy=features, seed=seed)

    return Forest(spread, trees, leaf, features, seed, depth)


def balanced(df: DataFrame, y: str) -> DataFrame:
    """label and weight n / (2 n_class)."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("int")).alias("_p"))
    j = df.crossJoin(F.broadcast(counts)).withColumn("label", F.col(y).cast("double"))
    return j.withColumn("weight", F.when(F.col("label") == 1, F.try_divide(F.col("_n"), 2 * F.col("_p"))).otherwise(F.try_divide(F.col("_n"), 2 * (F.col("_n") - F.col("_p"))))).drop("_n", "_p")


def ranked_features(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns as percentile ranks of values rounded half to even to six digits, within the group: noise becomes ties."""
    for c in columns:
        df = ranks.pct_rank(df.withColumn(c, F.bround(c, 6)), c, by, "_r").withColumn(c, F.col("_r")).drop("_r")
    return df


def probability(model, df: DataFrame) -> DataFrame:
    return model.score(df) if isinstance(model, Trees) else model.transform(df).withColumn("score", vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, columns: list[str], y: str, fold: str = "fold", make: Callable = forest, also: tuple[str, ...] = (), **params) -> tuple[DataFrame, list]:
    """Scores of each row by the model of the other folds, and the models; only of columns that a model may see."""
    model_inputs(columns, also)
    rows = materialise(balanced(assembled(df, columns), y))
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    models, out = [], None
    for f in folds:
        model = make(**params).fit(rows.where(F.col(fold) != f))
        part = probability(model, rows.where(F.col(fold) == f)).select("cell_id", fold, F.col(y), "score")
        models.append(model)
        out = part if out is None else out.unionByName(part)
    return materialise(out), models


def mean_fold_auc(scores: DataFrame, y: str, fold: str = "fold") -> float:
    return ranks.auc(scores, y, "score", [fold]).where("auc is not null").agg(F.avg("auc")).first()[0]


def tune(df: DataFrame, columns: list[str], y: str, leaves: tuple, shares: tuple, **params) -> dict:
    """Parameters of the best mean fold AUC to four digits, the first among equals."""
    return searched(df, columns, y, leaves, shares, **params)[0]


def searched(df: DataFrame, columns: list[str], y: str, leaves: tuple, shares: tuple, **params) -> tuple[dict, DataFrame, list]:
    """What ``tune`` gives, with the out-of-fold scores and the models of these parameters.

    Shares that draw as many of the features grow the same trees from the same seed, so they are grown once.
    """
    df, best, seen = materialise(df), None, set()
    for leaf in leaves:
        for share in shares:
            same = (leaf, share if "make" in params else drawn(share, len(columns)))
            if same in seen:
                continue
            seen.add(same)
            scores, models = out_of_fold(df, columns, y, leaf=leaf, features=share, **params)
            auc = round(mean_fold_auc(scores, y), 4)
            if best is None or auc > best[0]["auc"]:
                best = {"leaf": leaf, "features": share, "auc": auc}, scores, models
    return best


def shuffled(df: DataFrame, column: str, seed: int, repeats: int | None = None) -> DataFrame:
    """The column dealt anew: values in the order of one hash meet rows in the order of another.

    With ``repeats`` the rows come that often, ``repeat`` counting from 0 and each dealt by the seed plus it.
    """
    times = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit((repeats or 1) - 1))))

    def order(side: str) -> list[Column]:
        return [F.md5(F.concat_ws(":", F.concat(F.lit(side), F.lit(seed) + F.col("repeat")), "cell_id")), F.col("cell_id")]

    rows = ranks.row_numbers(times, order("a"), ["repeat"], "_n")
    values = ranks.row_numbers(times.select("repeat", "cell_id", F.col(column).alias("_v")), order("b"), ["repeat"], "_n").select("repeat", "_n", "_v")
    dealt = rows.join(values, ["repeat", "_n"]).withColumn(column, F.col("_v")).drop("_n", "_v")
    return dealt if repeats else dealt.drop("repeat")


def permutation_importance(df: DataFrame, columns: list[str], y: str, models: list, folds: list, repeats: int = 5, fold: str = "fold") -> DataFrame:
    """feature, drop: mean loss of fold AUC when the feature is shuffled, and the models' mean impurity importance."""
    spark, rows = df.sparkSession, []
    for model, f in zip(models, folds, strict=True):
        part = materialise(df.where(F.col(fold) == f))
        base = ranks.auc(probability(model, assembled(part, columns)), y, "score").first().auc
        for i, c in enumerate(columns):
            scored = probability(model, assembled(shuffled(part, c, 31 * i, repeats), columns))
            aucs = {r.repeat: r.auc for r in ranks.auc(scored, y, "score", ["repeat"]).collect()}  # at most a row a repeat
            rows += [(c, (base or 0.5) - (aucs.get(r) or 0.5), float(model.featureImportances.toArray()[i])) for r in range(repeats)]
    return spark.createDataFrame(rows, "feature string, drop double, impurity double").groupBy("feature").agg(F.avg("drop").alias("drop"), F.avg("impurity").alias("impurity"))


def ablation(df: DataFrame, groups: dict[str, tuple], columns: list[str], y: str, **params) -> DataFrame:
    """group, auc, change: the mean fold AUC without each group of features, and its change."""
    base = mean_fold_auc(out_of_fold(df, columns, y, **params)[0], y)
    rows = [("none", base, 0.0)]
    for name, gone in groups.items():
        auc = mean_fold_auc(out_of_fold(df, [c for c in columns if c not in gone], y, **params)[0], y)
        rows.append((name, auc, auc - base))
    return df.sparkSession.createDataFrame(rows, "group string, auc double, change double")


def holdout(df: DataFrame, scorer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], fold: str = "fold", ref: str = "is_ref") -> DataFrame:
    """cell_id, fold, is_ref, percentile: references of a fold scored by those of the others.

    scorer(cells, references, to_score) gives cell_id, score; it never sees the fold's references.
    """
    folds, out = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()], None
    for f in folds:
        there = df.where(F.col(fold) == f)
        part = scorer(df, df.where(F.col(ref) & (F.col(fold) != f)), there).join(there.select("cell_id", fold, ref), "cell_id")
        out = part if out is None else out.unionByName(part)
    return ranks.pct_rank(materialise(out), "score", [fold]).withColumn("percentile", 100 * F.col("pct")).drop("pct")


def scorers(columns: list[str], near: str, fewer: list[str], k: int = 10, also: tuple[str, ...] = (), **params) -> dict[str, Callable]:
    """The four scorers of the hold-out: distance alone, a forest of ranks, and k nearest references of all and of fewer columns."""
    from . import similarity

    kept: list[tuple] = []

    def once(cells: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What depends on the cells alone is made once, not again for each fold."""
        for of, what, made in kept:
            if of is cells and what == name:
                return made
        kept.append((cells, name, materialise(make())))
        return kept[-1][2]

    def distance(cells: DataFrame, refs: DataFrame, there: DataFrame) -> DataFrame:
        return there.select("cell_id", (-F.col(near)).alias("score"))

    def trees(cells: DataFrame, refs: DataFrame, there: DataFrame) -> DataFrame:
        model_inputs(columns, also)
        ranked = once(cells, "ranks", lambda: assembled(ranked_features(cells.select("cell_id", *columns), columns), columns))
        known = refs.select("cell_id", F.lit(1).alias("_ref"))
        train = ranked.join(there.select("cell_id"), "cell_id", "left_anti").join(known, "cell_id", "left").withColumn("_y", F.coalesce("_ref", F.lit(0)))
        model = forest(**params).fit(materialise(balanced(train, "_y").select("features", "label", "weight")))
        return probability(model, ranked.join(there.select("cell_id"), "cell_id", "left_semi")).select("cell_id", "score")

    def nearest(of: list[str]) -> Callable:
        def score(cells: DataFrame, refs: DataFrame, there: DataFrame) -> DataFrame:
            z = once(cells, f"z {of}", lambda: similarity.standardise(cells.select("cell_id", F.array(*[F.col(c).cast("double") for c in of]).alias("z")), F.lit(True)))
            some = similarity.knn_distance(z.join(there.select("cell_id"), "cell_id", "left_semi"), z.join(refs.select("cell_id"), "cell_id", "left_semi"), k)
            return some.select("cell_id", (-F.col("distance")).alias("score"))

        return score

    return {"dist_to_built": distance, "rf": trees, "knn": nearest(columns), "knn_ring500": nearest(fewer)}


def holdout_summary(ranked: DataFrame, by: list[str], fold: str = "fold", ref: str = "is_ref") -> DataFrame:
    """n, median percentile, shares in the top tenth and three tenths of the references, and the AUC within folds' percentiles."""
    one = ranked.where(ref).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("percentile").alias("median"), F.avg((F.col("percentile") > 90).cast("int")).alias("top10"), F.avg((F.col("percentile") > 70).cast("int")).alias("top30"))
    return one.join(ranks.auc(ranked, ref, "percentile", by).select(*by, "auc"), by)


def run_model(train: DataFrame, latest: DataFrame, columns: list[str], y: str, candidate: str, usable: str, leaves: tuple = (1, 5, 20), shares: tuple = ("sqrt", "0.5"), also: tuple[str, ...] = (), **params) -> dict[str, DataFrame]:
    """One model from end to end: validation (out-of-fold scores of candidates), final (scores of usable cells by a fit on all folds),
    importance, and metrics (best parameters, fold AUC, sizes).

    train: features of the baseline year with ``y``, ``fold`` and the candidate flag; latest: those of the last year with the usable flag.
    """
    train = materialise(train)
    best, scored, models = searched(train, columns, y, leaves, shares, also=also, **params)  # the best's own scores, which a second fit would give again
    chosen = {**params, "leaf": best["leaf"], "features": best["features"]}
    folds = [r[0] for r in train.select("fold").distinct().orderBy("fold").collect()]
    final = forest(**chosen).fit(materialise(balanced(assembled(train, columns), y).select("features", "label", "weight")))
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("int")).alias("n_pos")).first()
    spark = train.sparkSession
    return {
        "validation": scored.join(train.where(candidate).select("cell_id"), "cell_id", "left_semi").select("cell_id", "score"),
        "final": probability(final, assembled(latest.where(usable), columns)).select("cell_id", "score"),
        "importance": permutation_importance(train, columns, y, models, folds).orderBy(F.col("drop").desc(), "feature"),
        "metrics": spark.createDataFrame([(best["leaf"], best["features"], best["auc"], len(folds), sizes.n, sizes.n_pos, ",".join(columns))], "leaf int, features string, fold_auc double, n_folds int, n_cells long, n_pos long, columns string"),
    }


def k_sweep(df: DataFrame, columns: list[str], ks: tuple[int, ...], classify: Column, truth: str, seed: int = 42, sample: int = 10_000) -> DataFrame:
    """For each k: silhouette, Davies-Bouldin, the share of each class and the agreement with ``truth``.

    classify: the class of a cluster from the means of its columns.
    """
    from .labels import davies_bouldin

    z = materialise(assembled(scaled(df, columns), columns))
    raw, out = df.select("cell_id", truth, *[F.col(c).alias(f"_{c}") for c in columns]), None
    for k in ks:
        found = materialise(kmeans(z, k, seed).transform(z).select("cell_id", F.col("prediction").alias("cluster"), *columns))
        means = found.select("cell_id", "cluster").join(raw, "cell_id").groupBy("cluster").agg(*[F.avg(f"_{c}").alias(c) for c in columns])
        classed = found.select("cell_id", "cluster").join(F.broadcast(means.select("cluster", classify.alias("class"))), "cluster").join(raw.select("cell_id", truth), "cell_id")
        one = classed.agg(F.lit(k).alias("k"), F.avg((F.col("class") == F.col(truth)).cast("int")).alias("agreement"), *[F.avg((F.col("class") == c).cast("int")).alias(f"share_{c}") for c in (1, 2, 3)])
        one = one.crossJoin(silhouette(found, "cluster", columns, sample).select("silhouette")).crossJoin(davies_bouldin(found, "cluster", columns).select("davies_bouldin"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
