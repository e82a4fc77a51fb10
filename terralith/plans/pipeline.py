"""The engine's stages as a DAG over a catalog of tables: plan, dry run, execution with timings.

A stage is a function (context) -> {table: DataFrame}; tables are written as Parquet at
stage ends and read again by the stages that name them.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..config import Config
from ..functions import ranks
from ..operators import labels, lattice, learn, patches, proximity, raster, similarity, suitability, vector
from ..operators.components import materialise
from ..sources import synthetic

log = logging.getLogger(__name__)

SHARES = ("built", "tree", "crop", "range", "bare", "water")

#: What the tables that come from files must hold; other columns are left behind.
INPUTS = {
    "cover": ("yr", "cell_id", "row", "col", "x", "y", *[f"frac_{k}" for k in (*SHARES, "flooded")], "elev_mean", "slope_mean", "slope_max", "nodata_frac", "protected_frac"),
    "roads": ("line_id", "kind", "seq", "x1", "y1", "x2", "y2"),
    "buildings": ("bldg_id", "area_m2", "building_type", "x", "y"),
}


@dataclass
class Context:
    """files: Parquet paths of all tables in INPUTS; without them the stages run on the synthetic town of n x n cells."""

    spark: SparkSession
    folder: str
    config: Config = field(default_factory=Config)
    n: int = 30
    timings: dict[str, float] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def lattice(self) -> tuple[int, int, float, float]:
        """Rows, columns, left and top of the lattice that the cells of the cover lie on, also where it has gaps."""
        half = (F.col("row") + 0.5) * self.config.cell, (F.col("col") + 0.5) * self.config.cell
        by_id = F.max(F.when(F.col("row") > 0, (F.col("cell_id") - F.col("col")) / F.col("row")))
        got = self.read("cover").agg(F.max("row") + 1, F.coalesce(by_id, F.max("col") + 1).cast("long"), F.min(F.col("x") - half[1]), F.max(F.col("y") + half[0])).first()
        if got[0] is None:
            raise ValueError("the cover holds no cells")
        return tuple(got)

    def cell_of(self) -> Column:
        """The cell of a point (x, y)."""
        rows, cols, left, top = self.lattice()
        return lattice.cell_of(F.col("x"), F.col("y"), rows, cols, self.config.cell, left, top)


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[Context], dict[str, DataFrame]]


def cover(c: Context) -> dict[str, DataFrame]:
    """Cover of every year, roads and buildings, from files or of the synthetic town, which has even slopes within a cell and nothing protected."""
    if c.files:
        return {name: _input(c, name) for name in INPUTS}
    stack = None
    for year in synthetic.RADIUS:
        part = synthetic.town(c.spark, c.n, year).withColumns({"yr": F.lit(year), "slope_max": F.col("slope_mean"), "protected_frac": F.lit(0.0)})
        stack = part if stack is None else stack.unionByName(part)
    return {"cover": stack, "roads": synthetic.roads(c.spark, c.n, c.config.years.latest), "buildings": synthetic.buildings(c.spark, c.n, c.config.years.baseline)}


def _input(c: Context, name: str) -> DataFrame:
    if name not in c.files:
        raise ValueError(f"no file for {name!r}")
    df = c.spark.read.parquet(c.files[name])
    if lacking := [k for k in INPUTS[name] if k not in df.columns]:
        raise ValueError(f"{c.files[name]} lacks {', '.join(lacking)}")
    df = df.select(*INPUTS[name])
    if name == "cover":
        y = c.config.years
        asked = {y.baseline, y.confirm, *y.train_end, y.latest_confirm, y.latest}
        there = {r[0] for r in df.where(F.col("yr").isin(*asked)).select("yr").distinct().collect()}  # a row a year asked for
        if asked - there:
            raise ValueError(f"{c.files[name]} lacks the years {sorted(asked - there)}")
        return contracts.require_unique(df, ["yr", "cell_id"])
    return df


def features(c: Context) -> dict[str, DataFrame]:
    cell, cfg = c.config.cell, c.config
    out = None
    segments = c.read("roads")
    metres = vector.length_per_cell(segments, c.cell_of())
    for year in (cfg.years.baseline, cfg.years.latest):
        t = c.read("cover").where(F.col("yr") == year)
        radii = {str(r): raster.ring_cells(r, cell) for r in cfg.ring_radii}
        rings = raster.ring_means(t.withColumnsRenamed({f"frac_{k}": k for k in ("built", "tree", "crop", "range", "bare", "water")}), ["built", "tree", "crop", "range", "bare", "water"], radii)
        q = t.select("cell_id", "x", "y")
        near = lambda name, pts: proximity.nearest_point(q, pts, cfg.distance_cap).select("cell_id", F.log1p("distance").alias(name))
        built = near("log_dist_built", t.where("frac_built >= 0.5").select("x", "y"))
        water = near("log_dist_water", t.where("frac_water >= 0.5").select("x", "y"))
        line = lambda name, s: proximity.nearest_line(q, s, cfg.distance_cap).select("cell_id", F.log1p("distance").alias(name))
        disk = raster.disk_sums(t.select("cell_id", "row", "col").join(metres, "cell_id", "left").fillna(0.0, ["metres"]), "metres", raster.ring_cells(cfg.density_radius, cell))
        density = disk.select("cell_id", (F.col("disk") / 1000 / (F.col("disk_n") * (cell / 1000) ** 2)).alias("road_density"))
        table = rings.select("cell_id", "row", "col", "x", "y", "built", "tree", "water", "crop", "range", "bare", "frac_flooded", "nodata_frac", "elev_mean", "slope_mean", "slope_max", *[f"ring{r}_{k}" for r in radii for k in ("built", "tree", "crop", "range", "bare", "water")])
        for part in (built, water, line("log_dist_major", segments.where("kind = 'major'")), line("log_dist_any", segments), density):
            table = table.join(part, "cell_id")
        table = table.withColumn("yr", F.lit(year))
        out = table if out is None else out.unionByName(table)
    return {"features": out}


def label(c: Context) -> dict[str, DataFrame]:
    y = c.config.years
    named = {"baseline": y.baseline, "confirm": y.confirm, "train1": y.train_end[0], "train2": y.train_end[1], "latest_confirm": y.latest_confirm, "latest": y.latest}
    grown = labels.growth(labels.yearly(c.read("cover"), named), c.config.built_share, c.config.open_share)
    base = c.read("cover").where(F.col("yr") == y.baseline).select("cell_id", (F.col("frac_water") + F.col("frac_flooded")).alias("wet_frac"), "slope_mean", "nodata_frac", "protected_frac")
    mask = labels.exclusion(base, c.config.max_excluded, c.config.max_slope, c.config.max_nodata, c.config.max_excluded)
    return {"labels": grown.join(mask.select("cell_id", "excluded"), "cell_id"), "exclusion": mask}


def score(c: Context) -> dict[str, DataFrame]:
    """Similarity to cells with buildings, and a weighted overlay, each as a model of scores."""
    year = c.config.years.baseline
    t = c.read("features").where(F.col("yr") == year)
    usable = c.read("labels").where("not excluded and candidate").select("cell_id")
    refs = vector.reference_cells(c.read("buildings").withColumn("cell_id", c.cell_of())).select("cell_id", F.lit(True).alias("is_ref"))
    inputs = [k for k in t.columns if k.startswith(("ring", "log_dist"))] + ["elev_mean", "slope_mean", "road_density"]
    profile = t.select("cell_id", F.array(*[F.col(i).cast("double") for i in inputs]).alias("z")).join(refs, "cell_id", "left").fillna(False, ["is_ref"])
    profile = profile.join(usable.withColumn("usable", F.lit(True)), "cell_id", "left").fillna(False, ["usable"])
    z = similarity.standardise(profile, F.col("is_ref") | F.col("usable"))
    knn = ranks.rescale(similarity.knn_distance(z.where("usable"), z.where("is_ref"), c.config.knn_k), "distance").select(F.lit("knn").alias("model"), "cell_id", "score")
    criteria = suitability.mcda_criteria(t.withColumnsRenamed({k: f"frac_{k}" for k in ("range", "bare", "crop", "tree", "built", "water")}), c.config.mcda_slope, c.config.mcda_road, c.config.mcda_built, c.config.mcda_water)
    mcda = criteria.join(usable, "cell_id", "left_semi").select(F.lit("mcda").alias("model"), "cell_id", suitability.weighted(suitability.default_weights()).alias("score"))
    distance = t.join(usable, "cell_id", "left_semi").select(F.lit("distance").alias("model"), "cell_id", (-F.col("log_dist_built")).alias("score"))
    return {"scores": knn.unionByName(mcda).unionByName(distance)}


def clusters(c: Context) -> dict[str, DataFrame]:
    """Cells of the latest year in k clusters of cover and slope, numbered by built-up share, with the class of each cluster's means."""
    cfg, named = c.config, {k: F.col(f"frac_{k}") for k in (*SHARES, "flooded")}
    cells = c.read("cover").where((F.col("yr") == cfg.years.latest) & (F.col("nodata_frac") <= cfg.max_nodata)).select("cell_id", "slope_mean", *[v.alias(k) for k, v in named.items()])
    inputs = [*named, "slope_mean"]
    z = materialise(learn.assembled(learn.scaled(cells, inputs), inputs).select("cell_id", "features"))
    found = materialise(learn.kmeans(z, cfg.k, cfg.seed).transform(z).select("cell_id", F.col("prediction").alias("cluster")).join(cells, "cell_id"))
    means = found.groupBy("cluster").agg(*[F.avg(k).alias(k) for k in inputs])
    cls, flag = labels.cluster_class({k: F.col(k) for k in named}, F.col("slope_mean"), cfg.rule_water, cfg.rule_built, cfg.rule_tree, cfg.rule_slope, cfg.cropland_usable)
    ruled = means.select("cluster", cls.cast("long").alias("class_3"), flag.alias("flag")).join(labels.order_clusters(found), "cluster")
    return {"clusters": found.select("cell_id", "cluster").join(F.broadcast(ruled), "cluster").select("cell_id", F.col("cluster_id").cast("long").alias("cluster_id"), "class_3", "flag")}  # a row a cluster


def combine(c: Context) -> dict[str, DataFrame]:
    """The weight of similarity against the overlay that ranks growth best, and the scores it gives."""
    by = {m: c.read("scores").where(F.col("model") == m).select("cell_id", F.col("score").alias(m)) for m in ("knn", "mcda")}
    cells = materialise(by["knn"].join(by["mcda"], "cell_id").join(c.read("labels").where("candidate and not ambiguous").select("cell_id", "grew"), "cell_id", "left"))
    steps = round(1 / c.config.weight_step)
    weights = materialise(suitability.combine(cells, ["knn", "mcda"], [i / steps for i in range(steps + 1)], "grew"))
    best = suitability.best_weight(weights).select("weight")
    ranked = ranks.pct_rank(ranks.pct_rank(cells, "knn", out="_a"), "mcda", out="_b")
    score = F.round(F.col("weight") * F.col("_a") + (1 - F.col("weight")) * F.col("_b"), 12)
    return {"weights": weights, "combined": ranked.crossJoin(F.broadcast(best)).select("cell_id", score.alias("score"))}  # one row


def sites(c: Context) -> dict[str, DataFrame]:
    s = c.read("scores").where("model = 'knn'")
    classes = ranks.quantile_classes(s, "score", c.config.class_quantiles)
    best = classes.where("class = 1").join(c.read("features").where(F.col("yr") == c.config.years.latest).select("cell_id", "row", "col"), "cell_id")
    labelled = best.join(patches.patches(best, c.lattice()[1]), "cell_id")
    area = c.config.cell**2
    return {"classes": classes, "candidates": suitability.sites(patches.patch_stats(labelled, "score", area), c.config.min_site / 1e4, c.config.top_sites, c.config.top_site_area / 1e4)}


def validate(c: Context) -> dict[str, DataFrame]:
    y = c.read("labels").where("candidate and not ambiguous").select("cell_id", "grew")
    scored = c.read("scores").join(y, "cell_id")
    return {"auc": ranks.auc(scored, "grew", "score", ["model"]), "top": ranks.top_n(scored, "grew", "score", [0.1, 0.3], ["model"]), "toc": ranks.toc_curve(scored, "grew", "score", ["model"])}


STAGES = (
    Stage("cover", (), ("cover", "roads", "buildings"), cover),
    Stage("features", ("cover", "roads"), ("features",), features),
    Stage("labels", ("cover",), ("labels", "exclusion"), label),
    Stage("scores", ("cover", "features", "labels", "buildings"), ("scores",), score),
    Stage("clusters", ("cover",), ("clusters",), clusters),
    Stage("combine", ("scores", "labels"), ("weights", "combined"), combine),
    Stage("sites", ("cover", "scores", "features"), ("classes", "candidates"), sites),
    Stage("validate", ("scores", "labels"), ("auc", "top", "toc"), validate),
)


def plan(tables: set[str] | None = None, have: set[str] | None = None) -> list[Stage]:
    """The stages that make the tables (all, if none are named) of those that are there, each after what it needs."""
    maker = {t: s for s in STAGES for t in s.gives}
    made, out = set(have or ()), []

    def make(table: str) -> None:
        if table in made:
            return
        if table not in maker:
            raise ValueError(f"no stage gives {table!r}")
        for t in maker[table].needs:
            make(t)
        if maker[table] not in out:
            out.append(maker[table])
        made.update(maker[table].gives)

    for t in maker if tables is None else sorted(tables):
        make(t)
    return out


def run(context: Context, tables: set[str] | None = None, have: set[str] | None = None, dry: bool = False) -> dict[str, float]:
    """Runs the stages in order and returns seconds by stage; the first failure ends it."""
    for stage in plan(tables, have):
        log.info("%s: %s -> %s", stage.name, ", ".join(stage.needs) or "-", ", ".join(stage.gives))
        if dry:
            continue
        began = time.perf_counter()
        for name, df in stage.run(context).items():
            df.write.mode("overwrite").parquet(f"{context.folder}/{name}")
        context.timings[stage.name] = time.perf_counter() - began
    return context.timings
