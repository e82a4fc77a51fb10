"""All parameters of the engine, with their defaults."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

log = logging.getLogger(__name__)

# Codes of the harmonised land-cover classes.
WATER, TREE, FLOODED, CROP, BUILT, BARE, SNOW, CLOUD, RANGE, NODATA = 1, 2, 4, 5, 7, 8, 9, 10, 11, 0
CLASSES = {"water": WATER, "tree": TREE, "flooded": FLOODED, "crop": CROP, "built": BUILT, "bare": BARE, "snow": SNOW, "range": RANGE}
# Codes of the second land-cover product and the class each stands for.
HARMONISED = {10: TREE, 20: RANGE, 30: RANGE, 40: CROP, 50: BUILT, 60: BARE, 70: SNOW, 80: WATER, 90: FLOODED, 95: FLOODED, 100: RANGE}
# Saaty's random index by matrix size.
RANDOM_INDEX = {3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}

# Ease of building by own land cover, and the comparison of criteria (row against column).
COVER_VALUES = {"range": 1.0, "bare": 1.0, "crop": 0.6, "tree": 0.2, "built": 0.0, "water": 0.0, "flooded": 0.0, "snow": 0.0}
MCDA_CRITERIA = ("slope", "road", "built", "water", "cover")
MCDA_MATRIX = (
    (1, "1/2", "1/2", 2, 1),
    (2, 1, 1, 3, 2),
    (2, 1, 1, 3, 2),
    ("1/2", "1/3", "1/3", 1, "1/2"),
    (1, "1/2", "1/2", 2, 1),
)


class ConfigError(ValueError):
    """A parameter that can't be used."""


@dataclass(frozen=True)
class Years:
    baseline: int = 2018
    confirm: int = 2019
    train_end: tuple[int, int] = (2020, 2021)
    latest_confirm: int = 2022
    latest: int = 2023


@dataclass(frozen=True)
class Config:
    """Lengths in metres, slopes in degrees, shares from 0 to 1."""

    seed: int = 42
    cell: float = 100.0
    pixel: float = 10.0
    buffer: float = 3000.0
    years: Years = field(default_factory=Years)
    ring_radii: tuple[int, ...] = (250, 500)
    density_radius: float = 500.0
    distance_cap: float = 3000.0
    max_nodata: float = 0.5
    max_slope: float = 15.0
    max_excluded: float = 0.5
    built_share: float = 0.5
    open_share: float = 0.1
    patch_area: float = 5000.0
    touch: float = 20.0
    k_range: tuple[int, ...] = tuple(range(3, 11))
    k: int = 7
    silhouette_sample: int = 10_000
    rule_water: float = 0.5
    rule_built: float = 0.3
    rule_tree: float = 0.5
    rule_slope: float = 8.0
    cropland_usable: bool = True
    top_n: int = 20
    knn_k: int = 10
    trees: int = 300
    folds: int = 5
    leaf_sizes: tuple[int, ...] = (1, 5, 20)
    feature_shares: tuple[str, ...] = ("sqrt", "0.5")
    importance_repeats: int = 5
    building_area: tuple[float, float] = (10.0, 100_000.0)
    keep_tracks: bool = False
    class_quantiles: tuple[float, float, float] = (0.9, 0.7, 0.4)
    min_site: float = 10_000.0
    top_sites: int = 20
    top_site_area: float = 50_000.0
    weight_step: float = 0.1
    mcda_slope: float = 15.0
    mcda_road: float = 3000.0
    mcda_built: float = 2000.0
    mcda_water: float = 100.0
    block: float = 2000.0

    def __post_init__(self):
        if self.cell % self.pixel:
            raise ConfigError(f"cell {self.cell} is no multiple of the pixel {self.pixel}")
        if not self.years.baseline < self.years.confirm <= self.years.latest_confirm < self.years.latest:
            raise ConfigError(f"years out of order: {self.years}")
        if list(self.class_quantiles) != sorted(self.class_quantiles, reverse=True):
            raise ConfigError("class quantiles must fall")

    def but(self, **changes) -> Config:
        return replace(self, **changes)


# Where a file with sections keeps a field.
SECTIONS = {
    "seed": "project.random_seed", "cell": "grid.cell_size_m", "buffer": "aoi.buffer_m", "block": "validation.spatial_block_m",
    "ring_radii": "features.context_radii_m", "density_radius": "features.road_density_radius_m", "distance_cap": "features.distance_cap_m", "max_nodata": "features.max_nodata_fraction",
    "max_slope": "exclusion.slope_max_deg", "max_excluded": "exclusion.max_excluded_fraction",
    "open_share": "growth.nonbuilt_max", "built_share": "growth.built_min", "patch_area": "growth.lei_min_patch_m2", "touch": "growth.lei_buffer_m",
    "k": "clustering.k", "silhouette_sample": "clustering.silhouette_sample",
    "rule_water": "labeling.water_threshold", "rule_built": "labeling.built_threshold", "rule_tree": "labeling.forest_threshold", "rule_slope": "labeling.steep_natural_slope_deg", "cropland_usable": "labeling.cropland_usable",
    "top_n": "similarity.top_n", "knn_k": "similarity.knn_k",
    "trees": "rf.n_estimators", "folds": "rf.n_folds", "importance_repeats": "rf.permutation_repeats", "leaf_sizes": "rf.param_grid.min_samples_leaf", "feature_shares": "rf.param_grid.max_features",
    "keep_tracks": "vector.keep_tracks", "class_quantiles": "suitability.class_quantiles", "min_site": "suitability.min_patch_area_m2", "top_sites": "suitability.top_n_sites",
    "mcda_slope": "mcda.slope_zero_deg", "mcda_road": "mcda.road_max_m", "mcda_built": "mcda.built_max_m", "mcda_water": "mcda.water_buffer_m",
}
YEAR_NAMES = {"baseline_confirm": "confirm", "change_train_end": "train_end"}


def flat(values: dict) -> dict:
    """Fields by name from a mapping of fields, of sections, or of both; what sections hold beside them is left out, and said in the log."""
    names = {where: name for name, where in SECTIONS.items()}
    out, unknown, todo = {}, [], [("", values)]
    while todo:
        path, part = todo.pop()
        for key, value in part.items():
            where = f"{path}{key}"
            if where in names:
                out[names[where]] = value
            elif not path and key == "years" and isinstance(value, dict):
                out["years"] = {YEAR_NAMES.get(k, k): v for k, v in value.items()}
            elif not path and key in Config.__dataclass_fields__:
                out[key] = value
            elif isinstance(value, dict):
                todo.append((f"{where}.", value))
            elif path:
                log.info("%s has no use here", where)
            else:
                unknown.append(key)
    more = values.get("clustering") if isinstance(values.get("clustering"), dict) else {}
    if {"k_min", "k_max"} <= more.keys():
        out["k_range"] = tuple(range(more["k_min"], more["k_max"] + 1))
    sizes = values.get("vector") if isinstance(values.get("vector"), dict) else {}
    if {"building_min_area_m2", "building_max_area_m2"} <= sizes.keys():
        out["building_area"] = (float(sizes["building_min_area_m2"]), float(sizes["building_max_area_m2"]))
    if "feature_shares" in out:
        out["feature_shares"] = tuple(str(x) for x in out["feature_shares"])
    if isinstance(values.get("suitability"), dict) and "top_site_min_area_ha" in values["suitability"]:
        out["top_site_area"] = values["suitability"]["top_site_min_area_ha"] * 1e4
    if unknown:
        raise ConfigError(f"unknown: {sorted(unknown)}")
    return out


def load(path: str) -> Config:
    """A Config from a YAML mapping of its fields, plain or in sections (``SECTIONS``)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    if not isinstance(values, dict):
        raise ConfigError(f"{path}: not a mapping")
    values = flat(values)
    if "years" in values:
        y = values["years"]
        values["years"] = Years(**{k: tuple(v) if isinstance(v, list) else v for k, v in y.items()})
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
