"""File sources: contract tables, score sets, vector layers, rasters, snapshots and the manifest."""

from __future__ import annotations

import functools
import json
import logging
import struct
import time
from contextlib import closing
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, ContractError, validate

log = logging.getLogger(__name__)


def contract_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return validate(spark.read.parquet(path), CONTRACTS[name])


def score_tables(spark: SparkSession, folder: str) -> DataFrame:
    """model, cell_id, score of every score file of a folder, each file or partition a model."""
    df = spark.read.option("basePath", folder).parquet(f"{folder}/*")
    if "model" in df.columns:
        return df.select("model", "cell_id", "score")
    model = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:\.parquet)?(?:/[^/]*)?$", 1)
    return df.select(model.alias("model"), "cell_id", "score")


def missing_scores(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """model, cell_id that a model has no score for."""
    return scores.select("model").distinct().crossJoin(cells.select("cell_id")).join(scores, ["model", "cell_id"], "left_anti")


def in_box(x: Column, y: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Plain comparisons, so that they reach the scan."""
    return (x >= left) & (x <= right) & (y >= bottom) & (y <= top)


def items_of_year(items: DataFrame, year: int, column: str = "id") -> DataFrame:
    """Catalogue items whose id ends in the year or holds it as a part."""
    return items.where(F.col(column).endswith(f"-{year}") | F.col(column).contains(f"_{year}_"))


def mosaic(tiles: DataFrame, keys: list[str], value: str, order: str, first: bool = True) -> DataFrame:
    """One value a pixel where tiles overlap: of the first tile with data, or of the last."""
    known = tiles.where(F.col(value).isNotNull())
    pick = F.min_by if first else F.max_by
    return known.groupBy(*keys).agg(pick(value, order).alias(value))


def layer(spark: SparkSession, paths: dict[str, str], columns: list[str], kinds: tuple[str, ...] = ("Point", "LineString", "Polygon", "MultiPolygon")) -> DataFrame:
    """Features of several GeoJSON files, a file a tag: tags as strings, geometry type and coordinates; the first of each feature stays."""
    from ..operators.vector import keep_first

    schema = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    out = None
    for i, (tag, path) in enumerate(paths.items()):
        rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
        rows = rows.select(F.coalesce(F.col("f.properties")["osm_type"], F.lit("")).alias("osm_type"), F.coalesce(F.col("f.properties")["osm_id"], F.col("f.id")).alias("osm_id"), F.lit(tag).alias("tag"), F.lit(i).alias("tag_no"), "pos", *[F.col("f.properties")[c].alias(c) for c in columns], F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
        rows = rows.where(F.col("geometry_type").isin(list(kinds)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return keep_first(out, ["osm_type", "osm_id"], ["tag_no", "pos"])


def vertices(features: DataFrame, key: str = "osm_id") -> DataFrame:
    """key, ring, seq, x, y of lines and polygons from their coordinates, written as JSON."""
    line = F.from_json("coordinates", "array<array<double>>")
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    parts = F.when(F.col("geometry_type") == "LineString", F.array(line)).when(F.col("geometry_type").isin("Polygon", "MultiLineString"), rings).otherwise(multi)
    return features.select(key, F.posexplode(parts).alias("ring", "p")).select(key, "ring", F.posexplode("p").alias("seq", "v")).select(key, "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def aoi(path: str) -> list[list[tuple[float, float]]]:
    """Rings of the single polygon of a GeoJSON file."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    shapes = [x["geometry"] for x in doc.get("features", [])] if doc.get("type") == "FeatureCollection" else [doc.get("geometry", doc)]
    if len(shapes) != 1 or shapes[0].get("type") not in ("Polygon", "MultiPolygon"):
        raise ContractError(f"{path}: exactly one polygon is needed")
    polygons = [shapes[0]["coordinates"]] if shapes[0]["type"] == "Polygon" else shapes[0]["coordinates"]
    rings = [[(float(x), float(y)) for x, y, *_ in ring[: -1 if ring[0] == ring[-1] else None]] for p in polygons for ring in p]
    if any(len(r) < 3 for r in rings) or any(not (-180 <= x <= 180 and -90 <= y <= 90) for r in rings for x, y in r):
        raise ContractError(f"{path}: not a polygon of longitudes and latitudes")
    return rings


_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FORMS = {(1, 8): 1, (2, 8): 1, (2, 16): 2, (2, 32): 2, (3, 32): 3, (3, 64): 3}


def tiff_array(data: bytes) -> np.ndarray:
    """The first band of a baseline TIFF: strips, not compressed, either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or int(np.frombuffer(data, order + "u2", 1, 2)[0]) != 42:
        raise ValueError("not a TIFF file")
    at = int(np.frombuffer(data, order + "u4", 1, 4)[0])
    tags = {}
    for i in range(int(np.frombuffer(data, order + "u2", 1, at)[0])):
        p = at + 2 + 12 * i
        tag, kind = np.frombuffer(data, order + "u2", 2, p)
        n = int(np.frombuffer(data, order + "u4", 1, p + 4)[0])
        form = {1: "u1", 3: "u2", 4: "u4", 12: "f8"}.get(int(kind))
        if form:
            size = np.dtype(form).itemsize * n
            q = p + 8 if size <= 4 else int(np.frombuffer(data, order + "u4", 1, p + 8)[0])
            tags[int(tag)] = np.frombuffer(data, order + form, n, q)
    if int(tags.get(259, [1])[0]) != 1 or int(tags.get(277, [1])[0]) != 1:
        raise ValueError("only one band that is not compressed can be read")
    bits, sample = int(tags.get(258, [1])[0]), int(tags.get(339, [1])[0])
    dtype = order + _TYPES[sample, bits]
    raw = b"".join(data[int(o) : int(o) + int(n)] for o, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, dtype).reshape(int(tags[257][0]), int(tags[256][0]))


def tiff(array: np.ndarray) -> bytes:
    """A baseline TIFF of one strip, little-endian."""
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    body = np.ascontiguousarray(array.astype(array.dtype.newbyteorder("<"))).tobytes()
    tags = [(256, 4, array.shape[1]), (257, 4, array.shape[0]), (258, 3, array.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, array.shape[0]), (279, 4, len(body)), (339, 3, kind)]
    pad = b"\0" * (len(body) % 2)
    entries = b"".join(np.array([t, k], "<u2").tobytes() + np.array([1, v], "<u4").tobytes() for t, k, v in tags)
    return b"II" + np.array([42], "<u2").tobytes() + np.array([8 + len(body) + len(pad)], "<u4").tobytes() + body + pad + np.array([len(tags)], "<u2").tobytes() + entries + b"\0" * 4


def raster(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """file, pixel_row, pixel_col, value of TIFF files; a file is a task's work, no value is null where it is nodata."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = tiff_array(content).astype(float)
                step = max(1, (1 << 20) // a.shape[1])
                for top in range(0, a.shape[0], step):
                    part = a[top : top + step]
                    r, c = np.indices(part.shape)
                    gone = np.isnan(part) | (part == nodata if nodata is not None else False)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array((r + top).ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(part.ravel(), mask=gone.ravel())], ["file", "pixel_row", "pixel_col", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, pixel_row int, pixel_col int, value double")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stale(manifest: DataFrame, files: DataFrame, extent: str) -> DataFrame:
    """Paths of the manifest that must be fetched again: absent, changed, or of another extent."""
    m = manifest.select("path", F.col("sha256").alias("_sha"), F.col("extent").alias("_extent"))
    j = m.join(files, "path", "left")
    return j.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("_sha")) | (F.col("_extent") != extent)).select("path")


def retry(attempts: int = 3, wait: float = 1.0, on: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """Calls again after attempt x wait seconds."""

    def wrap(f):
        @functools.wraps(f)
        def call(*a, **b):
            for n in range(1, attempts + 1):
                try:
                    return f(*a, **b)
                except on as e:
                    if n == attempts:
                        raise
                    log.warning("attempt %d of %d failed: %s", n, attempts, e)
                    sleep(n * wait)

        return call

    return wrap


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of comma-separated values with a header; its types are read from the values unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def geometry_of(blob: bytes) -> tuple[str, list]:
    """Kind and coordinates of a GeoPackage geometry: its header, then well-known binary."""
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return wkb(blob, 8 + envelope)[:2]


def wkb(raw: bytes, at: int = 0) -> tuple[str, list, int]:
    """Kind, coordinates as in GeoJSON, and the place after them; of heights and measures only that they are skipped."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    flags, kind = code >> 28, code & 0xFFFFFFF
    width = 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3)) + bool(flags & 8) + bool(flags & 4)
    kind %= 1000

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        return n

    def point() -> list[float]:
        nonlocal at
        p = list(struct.unpack_from(f"{order}{width}d", raw, at))
        at += 8 * width
        return p[:2]

    name = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}.get(kind)
    if name is None:
        raise ContractError(f"geometry of kind {kind} is not read")
    if kind == 1:
        return name, point(), at
    if kind == 2:
        return name, [point() for _ in range(count())], at
    if kind == 3:
        return name, [[point() for _ in range(count())] for _ in range(count())], at
    parts = []
    for _ in range(count()):
        _, part, at = wkb(raw, at)
        parts.append(part)
    return name, parts, at


def geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], geometry: bool = True) -> DataFrame:
    """fid, the columns as text, and with ``geometry`` kind and GeoJSON coordinates, of a layer of each file; a file a task, read from memory."""
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    name = '"' + layer.replace('"', '""') + '"'

    def run(batches):
        import sqlite3

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(content)
                    shape = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone() if geometry else None
                    (key,) = next(r[1:2] for r in db.execute(f"PRAGMA table_info({name})") if r[5])
                    found = db.execute(f'SELECT "{key}"{"," if columns else ""} {quoted}{", " + chr(34) + shape[0] + chr(34) if shape else ""} FROM {name} ORDER BY 1')
                    while rows := found.fetchmany(2000):
                        out = [pa.array([r[0] for r in rows], pa.int64())]
                        out += [pa.array([None if r[i + 1] is None else str(r[i + 1]) for r in rows], pa.string()) for i in range(len(columns))]
                        if geometry:
                            shapes = [geometry_of(r[-1]) if shape and r[-1] else (None, None) for r in rows]
                            out += [pa.array([k for k, _ in shapes], pa.string()), pa.array([None if c is None else json.dumps(c) for _, c in shapes], pa.string())]
                        yield pa.RecordBatch.from_arrays(out, ["fid", *columns, *(["kind", "coordinates"] if geometry else [])])

    kinds = ", ".join(["fid long", *[f"`{c}` string" for c in columns], *(["kind string", "coordinates string"] if geometry else [])])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kinds)


def first_answer(mirrors: list[Callable[[], list]], attempts: int = 2, on: tuple[type[Exception], ...] = (OSError,)) -> list:
    """The first answer of the mirrors in turn, each asked ``attempts`` times; an empty one counts once two mirrors give it."""
    empty, failed = 0, None
    for ask in mirrors:
        for _ in range(attempts):
            try:
                got = ask()
            except on as e:
                failed = e
                continue
            if got:
                return got
            empty += 1
            break
        if empty >= min(2, len(mirrors)):
            return []
    raise OSError(f"no mirror answered; {empty} said that there is nothing") from failed
