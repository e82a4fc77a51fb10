"""Sinks: contract tables, lattice images, cell polygons, strict JSON."""

from __future__ import annotations

import json
import math
import struct
from contextlib import closing

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, validate
from .files import tiff


def write_table(df: DataFrame, path: str, contract: str | None = None, by: list[str] | None = None) -> None:
    """Parquet; Spark's committer shows a table only when it is whole."""
    if contract:
        validate(df, CONTRACTS[contract])
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def image_rows(lattice: DataFrame, values: DataFrame, value: str, nodata: float) -> DataFrame:
    """row, cells: each lattice row as an array, nodata where a cell has no value."""
    j = lattice.select("cell_id", "row", "col").join(values.select("cell_id", value), "cell_id", "left")
    return j.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce(F.col(value).cast("double"), F.lit(float(nodata))).alias("v")))).alias("c")).select("row", F.transform("c", lambda x: x.v).alias("cells"))


def image_tiff(rows: DataFrame, dtype: str = "f4") -> bytes:
    """The rows as a TIFF; a row at a time comes to the driver, for images that fit a map."""
    lines = [np.array(r.cells) for r in rows.orderBy("row").toLocalIterator()]
    return tiff(np.vstack(lines).astype(dtype)) if lines else tiff(np.zeros((1, 1), dtype))


def square(x: Column, y: Column, cell: float) -> Column:
    """The cell's outline as WKT."""
    h = cell / 2
    corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("decimal(18,2)"), b.cast("decimal(18,2)")) for a, b in corners]), F.lit("))"))


def feature(x: Column, y: Column, cell: float, properties: list[str]) -> Column:
    """The cell as a GeoJSON feature."""
    h = cell / 2
    ring = F.array(*[F.array(a, b) for a, b in ((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h))])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))


def strict_json(document) -> str:
    """JSON without NaN or infinities: they become null."""

    def clean(x):
        if isinstance(x, float):
            return x if math.isfinite(x) else None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x

    return json.dumps(clean(document), allow_nan=False, sort_keys=True)


def leaves(document, path: str = "") -> dict[str, object]:
    """Leaf values of a document by path, for comparing documents."""
    if isinstance(document, dict):
        return {k: v for name, x in document.items() for k, v in leaves(x, f"{path}/{name}").items()}
    if isinstance(document, list):
        return {k: v for i, x in enumerate(document) for k, v in leaves(x, f"{path}/{i}").items()}
    return {path: document}


def write_metrics(df: DataFrame, path: str, run: str) -> None:
    """Metrics of one run, in place of those it had; other runs stay."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def differing_leaves(a: DataFrame, b: DataFrame, key: str, document: str, tolerance: float = 1e-9) -> DataFrame:
    """key, path, left, right: leaves of two tables' JSON objects (one level of names) that differ by more than the tolerance."""
    def leaves_of(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col(key), F.explode(F.from_json(document, "map<string,string>")).alias("path", side))

    both = leaves_of(a, "left").join(leaves_of(b, "right"), [key, "path"], "full")
    near = F.abs(F.expr("try_cast(left as double)") - F.expr("try_cast(right as double)")) <= tolerance
    return both.where(~(F.col("left").eqNullSafe(F.col("right")) | F.coalesce(near, F.lit(False))))


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header, a file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def geopackage(rows: DataFrame, layer: str, cell: float, epsg: int, properties: list[str]) -> bytes:
    """A GeoPackage of cell squares round x, y, which the driver writes from a stream of rows; for reports, not for large tables."""
    import sqlite3

    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    types = dict(rows.dtypes)
    with closing(sqlite3.connect(":memory:")) as db:
        db.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
        )
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{epsg}", epsg, epsg))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, epsg))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '1970-01-01T00:00:00Z', NULL, NULL, NULL, NULL, ?)", (layer, layer, epsg))
        names = ", ".join(f'"{p}" {kinds.get(types[p], "TEXT")}' for p in properties)
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{", " + names if names else ""})')
        marks = ", ".join("?" * (len(properties) + 1))
        columns = ", ".join(['"geom"', *[f'"{p}"' for p in properties]])

        def square_of(x: float, y: float) -> bytes:
            h = cell / 2
            corners = ((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h))
            return b"GP" + struct.pack("<BBi", 0, 1, epsg) + struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *c) for c in corners)

        found = rows.select("x", "y", *[F.col(p).alias(f"_{p}") for p in properties]).toLocalIterator()
        db.executemany(f'INSERT INTO "{layer}" ({columns}) VALUES ({marks})', ((square_of(r[0], r[1]), *r[2:]) for r in found))
        db.commit()
        return db.serialize()
