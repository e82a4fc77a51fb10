"""Polygons as arrays of points, cut, repaired and overlaid: rows in, rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import shoelace

POINTS = "array<struct<x:double,y:double>>"


def _half(ring: Column, side: Column) -> Column:
    """The part of a ring on one side of a line: of side's axis, above its bound for sign 1 and below it for -1."""

    def along(p: Column) -> Column:
        return F.when(side.by_x, p.x).otherwise(p.y)

    def inside(p: Column) -> Column:
        return side.sign * (along(p) - side.bound) >= 0

    def cross(p: Column, q: Column) -> Column:
        share = F.coalesce(F.try_divide(side.bound - along(p), along(q) - along(p)), F.lit(0.0))
        x, y = p.x + share * (q.x - p.x), p.y + share * (q.y - p.y)
        return F.struct(F.when(side.by_x, side.bound).otherwise(x).alias("x"), F.when(side.by_x, y).otherwise(side.bound).alias("y"))

    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    none = F.array().cast(POINTS)
    steps = F.zip_with(before, ring, lambda p, q: F.when(inside(q), F.when(inside(p), F.array(q)).otherwise(F.array(cross(p, q), q))).when(inside(p), F.array(cross(p, q))).otherwise(none).cast(POINTS))
    return F.flatten(steps).cast(POINTS)


def cut_ring(ring: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The ring inside a box, empty if nothing is: one side after another, each worked out once."""
    sides = [F.struct(F.lit(by_x).alias("by_x"), bound.cast("double").alias("bound"), F.lit(sign).alias("sign")) for by_x, bound, sign in ((True, left, 1), (True, right, -1), (False, bottom, 1), (False, top, -1))]
    return F.aggregate(F.array(*sides), ring.cast(POINTS), _half)


def cut(df: DataFrame, left: Column, bottom: Column, right: Column, top: Column, ring: str = "ring") -> DataFrame:
    """The rings inside a box of each row's own; those with nothing in it go, by their bounds before they are cut."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    near = df.where((F.array_max(xs) >= left) & (F.array_min(xs) <= right) & (F.array_max(ys) >= bottom) & (F.array_min(ys) <= top))
    return near.withColumn(ring, cut_ring(F.col(ring), left, bottom, right, top)).where(F.size(ring) >= 3)


def overlap_by(cells: DataFrame, polygons: DataFrame, cell: float, by: str, ring: str = "ring") -> DataFrame:
    """by, area: how much of the polygons lies in each group of cells (x, y at their centres); polygons may not overlap each other.

    A polygon meets the cells that its bounds cover, as rows of the lattice's own numbers.
    """
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    dealt = polygons.select(ring).repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a file's rows become many times as many
    spread = dealt.select(ring, F.explode(span(F.array_min(xs), F.array_max(xs))).alias("_i"), ys.alias("_y")).select(ring, "_i", F.explode(span(F.array_min("_y"), F.array_max("_y"))).alias("_j"))
    own = cells.select(by, F.floor(F.col("x") / cell).alias("_i"), F.floor(F.col("y") / cell).alias("_j"))
    pieces = cut(spread, F.col("_i") * cell, F.col("_j") * cell, (F.col("_i") + 1) * cell, (F.col("_j") + 1) * cell, ring)
    inside = pieces.groupBy("_i", "_j").agg(F.sum(shoelace(F.col(ring))).alias("_area"))  # a row a cell: rings don't travel
    return inside.hint("merge").join(own, ["_i", "_j"]).groupBy(by).agg(F.sum("_area").alias("area"))  # cells may be too many for a broadcast


def parts(df: DataFrame, rings: str = "rings", least: float = 0.0) -> DataFrame:
    """One row a part of each multipart geometry, with its place; parts whose area is not above ``least`` go."""
    out = df.select(*[c for c in df.columns if c != rings], F.posexplode(rings).alias("part", "ring"))
    return out.withColumn("area", shoelace(F.col("ring"))).where(F.col("area") > least)


def _loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Simple rings of a ring that crosses or touches itself: crossings become points, and the walk is cut where it comes back to one."""
    points = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    n = len(points)
    on: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in range(n)]
    for i in range(n):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % n]
        for j in range(i + 1, n):
            (cx, cy), (dx, dy) = points[j], points[(j + 1) % n]
            if max(ax, bx) < min(cx, dx) or max(cx, dx) < min(ax, bx):
                continue
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if not turn:
                continue
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
            if 0 <= t <= 1 and 0 <= u <= 1:
                at = (ax + t * (bx - ax), ay + t * (by - ay))
                at = next((p for p in (points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]) if abs(p[0] - at[0]) + abs(p[1] - at[1]) < 1e-9), at)
                on[i].append((t, at))
                on[j].append((u, at))
    walk: list[tuple[float, float]] = []
    for p, extra in zip(points, on, strict=True):
        for q in (p, *(q for _, q in sorted(extra))):
            if not walk or q != walk[-1]:
                walk.append(q)
    out, open_, place = [], [], {}
    for p in [*walk, *walk[:1]]:
        if p in place:
            loop = open_[place[p] :]
            for q in loop[1:]:
                place.pop(q, None)
            del open_[place[p] + 1 :]
            if len(loop) > 2:
                out.append(loop)
        else:
            place[p] = len(open_)
            open_.append(p)
    return out


def valid(df: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """key, part, ring: each ring as simple rings that run counter-clockwise, without repeated points or empty area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, rings = [], [], []
            for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = 0
                for loop in _loops([(p["x"], p["y"]) for p in r or [] if p["x"] is not None and p["y"] is not None]):
                    area = sum(a * d - c * b for (a, b), (c, d) in zip(loop, loop[1:] + loop[:1], strict=True))
                    if area:
                        keys.append(k)
                        places.append(part)
                        rings.append([{"x": x, "y": y} for x, y in (loop if area > 0 else loop[::-1])])
                        part += 1
            kinds = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(rings, kinds)], [key, "part", ring])

    return df.select(key, F.col(ring).cast(POINTS)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, part int, {ring} {POINTS}")


def outlines(sides: DataFrame, patch: str = "patch") -> DataFrame:
    """patch, ring: the boundary rings, holes too, of patches of lattice cells, in columns and rows, from their boundary edges.

    sides: patch, x1, y1, x2, y2 with the patch on the left.  A patch's boundary, not its cells, is in one task.
    """

    def one(key, table):
        ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("x1", "y1", "x2", "y2")), strict=True):
            ends.setdefault((a, b), []).append((c, d))
        rings = []
        while ends:
            start = min(ends)
            ring, at, came = [start], start, None
            while True:
                there = ends[at]
                # Where two cells touch at a corner the walk turns left, so that each ring stays simple.
                to = there[0] if len(there) == 1 or came is None else max(there, key=lambda q: (at[0] - came[0]) * (q[1] - at[1]) - (at[1] - came[1]) * (q[0] - at[0]))
                there.remove(to)
                if not there:
                    del ends[at]
                came, at = at, to
                if at == start:
                    break
                ring.append(at)
            rings.append([{"x": float(x), "y": float(y)} for i, (x, y) in enumerate(ring) if (x - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - y) != (y - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - x)])
        return pa.table({patch: pa.array([key[0].as_py()] * len(rings), pa.int64()), "ring": pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    return sides.groupBy(patch).applyInArrow(one, f"{patch} long, ring {POINTS}")


def directed_sides(cells: DataFrame, patch: str = "patch") -> DataFrame:
    """The sides of patches' cells (row, col, rows counted downwards) that have no cell of the patch beyond, with the patch on the left."""
    c, r = F.col("col"), F.col("row")
    corners = ((0, 1, 1, 1, "s"), (1, 1, 1, 0, "e"), (1, 0, 0, 0, "n"), (0, 0, 0, 1, "w"))
    sides = cells.select(patch, F.inline(F.array(*[F.struct((c + a).cast("long").alias("x1"), (-(r + b)).cast("long").alias("y1"), (c + d).cast("long").alias("x2"), (-(r + e)).cast("long").alias("y2")) for a, b, d, e, _ in corners])))
    line = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    keyed = sides.withColumns({f"_{i}": x for i, x in enumerate(line)})
    once = keyed.groupBy(patch, "_0", "_1", "_2", "_3").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("s")).where("n = 1")
    return once.select(patch, "s.*")
