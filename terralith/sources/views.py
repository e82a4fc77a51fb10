"""The engine's data model as views of the star-schema tables, in Spark and, word for word, in SQL.

``part`` is the lattice (50 columns), ``lineitem`` a stack of yearly land-cover pixels, ``orders``
building footprints, ``events`` polylines, ``embeddings`` profiles, and ``labels`` with
``documents`` an evaluation set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLS = 50
CELL = 100.0
HEIGHT = 4000
#: Land-cover code by a pixel's hash.
CODES = (0, 1, 2, 4, 5, 5, 8, 11, 10, 11)
YEARS = {"baseline": 1996, "confirm": 1997, "latest_confirm": 2000, "latest": 2001}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey as cell_id", f"p_partkey div {COLS} as row", f"p_partkey % {COLS} as col", f"(p_partkey % {COLS} + 0.5D) * 100 as x", f"-(p_partkey div {COLS} + 0.5D) * 100 as y", "cast(p_size as bigint) as size", f"cast(700 + p_size * 5 + p_partkey div {COLS} as bigint) as elev"
    )


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read(spark, sf_dir, "lineitem").selectExpr("l_partkey as cell_id", "year(l_shipdate) as yr", "(l_suppkey * 7 + l_linenumber * 13 + cast(l_quantity as bigint) * 3) % 10 as h", "l_quantity as v")
    codes = F.array(*[F.lit(c) for c in CODES])
    return h.select("cell_id", "yr", "h", "v", F.when(F.col("h") < 3 * (F.col("yr") - 1995) + 8 - F.col("cell_id") % COLS, 7).otherwise(codes[F.col("h").cast("int")]).alias("code"))


def building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as bldg_id", "o_totalprice / 1000 as area_m2", "o_orderpriority as building_type", "year(o_orderdate) as snapshot", "(o_orderkey * 37 + o_custkey * 11) % 5000 + 0.5D as x", f"-((o_orderkey * 53 + o_custkey * 7) % {HEIGHT} + 0.5D) as y"
    )


def vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id as line_id", "event_id as seq", "cast((user_id * 331) % 4500 + (event_id * 97) % 400 as double) as x", f"-cast((user_id * 173) % {HEIGHT - 400} + (event_id * 61) % 400 as double) as y")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id as cell_id", "transform(embedding, v -> cast(v as double)) as z", "label < 5 as is_ref", "label >= 3 as is_candidate", "label")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "n_chars", "lang"), "doc_id").selectExpr("doc_id as cell_id", "quality = 1 as y", "cast(n_chars + (doc_id * 7) % 13 as double) as score", "lang as kind")


SQL = {
    "cell": f"SELECT p_partkey AS cell_id, p_partkey // {COLS} AS r, p_partkey % {COLS} AS c, (p_partkey % {COLS} + 0.5::DOUBLE) * 100 AS x, -(p_partkey // {COLS} + 0.5::DOUBLE) * 100 AS y, p_size::BIGINT AS size, (700 + p_size * 5 + p_partkey // {COLS})::BIGINT AS elev FROM part",
    "pixel": f"SELECT cell_id, yr, h, v, CASE WHEN h < 3 * (yr - 1995) + 8 - cell_id % {COLS} THEN 7 ELSE [{', '.join(map(str, CODES))}][h + 1] END AS code FROM (SELECT l_partkey AS cell_id, year(l_shipdate) AS yr, (l_suppkey * 7 + l_linenumber * 13 + l_quantity::BIGINT * 3) % 10 AS h, l_quantity AS v FROM lineitem)",
    "building": f"SELECT o_orderkey AS bldg_id, o_totalprice / 1000 AS area_m2, o_orderpriority AS building_type, year(o_orderdate) AS snapshot, (o_orderkey * 37 + o_custkey * 11) % 5000 + 0.5::DOUBLE AS x, -((o_orderkey * 53 + o_custkey * 7) % {HEIGHT} + 0.5::DOUBLE) AS y FROM orders",
    "vertex": f"SELECT user_id AS line_id, event_id AS seq, ((user_id * 331) % 4500 + (event_id * 97) % 400)::DOUBLE AS x, -((user_id * 173) % {HEIGHT - 400} + (event_id * 61) % 400)::DOUBLE AS y FROM events",
    "profile": "SELECT vec_id AS cell_id, embedding::DOUBLE[] AS z, label < 5 AS is_ref, label >= 3 AS is_candidate, label FROM embeddings",
    "evaluation": "SELECT l.doc_id AS cell_id, quality = 1 AS y, (n_chars + (l.doc_id * 7) % 13)::DOUBLE AS score, lang AS kind FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "segment": "SELECT * FROM (SELECT line_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL",
    "frac": "SELECT cell_id, yr, "
    + ", ".join(f"CASE WHEN n_valid > 0 THEN n_{k} / n_valid ELSE 0.0::DOUBLE END AS frac_{k}" for k in ("water", "tree", "flooded", "crop", "built", "bare", "snow", "range"))
    + ", 1 - n_valid / n_all AS nodata_frac FROM (SELECT cell_id, yr, count(*) FILTER (code NOT IN (0, 10)) AS n_valid, count(*) AS n_all, "
    + ", ".join(f"count(*) FILTER (code = {v}) AS n_{k}" for k, v in {"water": 1, "tree": 2, "flooded": 4, "crop": 5, "built": 7, "bare": 8, "snow": 9, "range": 11}.items())
    + " FROM pixel GROUP BY cell_id, yr)",
    "built": "SELECT cell.cell_id, r, c, x, y, size, elev, coalesce(frac_built, 0)::DOUBLE AS built, coalesce(frac_tree, 0)::DOUBLE AS tree, coalesce(frac_water, 0)::DOUBLE AS water FROM cell LEFT JOIN frac ON cell.cell_id = frac.cell_id AND yr = 2001",
}
NEEDS = {"segment": ["vertex"], "frac": ["pixel"], "built": ["cell", "pixel", "frac"]}


def sql(views: str, body: str, **more: str) -> str:
    """A query over the views named and the views they need; ``more`` adds views of its own, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    parts = [f"{v} AS ({SQL[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
