"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / quality weight``; its source
takes whole epochs first and then, in key order, documents until the token
budget of the fraction is spent.  The last one is taken in part, so that a
source's words meet its target exactly.

A source may hold most rows.  Keys are therefore cut into buckets of equal
probability; bucket totals (partial aggregation, a bounded number of rows for a
source) tell which bucket holds the end of the budget, and only that bucket's
rows are sorted and prefix-summed.  What is known of a source meets its rows by broadcast, as long
as there are at most 10,000 sources, so that a large one is not brought together.

Results in unusual cases: null or empty text has size 0 and is never taken; a
null source is a source of its own, last in order; a null quality weight counts
as 1; rows that repeat a doc_id are rows of their own, ties go by key, doc_id
and size; an empty table gives no rows; other columns are ignored (``plan_mix``)
or kept (``mix``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, n_words, own_names, saved, small, uniform_bits

SEED = 17
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
#: Rows of a source meant for a bucket of keys; what one task sorts.
BUCKET_ROWS = 5_000


def key_of(doc_id: Column, weight: Column, seed: int) -> Column:
    u = (uniform_bits(F.lit(str(seed)), doc_id) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(totals: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals: one row per source with ``source``, ``source_size``; adds ``target``.

    The budget is shared by weight; a target stops at max_epochs times the
    source's size and what is over is shared again (water filling, solved in
    closed form over sources sorted by cap / weight: the first that is not
    capped has the common level).
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ordered = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("w")).alias("target"))


def plan_mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = SEED, weights=WEIGHTS, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken.

    quality: ``doc_id`` and ``weight`` (> 0), one row a doc_id; documents without one weigh 1.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("_q"), F.col("weight").cast("double").alias("_w"))
        rows = rows.join(q, rows.doc_id == q._q, "left").drop("_q")
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    key = key_of(F.col("doc_id"), F.greatest(F.coalesce("_w", F.lit(1.0)), F.lit(1e-9)), seed)
    rows = saved(rows.withColumn("key", key).drop("_w"))  # narrow: the texts are read once
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = targets(totals.select("source", "source_size"), weights, share, max_epochs)
    plan = plan.join(totals.select(F.col("source").alias("_s"), "n_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_epochs)), F.floor(F.rint("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.rint("target").cast("long") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(bucket_rows)))).select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest", "buckets")
    plan = small(plan)
    same = F.col("source").eqNullSafe(F.col("_s"))
    keyed = rows.join(plan, same).drop("_s").withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    # The bucket in which the rest of the budget ends: one row a source and bucket, then one row a source.
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"), F.max("rest").alias("b_rest"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("b_before", F.coalesce(F.sum("b_size").over(up_to), F.lit(0)))
    ends = ends.where("b_before < b_rest and b_before + b_size >= b_rest").select(F.col("source").alias("_s"), F.col("bucket").alias("e_bucket"), "b_before")
    keyed = keyed.join(small(ends), same, "left").drop("_s")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    whole = keyed.where("e_bucket is null or bucket <> e_bucket").select(*columns, (F.col("size") * (F.col("epochs") + F.when(F.col("bucket") < F.col("e_bucket"), 1).otherwise(0))).alias("taken"))
    cut = keyed.where("bucket = e_bucket")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("b_before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = cut.withColumn("extra", F.least(F.col("size"), F.greatest(left, F.lit(0)))).select(*columns, (F.col("size") * F.col("epochs") + F.col("extra")).alias("taken"))
    return whole.unionByName(cut).withColumn("taken", F.col("taken").cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each whole
    copy, and once more with its first words (joined by one space, n_chars to
    match) if it is taken in part.  Documents that share a doc_id and a source
    and differ in text are taken by their own sizes.
    """
    key, size_, total, same, own, take, text_ = own_names(docs, "key", "size_", "total", "same", "own", "take", "text_")

    def key_of_row(size):
        return F.to_json(F.struct("doc_id", "source", size.alias("size")))

    # The plan's own columns are named here, so that columns of ``docs`` can't meet them.
    plan = plan_mix(docs.select("doc_id", "source", "text"), **options).where("taken > 0").groupBy(key_of_row(F.col("size")).alias(key)).agg(F.sum("taken").alias(total), F.count(F.lit(1)).alias(same))
    rows = docs.withColumn(size_, n_words(F.col("text")))
    joined = rows.withColumn(key, key_of_row(F.col(size_))).join(plan, key)
    # Repeated rows share what they take: each its whole part, the first the remainder.
    nth = F.row_number().over(Window.partitionBy(key).orderBy("text"))
    each = F.floor(F.col(total) / F.col(same))
    joined = joined.withColumn(own, F.when(F.col(same) == 1, F.col(total)).otherwise(each + F.when(nth == 1, F.col(total) - each * F.col(same)).otherwise(0)))
    copies = F.floor(F.col(own) / F.col(size_))
    part = F.col(own) - copies * F.col(size_)
    takes = F.concat(F.array_repeat(F.lit(None).cast("long"), copies.cast("int")), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<long>")))
    taken = joined.withColumn(take, F.explode(takes))
    text = F.when(F.col(take).isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), 1, F.coalesce(take, F.lit(0)).cast("int")), " "))

    def column(c):
        if c == "text":
            return F.col(text_).alias("text")
        if c == "n_chars":
            return F.when(F.col(take).isNull(), F.col("n_chars")).otherwise(F.length(text_).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
        return F.col(f"`{c}`")

    return taken.withColumn(text_, text).select(*[column(c) for c in docs.columns])


def label_weights(spark, sf_dir: str) -> DataFrame:
    """Quality weights from labels.quality: 2 for 1, 0.5 for 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where("quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 2.0).otherwise(0.5)).alias("weight"))


def op1_mix_sources(spark, sf_dir):
    return plan_mix(documents(spark, sf_dir), label_weights(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH q AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT documents.doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(documents.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN cap / w <= level THEN cap ELSE max(CASE WHEN cap / w <= level THEN NULL ELSE level END) OVER () * w END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(round_even(target, 0) / source_size))::BIGINT ELSE 0 END AS epochs FROM t
), f AS (
  SELECT *, round_even(target, 0)::BIGINT - epochs * source_size AS rest FROM e
)
SELECT d.doc_id, d.size, f.source_size, f.target,
  (d.size * epochs + least(d.size, greatest(0, rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
