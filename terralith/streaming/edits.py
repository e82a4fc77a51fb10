"""Incremental building edits: a stream of files keeps the latest state of each building and counts by cell.

``latest`` is watermarked event-time deduplication as a streaming aggregate; ``upsert``
merges each micro-batch into a table, the newest edit of a building first, by versions
of the whole table in the target folder, so that a restarted batch gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "bldg_id long, ts timestamp, area_m2 double, building_type string, x double, y double, deleted boolean"


def edits(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def newest(df: DataFrame) -> DataFrame:
    """The last edit of each building; among equal times the larger row."""
    w = Window.partitionBy("bldg_id").orderBy(F.col("ts").desc(), F.col("deleted").desc_nulls_last(), F.col("area_m2").desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edit_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Edits and deletions by window of event time; what is later than the watermark is left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("edits"), F.count_if("deleted").alias("deletions")).select(F.col("w.start").alias("start"), "edits", "deletions")


def upsert(stream: DataFrame, target: str, checkpoint: str):
    """Starts the query that keeps the table ``target``/v<batch> up to date; see ``current``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, target, below=number)
        rows = newest(batch if before is None else batch.unionByName(before))
        rows.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest whole version of the table, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(n[2:]) for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [n for n in found if below is None or n < below]
    return spark.read.schema(SCHEMA).parquet(f"{target}/v={max(found)}") if found else None


def standing(state: DataFrame) -> DataFrame:
    return state.where("not coalesce(deleted, false)")
