"""Session helpers shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session that has none (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def moved(df: DataFrame) -> DataFrame:
    """``df`` saved, and the shuffle files of its plan deleted on all executors by the time this returns, whoever still refers to ``df``."""
    out = saved(df)
    remove = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents().removeShuffle
    for i in shuffle_ids(df):
        try:
            remove(i, True)  # files only: still registered, they would be made again for a reader
        except Py4JJavaError:  # an executor that does not answer; then the cleaner's turn comes, as ever
            pass
    return out


def shuffle_ids(df: DataFrame) -> list[int]:
    """Shuffles that the executed plan of ``df`` itself has made."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return list(plan.context().shuffleIds().keySet())
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out.append(node.shuffleId())
        todo += [node.children().apply(i) for i in range(node.children().length())]
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what was saved and is not referred to any more; else they stay until the driver's heap is full."""
    spark.range(1).count()  # the scheduler holds its last job until it has another
    for _ in range(3):  # the cleaner works beside it, and what it lets go of refers to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` saved, and marked for broadcast if it has at most so many rows."""
    df = saved(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as make them differ from all columns of ``df``."""
    taken, end = {c.lower() for c in df.columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_bits(*parts: Column) -> Column:
    """52 bits from md5 of the parts joined by ':' (null: 'null'), the same in any SQL engine."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
