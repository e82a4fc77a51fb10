"""Exact deduplication by content-defined chunk recipes, in DataFrame functions alone.

The text, without ASCII white space, is cut where its own content says so: after
a cut mark, five characters of certain classes, which ordinary text of any
script meets every few thousand characters; a chunk that has none for
``LONGEST`` characters is cut there.  A chunk is identified by 64 bits of a hash.  All chunks
are deduplicated to a table of identifiers, and each is verified: the smallest
and the largest of the chunks that share it must be the same bytes.  Should two
differ, the run is repeated with identifiers of 256 bits, verified in the same way.  Documents are then
compared by their ordered lists of identifiers, 8 bytes a chunk; a text moves
once, as chunks, and a chunk that many documents of a task hold moves once for that task.

Groups of copies are reduced by partial aggregation before the shuffle.  Those that hold more than
one in ``HOT`` of all rows, so fewer than ``HOT`` of them, meet their rows by broadcast, the others by a join.

Results in unusual cases: null text counts as empty; all empty texts form one
group; rows that repeat a doc_id are rows of their own (``group_size`` counts
each); a null doc_id sorts before every other; an empty table gives no rows;
other columns of the input are ignored (``classes``) or kept, whatever their
names (``deduplicate``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, own_names, saved

#: First and last letters of scripts whose quarters, by turns, make the classes of a cut mark: digits, Greek, Cyrillic,
#: Hebrew, Arabic, Devanagari, Thai, kana, ideographs, Hangul.
SCRIPTS = ((0x30, 0x39), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x30F6), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
LATIN = ("aeio", "b-dm", "aeiu", "nlr", "eio")
LONGEST = 1 << 16
HOT = 1000
#: Identifiers of a recipe that is broadcast.
SHORT = 1000


def _cut_mark() -> str:
    classes = []
    for k, latin in enumerate(LATIN):
        parts = [latin]
        for first, last in SCRIPTS:
            size, turn = last - first + 1, k % 4
            parts.append(f"\\x{{{first + size * turn // 4:X}}}-\\x{{{first + size * (turn + 1) // 4 - 1:X}}}")
        classes.append(f"[{''.join(parts)}]")
    return f"(?<={''.join(classes)})(?=[^aeiou])"


#: A chunk ends after a text that matches this: content-defined, so an edit moves no cut but its own.
CUT_MARK = _cut_mark()


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def chunks(norm: Column, cut_mark: str = CUT_MARK) -> Column:
    long = F.lit(f"(?s).{{1,{LONGEST}}}")
    return F.flatten(F.transform(F.split(norm, cut_mark), lambda c: F.when(F.length(c) <= LONGEST, F.array(c)).otherwise(F.regexp_extract_all(c, long, F.lit(0)))))


def identifier(chunk: Column, wide: bool) -> Column:
    return F.sha2(chunk, 256) if wide else F.xxhash64(chunk)


def unverified(docs: DataFrame, cut_mark: str = CUT_MARK, wide: bool = False) -> DataFrame:
    """Identifiers that chunks of different text share."""
    every = docs.select(F.explode(chunks(normalised(F.col("text")), cut_mark)).alias("chunk")).select(identifier(F.col("chunk"), wide).alias("id"), "chunk")
    return every.groupBy("id").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("id")


def recipes(docs: DataFrame, cut_mark: str = CUT_MARK, wide: bool = False) -> DataFrame:
    """doc_id, n_points, text_sha256 and the ordered list of chunk identifiers."""
    norm = docs.select(F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm"), cut_mark), lambda c: identifier(c, wide)).alias("recipe"))


def classes(docs: DataFrame, cut_mark: str = CUT_MARK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest doc_id.
    """
    wide = not unverified(docs, cut_mark).isEmpty()
    if wide and not unverified(docs, cut_mark, wide).isEmpty():
        raise ValueError("different chunks share a SHA-256")
    rows = saved(recipes(docs, cut_mark, wide))  # narrow: the texts are cut once for it
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").alias("d"))).alias("first"))
    groups = saved(groups.select(F.col("recipe").alias("r"), F.col("group_size").cast("long").alias("group_size"), F.col("first.d").alias("keep_id")))
    hot = (F.col("group_size") > rows.count() / HOT) & (F.size("r") <= SHORT)
    of_hot = rows.join(F.broadcast(groups.where(hot)), F.col("recipe") == F.col("r"))
    others = rows.join(F.broadcast(groups.where(hot).select("r")), F.col("recipe") == F.col("r"), "left_anti").join(groups.where(~hot), F.col("recipe") == F.col("r"))
    return of_hot.unionByName(others).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, cut_mark: str = CUT_MARK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row if a kept row is repeated."""
    id_, sha, own_sha, nth = own_names(docs, "id", "sha", "own_sha", "nth")
    kept = classes(docs.select("doc_id", "text"), cut_mark).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    own = docs.withColumn(own_sha, F.sha2(normalised(F.col("text")), 256))
    # Of repeated rows with the kept doc_id and an equal text the longest stays; the join has dealt them together.
    order = [F.length("text").desc_nulls_last(), *[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))]]
    rows = own.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)), "left_semi")
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", own_sha).orderBy(*order))).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op8_exact_dedup(spark, sf_dir):
    return classes(documents(spark, sf_dir))
