import hashlib
import re
from collections import defaultdict

from terralith.llm import exact_dedup

from .cases import SCHEMA, clashing, rows, table, unchanged


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))[0]
        out += [(r[0], keep, len(members), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


def test_classes(spark):
    got = [tuple(r) for r in exact_dedup.classes(table(spark)).collect()]
    assert sorted(got, key=str) == brute(rows())


def test_cut_marks_change_chunks_not_classes(spark):
    for mark in ("(?<=a)", "(?<=never-there)"):
        got = [tuple(r) for r in exact_dedup.classes(table(spark), mark).collect()]
        assert sorted(got, key=str) == brute(rows())


def test_long_texts_are_cut_into_many_chunks(spark):
    df = spark.createDataFrame([(1, "".join(f"obaner {i} " for i in range(4000)))], "doc_id long, text string")
    assert exact_dedup.recipes(df).selectExpr("size(recipe) n").first().n > 10


def test_deduplicate_keeps_columns_and_one_row_a_class(spark):
    docs = table(spark)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert got.count() == len({r[4] for r in brute(rows())})


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.classes(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = clashing(spark)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns and unchanged(got) and got.count() == len({r[4] for r in brute(rows())})


def test_a_doc_id_that_says_null_is_not_null(spark):
    df = spark.createDataFrame([("null", "a b"), (None, "ab"), ("x", "c")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.deduplicate(df).collect()) == [("null", "a b"), ("x", "c")]


def test_cut_marks_meet_every_script(spark):
    import random

    r = random.Random(2)
    letters = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "digits": range(0x30, 0x3A), "ideographs": range(0x4E00, 0xA000), "hangul": range(0xAC00, 0xD7A4), "arabic": range(0x621, 0x64B)}
    df = spark.createDataFrame([(k, "".join(chr(r.choice(v)) for _ in range(60_000))) for k, v in letters.items()], "doc_id string, text string")
    got = {r.doc_id: r.n for r in exact_dedup.recipes(df).selectExpr("doc_id", "size(recipe) n").collect()}
    assert all(5 < n < 600 for n in got.values()), got


def test_chunks_without_a_mark_are_bounded_and_whole(spark):
    df = spark.createDataFrame([(1, "x" * 200_000), (2, "x" * 200_000 + " "), (3, "x" * 200_001)], "doc_id long, text string")
    assert {r.doc_id: r.n for r in exact_dedup.recipes(df).selectExpr("doc_id", "size(recipe) n").collect()} == {1: 4, 2: 4, 3: 4}
    assert {r.doc_id: r.keep_id for r in exact_dedup.classes(df).collect()} == {1: 2, 2: 2, 3: 3}


def test_identifiers_are_verified_and_widened(spark, monkeypatch):
    from pyspark.sql import functions as F

    real, seen = exact_dedup.identifier, []
    monkeypatch.setattr(exact_dedup, "identifier", lambda c, wide: seen.append(wide) or (real(c, wide) if wide else F.length(c)))
    got = [tuple(r) for r in exact_dedup.classes(table(spark)).collect()]
    assert sorted(got, key=str) == brute(rows()) and True in seen


def test_hot_groups_by_broadcast_change_nothing(spark, monkeypatch):
    for hot in (1, 10, 10**9):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert sorted((tuple(r) for r in exact_dedup.classes(table(spark)).collect()), key=str) == brute(rows())
