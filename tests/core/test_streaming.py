import datetime as dt

from terralith.streaming import edits


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, edits.SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_upserts_keep_the_newest_edit(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    src, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write(spark, src, "a", [(1, t(1), 10.0, "yes", 0.0, 0.0, False), (2, t(1), 20.0, "house", 0.0, 0.0, False)])
    stream = lambda: edits.edits(spark, src + "/*")
    assert edits.current(spark, target) is None
    edits.upsert(stream(), target, check).awaitTermination(120)
    write(spark, src, "b", [(1, t(3), 11.0, "yes", 0.0, 0.0, False), (1, t(2), 99.0, "yes", 0.0, 0.0, False), (2, t(4), None, None, None, None, True)])
    edits.upsert(stream(), target, check).awaitTermination(120)
    got = edits.standing(edits.current(spark, target)).collect()
    assert [(r.bldg_id, r.area_m2) for r in got] == [(1, 11.0)]


def test_counts_by_window(spark, tmp_path):
    write(spark, str(tmp_path), "a", [(i, dt.datetime(2024, 1, 1, i % 2), 1.0, "yes", 0.0, 0.0, i == 0) for i in range(10)])
    q = edits.edit_counts(edits.edits(spark, f"{tmp_path}/*")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.edits, r.deletions) for r in spark.table("counts").collect()) == [(5, 0), (5, 1)]
