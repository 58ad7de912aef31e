"""Tables kept up upload by upload are what a full recompute gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import catalog as cat
from tidewater.operators import checks, incremental
from tidewater.sinks import buckets, writers

COLS = "bucket string, filename string, timestamp string, uuid string"


def uploads(seed, n=5):
    g = random.Random(seed)
    return [[(g.choice("ab"), f"f{g.randrange(30)}", f"2024-01-0{g.randrange(1, 9)} 00:00:00", f"u{k}-{i}") for i in range(g.randrange(0, 25))] for k in range(n)]


def test_objects_are_those_of_a_full_recompute(spark, tmp_path):
    path, seen = str(tmp_path / "objects"), []
    for k, rows in enumerate(uploads(3)):
        frame = spark.createDataFrame(rows, COLS)
        version = incremental.merge_latest(spark, path, frame, parts=8)
        incremental.merge_latest(spark, path, frame, parts=8)  # again: nothing changes
        seen += rows
        want = sorted(map(tuple, cat.latest_objects(spark.createDataFrame(seen, COLS)).collect()))
        assert sorted(map(tuple, incremental.current_objects(spark, path).collect())) == want
        if k == 1:
            early, at = want, version
    assert sorted(map(tuple, incremental.current_objects(spark, path, at).collect())) == early


def test_an_upload_rewrites_the_parts_it_touches(spark, tmp_path):
    path = str(tmp_path / "objects")
    many = spark.range(200).select(F.lit("b").alias("bucket"), F.concat(F.lit("f"), "id").alias("filename"), F.lit("2024").alias("timestamp"), F.col("id").cast("string").alias("uuid"))
    incremental.merge_latest(spark, path, many, parts=16)
    incremental.merge_latest(spark, path, spark.createDataFrame([("b", "f7", "2025", "new")], COLS), parts=16)
    gens = [r.gen[:8] for r in buckets.current_buckets(spark, path, incremental.OBJECT_SCHEMA, ("part",)).collect()]
    assert sorted(gens) == ["00000001"] * 15 + ["00000002"]
    now = {r.filename: r.uuid for r in incremental.current_objects(spark, path).collect()}
    assert len(now) == 200 and now["f7"] == "new"


def test_a_merge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "objects")
    incremental.merge_latest(spark, path, spark.createDataFrame([("b", "x", "1", "old")], COLS))
    with monkeypatch.context() as m:  # rows are written, the commit is not
        m.setattr(buckets, "last_version", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.merge_latest(spark, path, spark.createDataFrame([("b", "x", "2", "new")], COLS))
    writers.write_table(spark.createDataFrame([("b", "x", "9", "stray")], COLS).selectExpr("*", "0 as part", "'00000009-x' as gen"), f"{path}/data/part=0/gen=00000009-x")
    assert [r.uuid for r in incremental.current_objects(spark, path).collect()] == ["old"]


def test_duplicates_on_write_are_exact(spark, tmp_path):
    g = random.Random(5)
    base, seen = str(tmp_path / "keys"), []
    for k in range(4):
        keys = [f"k{g.randrange(400)}" for _ in range(120)] + ([None] if k == 1 else [])
        frame = spark.createDataFrame([(x,) for x in keys], "uuid string")
        for _ in range(2 if k == 2 else 1):  # a job that runs again finds the same
            got = {r.uuid: r.n for r in incremental.duplicates_on_write(spark, base, frame, f"u{k}").collect()}
        seen += [x for x in keys if x is not None]
        full = {r.uuid: r.n for r in checks.duplicate_keys(spark.createDataFrame([(x,) for x in seen], "uuid string")).collect()}
        assert got == {x: n for x, n in full.items() if x in keys}
    assert incremental.duplicates_on_write(spark, base, spark.createDataFrame([], "uuid string"), "none").count() == 0


def test_the_filter_holds_all_keys_and_few_others(spark, tmp_path):
    path = str(tmp_path / "filter")
    for part in range(3):
        incremental.add_keys(spark, path, spark.range(part * 2000, part * 2000 + 2500).select(F.md5(F.col("id").cast("string")).alias("k")), "k", pages=512)
    known = spark.range(6500).select(F.md5(F.col("id").cast("string")).alias("k"))
    other = spark.range(10_000, 30_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    assert incremental.may_hold(spark, path, known, "k", pages=512).count() == 6500
    assert incremental.may_hold(spark, path, other, "k", pages=512).count() < 400


def test_stored_keys_are_not_shuffled_for_an_upload(spark, tmp_path):
    base = str(tmp_path / "keys")
    old = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("uuid"))
    incremental.duplicates_on_write(spark, base, old, "a")
    new = spark.range(49_990, 52_000).select(F.md5(F.col("id").cast("string")).alias("uuid"))
    stored = spark.read.schema("uuid string, n long, upload_id string").parquet(f"{base}/keys")
    candidates = incremental.may_hold(spark, f"{base}/filter", new, "uuid")
    assert 10 <= candidates.count() < 200  # of 2010
    found = incremental.among(stored, candidates, "uuid")
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert incremental.duplicates_on_write(spark, base, new, "b").count() == 10
