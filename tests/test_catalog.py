"""Catalogue and joins: C14, C15, G1, E4-E7, F5, F6."""

from pyspark.sql import functions as F

from tidewater.operators import catalog as cat
from tidewater.operators import checks, enrich
from tidewater.schemas import SOURCE_SCHEMA, SUB_SOURCE_SCHEMA


def files(spark):
    return spark.createDataFrame([
        ("u1", "a.csv", "text/csv", 10, "2024-01-01 00:00:00", "ais"),
        ("u2", "a.csv", "text/csv", 11, "2024-01-02 00:00:00", "2"),
        ("u3", "a.csv", "text/csv", 12, "2024-01-02 00:00:00", "99"),   # same time: uuid breaks the tie
        ("u4", "pic.PNG", "image/png", 13, "2024-01-01 00:00:00", ""),
        ("u5", "notes", "application/octet-stream", 14, "2024-01-01 00:00:00", "7"),
        ("u6", "clip.mkv", "application/x-matroska", 15, "2024-01-01 00:00:00", "x"),
    ], "uuid string, filename string, content_type string, size long, timestamp string, source string")


def test_kind_and_bucket(spark):
    c = cat.catalog_rows(files(spark)).collect()
    got = {r["uuid"]: (r["type"], r["bucket"]) for r in c}
    assert got["u1"] == ("csv", "csv") and got["u4"] == ("image", "images")
    assert got["u5"] == ("", "misc-files") and got["u6"] == ("mkv", "mkv-files")
    kinds = files(spark).select("uuid", cat.file_kind(F.col("content_type"), F.col("filename")).alias("k")).collect()
    assert {r["uuid"]: r["k"] for r in kinds} == {"u1": "structured", "u2": "structured", "u3": "structured",
                                                   "u4": "image", "u5": "unsupported", "u6": "unsupported"}


def test_latest_and_lookup(spark):
    c = cat.catalog_rows(files(spark))
    latest = {(r["bucket"], r["filename"]): r["uuid"] for r in cat.latest_objects(c).collect()}
    assert latest[("csv", "a.csv")] == "u3"
    found = {r["uuid"]: r["found"] for r in cat.file_by_uuid(c).collect()}
    assert found["u3"] and not found["u1"] and not found["u2"]


def test_hot_filename_is_one_aggregate(spark):
    """G1 on a key holding most rows: a plain partial aggregate, no window."""
    many = spark.range(20000).select(
        F.lit("csv").alias("bucket"), F.lit("same.csv").alias("filename"),
        F.format_string("2024-01-01 %05d", F.col("id")).alias("timestamp"), F.col("id").cast("string").alias("uuid"))
    df = cat.latest_objects(many)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert df.first()["uuid"] == "19999"


def test_source_joins(spark):
    src = spark.createDataFrame([(1, "Piracy"), (2, "AIS"), (7, "ais")], SOURCE_SCHEMA)
    sub = spark.createDataFrame([(4, "Redicent", 1), (3, "Garud", 1)], SUB_SOURCE_SCHEMA)
    rec = spark.createDataFrame([("AIS", None), ("radar", "Redicent")], "feed string, sub_source_name string")
    out = enrich.with_sub_source_id(enrich.with_source_id(rec, src), sub).orderBy("feed").collect()
    assert [(r["source_id"], r["sub_source_id"]) for r in out] == [(2, 3), (1, 4)]
    named = enrich.with_upload_source_name(files(spark).withColumnRenamed("source", "upload_source"), src)
    names = {r["uuid"]: r["source_name"] for r in named.collect()}
    assert names["u1"] == "ais" and names["u2"] == "AIS" and names["u3"] == "unknown" and names["u4"] == ""


def test_building_lookups_starts_no_job(spark):
    src = spark.createDataFrame([(1, "ais"), (2, "dmas")], "id int, name string")
    sub = spark.createDataFrame([(5, "radar", 1), (3, "esm", 2)], "id int, name string, source_id int")
    rec = spark.createDataFrame([("AIS", "radar"), ("none", None)], "feed string, sub_source_name string")
    spark.sparkContext.setJobGroup("plan building", "")
    try:
        out = enrich.with_dimension_names(enrich.with_sub_source_id(enrich.with_source_id(rec, src), sub), src, sub)
        rows = cat.catalog_rows(files(spark))
        cat.file_by_uuid(rows), cat.lookup_file(rows, "u1")
        enrich.sub_sources_of(src.select(F.col("id").alias("source_id")), sub)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in out.select("source_id", "sub_source_id", "source", "sub_source").orderBy("sub_source_id").collect()] == [
        (1, 3, "ais", "esm"), (1, 5, "ais", "radar")]
    empty = enrich.with_sub_source_id(rec, sub.where("false"))
    assert {r["sub_source_id"] for r in empty.collect()} == {1}


def test_constraints(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "uuid string, source_id int")
    assert [r["uuid"] for r in checks.duplicate_keys(df).collect()] == ["a"]
    src = spark.createDataFrame([(1, "x"), (2, "y")], SOURCE_SCHEMA)
    assert [r["source_id"] for r in checks.foreign_key_violations(df, "source_id", src).collect()] == [9]


def test_lookup_one_file(spark):
    c = cat.catalog_rows(files(spark))
    assert cat.lookup_file(c, "u1").first()["found"] is False
    assert cat.lookup_file(c, "u3").first()["current_uuid"] == "u3"
    assert cat.lookup_file(c, "nope").count() == 0
