"""Uploads that a user would notice going wrong: columns, reruns, ids, lost lines."""

import os

import pytest

from tidewater import jobs
from tidewater.operators.ingest import convert_ndjson, store_p8i_tables
from tidewater.sources import files

AT = "2025-01-01 00:00:00"


@pytest.fixture()
def store(spark, tmp_path):
    s = str(tmp_path / "store")
    jobs.init_store(spark, s, [(1, "Piracy"), (2, "AIS"), (3, "DMAS"), (4, "P8I")], [(1, "Redicent", 4)])
    return s


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def records(spark, store):
    return spark.read.parquet(f"{store}/cdf_data").collect()


def test_each_file_keeps_its_own_header(spark, store, tmp_path):
    a = put(tmp_path, "a.csv", "BaseDateTime,LAT,LON,SOG,Heading\n2024-01-01T00:00:00,1,2,11,90\n")
    b = put(tmp_path, "b.csv", "LON,LAT,Heading,SOG,BaseDateTime\n20,10,9,5,2024-01-01T00:00:00\n")
    jobs.upload(spark, [a, b], "AIS", store, AT)
    got = {r.file_name: (r.latitude, r.longitude, r.speed, r.course, r.status) for r in records(spark, store)}
    assert got == {"a.csv": (1.0, 2.0, 11.0, 90.0, "saved"), "b.csv": (10.0, 20.0, 5.0, 9.0, "saved")}


def test_files_of_one_name_keep_apart(spark, store, tmp_path):
    text = "BaseDateTime,LAT,LON,SOG,Heading\n2024-01-01T00:00:00,1,2,11,90\n"
    paths = [put(tmp_path, f"{d}/x.csv", text) for d in "pq"]
    jobs.upload(spark, paths, "AIS", store, AT)
    got = records(spark, store)
    assert len({r.uuid for r in got}) == 2 == len({r.file_uuid for r in got})
    assert sorted(r.record_count for r in jobs.list_upload_metadata(spark, store).collect()) == [1, 1]
    assert {r.uuid for r in jobs.file_history(spark, store).collect()} == {r.file_uuid for r in got}


def test_rerun_replaces_and_a_changed_file_is_new(spark, store, tmp_path):
    head = "BaseDateTime,LAT,LON,SOG,Heading\n"
    path = put(tmp_path, "a.csv", head + "2024-01-01T00:00:00,1,2,bad,90\n")
    for _ in range(2):
        jobs.upload(spark, [path], "AIS", store, AT)
    assert [r.status for r in records(spark, store)] == ["failed"]
    put(tmp_path, "a.csv", head + "2024-01-01T00:00:00,1,2,3,90\n")
    os.utime(path, (1, 1))
    res = jobs.upload(spark, [path], "AIS", store, AT)
    assert (res.summary.first()["saved"], res.summary.first()["failed"]) == (1, 0)
    assert sorted(r.status for r in records(spark, store)) == ["failed", "saved"]  # the history of both uploads


def test_p8i_tables_do_not_double(spark, tmp_path):
    path = put(tmp_path, "p.csv", "sub_source_name,latitude\nRedicent,1\nnone,2\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        paths = store_p8i_tables(files.read_delimited(spark, [path]), out)
    assert spark.read.parquet(paths["tracking"]).count() == 1 and spark.read.parquet(paths["unrouted"]).count() == 1


def test_dmas_rows_of_a_csv_are_reported(spark, store, tmp_path):
    path = put(tmp_path, "d.csv", "latitude,longitude,speed\n1,2,3\n")
    assert jobs.upload(spark, [path], "dmas", store, AT).summary.first()["failed"] == 1


def test_json_by_content_type_and_whole_objects(spark, store, tmp_path):
    line = '{"BaseDateTime": "2024-01-01T00:00:00", "LAT": 1, "LON": 2, "SOG": 3, "Heading": 4, "CallSign": "XYZ"}'
    missing = line.replace('"SOG": 3, "Heading": 4, ', "")
    path = put(tmp_path, "a.json", f"{line}\n\n{{broken\n{missing}\n")
    res = jobs.upload(spark, [path], "AIS", store, AT, "application/json")
    assert res.summary.first()["attempted"] == 4
    got = {r.row_no: r for r in records(spark, store)}
    assert got[0].raw_data == line and got[0].status == "saved" and got[0].latitude == 1.0
    assert [got[k].status for k in (1, 2, 3)] == ["skipped", "failed", "failed"]
    assert got[2].reject_reason == "Invalid JSON" and got[3].reject_reason == "Missing SOG"


def test_every_line_has_an_outcome(spark):
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(["", "{}", "x", None, '{"LAT": ""}'])], "file_name string, row_no long, value string")
    for feed in ("AIS", "Piracy", "P8I", "DMAS"):
        assert convert_ndjson(lines, feed, keep_blank=True).count() == 5


def test_workbooks_and_suffixes_in_the_catalogue(spark, store, tmp_path):
    path = put(tmp_path, "t.tsv", "BaseDateTime\tLAT\tLON\tSOG\tHeading\n2024-01-01T00:00:00\t1\t2\t3\t4\n")
    jobs.upload(spark, [path], "AIS", store, AT)
    assert jobs.file_history(spark, store).first()["content_type"] == "text/tab-separated-values"


def test_unknown_feed_of_a_stream_is_reported(spark, store, tmp_path):
    from tidewater.streaming.ingest import start_file_ingest

    put(tmp_path, "in/a.ndjson", '{"a": 1}\n{"a": 2}\n')
    src, sub = spark.read.parquet(f"{store}/source"), spark.read.parquet(f"{store}/sub_source")
    q = start_file_ingest(spark, str(tmp_path / "in"), store, "radar", source_dim=src, sub_source_dim=sub, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert [r.status for r in records(spark, store)] == ["failed", "failed"]
