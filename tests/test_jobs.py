"""End to end over a store folder: the jobs a user of the upload service runs."""

import tempfile

import pytest

from builders import docx, jpeg_with_exif, png
from tidewater import jobs

LINE = ('{"latitude": "1.5", "longitude": "2.5", "speed": "12", "bearing": "4", "course": "5", "sys_trk_no": "7", '
        '"struct_update_track_timestamp": {"date_dd": "5", "date_mm": "3", "date_yy": "2024"}}')


def test_store_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tidewater-up-")
    store = tempfile.mkdtemp(prefix="tidewater-store-")
    open(f"{d}/tracks.ndjson", "w").write(LINE + "\n\n" + LINE.replace('"12"', '"fast"') + "\n")
    open(f"{d}/ais.csv", "w").write("MMSI,BaseDateTime,LAT,LON,SOG,Heading\n1,2024-01-01T00:00:00,1,2,11,90\n")
    png(f"{d}/a.png")
    jpeg_with_exif(f"{d}/g.jpg")
    docx(f"{d}/r.docx", ["Hello"])
    jobs.init_store(spark, store, [(1, "Piracy"), (2, "AIS"), (3, "DMAS")], [(1, "Redicent", 4)])

    assert jobs.detect_kind(f"{d}/tracks.ndjson", None) == "ndjson"
    assert jobs.detect_kind(f"{d}/ais.csv", "text/csv") == "structured"
    r1 = jobs.upload(spark, [f"{d}/tracks.ndjson"], "dmas", store, "2025-01-01 00:00:00")
    r2 = jobs.upload(spark, [f"{d}/ais.csv"], "AIS", store, "2025-01-02 00:00:00", "text/csv")
    assert r1.summary.first()["saved"] == 1 and r2.summary.first()["saved"] == 1

    exp = {r["source"]: r for r in jobs.export_cdf(spark, store, f"{store}/export").collect()}
    assert set(exp) == {"DMAS", "AIS"} and exp["DMAS"]["location"] == "POINT(2.5 1.5)"
    assert exp["AIS"]["logged_timestamp"] == "2024-01-01T00:00:00"

    meta = jobs.list_upload_metadata(spark, store).collect()
    assert [m["file_name"] for m in meta] == ["ais.csv", "tracks.ndjson"]

    imgs = {r["filename"]: r for r in jobs.extract_images(spark, [f"{d}/a.png", f"{d}/g.jpg"], store,
                                                              "2025-01-03 00:00:00").collect()}
    assert imgs["g.jpg"]["camera_make"] == "Acme" and imgs["g.jpg"]["has_gps"] and imgs["a.png"]["resolution"] == "4x3"
    docs = jobs.upload_documents(spark, [f"{d}/r.docx"], store, "2025-01-04 00:00:00").collect()
    assert docs[0]["docx"]["paragraph_count"] == 1

    hist = jobs.file_history(spark, store).collect()
    assert len(hist) == 5 and [h["bucket"] for h in hist[:2]] == ["docx-files", "images"]
    assert imgs["g.jpg"]["gps_data"]["latitude"] == imgs["g.jpg"]["latitude"] == 10.5 and imgs["g.jpg"]["camera_info"]["make"] == "Acme"
    assert imgs["g.jpg"]["date_taken"] == "2024-03-05" and imgs["g.jpg"]["time_taken"] == "10:20:30" and imgs["a.png"]["gps_data"] is None
    uuid = hist[-1]["uuid"]
    assert jobs.file_metadata(spark, store, uuid).first()["found"]
    assert jobs.file_metadata(spark, store, "nope").count() == 0

    jobs.download_file_records(spark, store, exp["AIS"]["file_uuid"], f"{store}/dl")
    with pytest.raises(LookupError):
        jobs.download_file_records(spark, store, "no-such-file", f"{store}/dl2")
    assert [r["name"] for r in jobs.list_sources(spark, store).collect()] == ["Piracy", "AIS", "DMAS"]
    assert jobs.sub_sources(spark, store, 4).count() == 1
    with pytest.raises(LookupError):
        jobs.sub_sources(spark, store, 2)
    assert jobs.source_name(spark, store, 2) == "AIS"
    with pytest.raises(LookupError):
        jobs.source_name(spark, store, 9)


def test_same_name_two_uploads_distinct_ids(spark):
    d1, d2 = tempfile.mkdtemp(prefix="tidewater-a-"), tempfile.mkdtemp(prefix="tidewater-b-")
    store = tempfile.mkdtemp(prefix="tidewater-store2-")
    for d in (d1, d2):
        open(f"{d}/same.ndjson", "w").write(LINE + "\n")
    jobs.init_store(spark, store, [(3, "DMAS")], [(1, "Redicent", 4)])
    jobs.upload(spark, [f"{d1}/same.ndjson"], "dmas", store, "2025-01-01 00:00:00")
    jobs.upload(spark, [f"{d2}/same.ndjson"], "dmas", store, "2025-01-02 00:00:00")
    jobs.upload(spark, [f"{d2}/same.ndjson"], "dmas", store, "2025-01-02 00:00:00")  # rerun
    recs = spark.read.parquet(f"{store}/cdf_data").where("status = 'saved'")
    assert recs.count() == 2 and recs.select("uuid").distinct().count() == 2
    cat_ids = {r["uuid"] for r in spark.read.parquet(f"{store}/file_catalog").collect()}
    assert cat_ids == {r["file_uuid"] for r in recs.collect()}


def test_xlsx_upload_and_unknown_feed(spark):
    from builders import xlsx

    d = tempfile.mkdtemp(prefix="tidewater-x-")
    store = tempfile.mkdtemp(prefix="tidewater-store3-")
    xlsx(f"{d}/ais.xlsx", [["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading"],
                            ["1", "2024-01-01T00:00:00", 1.5, 2.5, 12, 90], ["2", "bad", 1, 2, 3, 4]])
    jobs.init_store(spark, store, [(2, "AIS")], [(1, "Redicent", 4)])
    r = jobs.upload(spark, [f"{d}/ais.xlsx"], "AIS", store, "2025-01-01 00:00:00")
    s = r.summary.first()
    assert (s["attempted"], s["saved"], s["failed"]) == (2, 1, 1)
    saved = spark.read.parquet(f"{store}/cdf_data").where("status = 'saved'").first()
    assert saved["speed"] == 12.0 and saved["latitude"] == 1.5
    open(f"{d}/radar.csv", "w").write("a,b\n1,2\n3,4\n")
    u = jobs.upload(spark, [f"{d}/radar.csv"], "radar", store, "2025-01-01 00:00:00")
    us = u.summary.first()
    assert (us["attempted"], us["saved"], us["failed"]) == (2, 0, 2)


def test_unreadable_workbook_is_one_rejected_row(spark):
    from builders import xlsx

    d = tempfile.mkdtemp(prefix="tidewater-x2-")
    store = tempfile.mkdtemp(prefix="tidewater-store5-")
    head = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading"]
    xlsx(f"{d}/one.xlsx", [head, ["1", "2024-01-01T00:00:00", 1.5, 2.5, 12, 90]])
    xlsx(f"{d}/same.xlsx", [head, ["2", "2024-01-01T00:00:00", 1.5, 2.5, 13, 90], ["3", "bad", 1, 2, 3, 4]])
    # columns in another order, one of them without a name
    xlsx(f"{d}/turned.xlsx", [head[::-1] + [""], [90, 14, 2.5, 1.5, "2024-01-01T00:00:00", "4", "x"]])
    open(f"{d}/junk.xlsx", "w").write("no workbook")
    jobs.init_store(spark, store, [(2, "AIS")], [(1, "Redicent", 4)])
    names = ("one", "junk", "turned", "same")
    r = jobs.upload(spark, [f"{d}/{n}.xlsx" for n in names], "AIS", store, "2025-01-01 00:00:00")
    got = {s["file_name"]: (s["attempted"], s["saved"], s["failed"]) for s in r.summary.collect()}
    assert got == {"one.xlsx": (1, 1, 0), "same.xlsx": (2, 1, 1), "turned.xlsx": (1, 1, 0), "junk.xlsx": (1, 0, 1)}
    recs = spark.read.parquet(f"{store}/cdf_data")
    assert sorted(x["speed"] for x in recs.where("status = 'saved'").collect()) == [12.0, 13.0, 14.0]
    bad = recs.where("file_name = 'junk.xlsx'").first()
    assert bad["reject_reason"].startswith("Unreadable workbook") and bad["row_no"] == 0
    alone = jobs.upload(spark, [f"{d}/junk.xlsx"], "AIS", store, "2025-01-02 00:00:00").summary.first()
    assert (alone["attempted"], alone["saved"], alone["failed"]) == (1, 0, 1)


def test_stream_and_uploads_share_a_store(spark):
    from tidewater.streaming.ingest import start_file_ingest

    d = tempfile.mkdtemp(prefix="tidewater-sh-")
    landing = tempfile.mkdtemp(prefix="tidewater-land-")
    store = tempfile.mkdtemp(prefix="tidewater-store4-")
    jobs.init_store(spark, store, [(3, "DMAS")], [(1, "Redicent", 4)])
    open(f"{d}/up.ndjson", "w").write(LINE + "\n")
    jobs.upload(spark, [f"{d}/up.ndjson"], "dmas", store, "2025-01-01 00:00:00")
    open(f"{landing}/s.ndjson", "w").write(LINE + "\n" + LINE + "\n")
    src, sub = spark.read.parquet(f"{store}/source"), spark.read.parquet(f"{store}/sub_source")
    q = start_file_ingest(spark, landing, store, "DMAS", source_dim=src, sub_source_dim=sub,
                          checkpoint_location=tempfile.mkdtemp(prefix="tidewater-ck-"))
    q.awaitTermination(120)
    recs = spark.read.parquet(f"{store}/cdf_data").where("status = 'saved'")
    assert recs.count() == 3 and recs.select("upload_id").distinct().count() == 2
    assert len(jobs.export_cdf(spark, store).collect()) == 3
