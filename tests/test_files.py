"""File-level tests: readers, binary decoders, ingest job, writers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from builders import docx, jpeg_with_exif, png, xlsx
from tidewater.operators import converters as C
from tidewater.operators import media
from tidewater.operators.ingest import ingest_upload
from tidewater.sinks import writers
from tidewater.sources import files, images, office

HEAD = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "VesselName", "IMO"]
ROWS = [["1", "2024-01-01T00:00:00", "1.5", "2.5", "12", "90", "A", "I1"],
        ["2", "2024-01-01T00:01:00", "1.5", "2.5", "NA", "", "B", "I2"],
        ["3", "bad time", "1.5", "2.5", "9", "90", "C", "I3"]]


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="tidewater-files-")
    messy = ["\u00a0MMSI", "BaseDateTime ", "LAT", "LON  ", "SOG", "heading", "Vessel  Name", "imo"]
    open(f"{d}/ais.csv", "w").write("\n".join(",".join(r) for r in [messy] + ROWS) + "\n")
    open(f"{d}/ais.tsv", "w").write("\n".join("\t".join(r) for r in [messy] + ROWS) + "\n")
    xlsx(f"{d}/ais.xlsx", [messy] + ROWS)
    xlsx(f"{d}/w.xlsx", [["a", "b"], [1, 2], [3, 4]])
    docx(f"{d}/d.docx", ["First paragraph " + "x" * 300, "Second"])
    png(f"{d}/a.png")
    open(f"{d}/b.png", "wb").write(b"junk bytes, not an image")
    jpeg_with_exif(f"{d}/gps.jpg")
    good = ('{"latitude": "1.5", "longitude": "2.5", "speed": "3", "bearing": "4", "course": "5", "sys_trk_no": "7", '
            '"struct_update_track_timestamp": {"date_dd": "5", "date_mm": "3", "date_yy": "2024"}}')
    open(f"{d}/dmas.ndjson", "w").write("\n".join([good, "", '{"latitude":', good.replace('"date_dd": "5", ', "")]) + "\n")
    return d


def test_structured_three_ways(spark, folder):
    got = {}
    for ext in ("csv", "tsv", "xlsx"):
        raw = files.read_structured(spark, f"{folder}/ais.{ext}")
        assert {"mmsi", "basedatetime", "vessel name", "file_name", "row_no"} <= set(raw.columns)
        raw = raw.withColumnRenamed("vessel name", "vesselname")
        conv = C.convert_ais(C.structured_cells(raw))
        got[ext] = sorted((r["row_no"], r["mmsi"], r["speed"], r["reject_reason"] or "") for r in conv.collect())
    assert got["csv"] == got["tsv"] == got["xlsx"]
    assert [g[0] for g in got["csv"]] == [0, 1, 2]
    assert got["csv"][1][2] is None and got["csv"][2][3].startswith("Invalid timestamp")


def test_unsupported_suffix(spark, folder):
    with pytest.raises(ValueError):
        files.read_structured(spark, f"{folder}/d.docx")


def test_ndjson_lines_and_counts(spark, folder):
    lines = files.read_ndjson_lines(spark, f"{folder}/dmas.ndjson")
    conv = C.convert_dmas(lines, keep_blank=True)
    s = {r["row_no"]: r["reject_reason"] for r in conv.collect()}
    assert s[0] is None and s[1] == C.BLANK_LINE and s[2] == "Invalid JSON"
    assert s[3] == "Invalid date format: 00-03-2024"


def test_images_and_exif(spark, folder):
    bins = files.read_binary(spark, folder, "*.{png,jpg}")
    decoded = images.decode_images(bins)
    prof = {r["filename"]: r for r in images.image_profile(bins, decoded).collect()}
    assert (prof["a.png"]["format"], prof["a.png"]["resolution"], prof["a.png"]["mode"]) == ("PNG", "4x3", "RGB")
    assert prof["b.png"]["error"] == "File must be an image"
    assert (prof["gps.jpg"]["format"], prof["gps.jpg"]["width"], prof["gps.jpg"]["height"]) == ("JPEG", 8, 6)
    tags = images.exif_tag_table(decoded.where(F.col("path").endswith("gps.jpg")))
    kv = {r["tag"]: r["value"] for r in tags.collect()}
    assert kv["Make"] == "Acme" and kv["GPSLatitude"] == "10.0 30.0 0.0" and kv["GPSAltitude"] is None
    rec = media.image_record(tags).first()
    assert rec["latitude"] == 10.5 and abs(rec["longitude"] + 20.26) < 1e-9
    assert rec["coordinates"] == "10.500000, -20.260000" and rec["timestamp"] == "2024-03-05T10:20:30Z"
    summ = media.image_summary(media.image_record(tags)).first()
    assert summ["has_gps"] and summ["has_camera_info"] and summ["has_timestamp"]


def test_office_profiles(spark, folder):
    bins = files.read_binary(spark, folder, "*.{docx,xlsx}")
    d = office.docx_profile(bins.where(F.col("filename") == "d.docx")).first()
    assert (d["paragraph_count"], d["table_count"], d["section_count"]) == (2, 1, 1)
    assert d["first_paragraph"].endswith("...") and len(d["first_paragraph"]) == 203
    assert d["properties"]["title"] == "Report" and d["properties"]["created"] == "2024-01-02 03:04:05"
    w = office.xlsx_profile(bins.where(F.col("filename") == "w.xlsx")).first()
    assert w["sheet_count"] == 2 and w["sheet_names"] == ["Data", "Notes"]
    assert (w["sheets_info"][0]["max_row"], w["sheets_info"][0]["max_column"]) == (3, 2)


def test_ingest_upload_and_writers(spark, folder):
    from tidewater.schemas import SOURCE_SCHEMA, SUB_SOURCE_SCHEMA

    out = tempfile.mkdtemp(prefix="tidewater-out-")
    src = spark.createDataFrame([(1, "Piracy"), (2, "AIS"), (3, "DMAS")], SOURCE_SCHEMA)
    sub = spark.createDataFrame([(5, "Redicent", 4)], SUB_SOURCE_SCHEMA)
    res = ingest_upload(spark, [f"{folder}/dmas.ndjson"], "dmas", out, source_dim=src, sub_source_dim=sub,
                        uploaded_at="2025-01-01 00:00:00")
    s = res.summary.first()
    assert (s["attempted"], s["saved"], s["failed"]) == (4, 1, 2)
    again = ingest_upload(spark, [f"{folder}/dmas.ndjson"], "dmas", out, source_dim=src, sub_source_dim=sub,
                          uploaded_at="2025-01-01 00:00:00")  # a rerun replaces, never duplicates
    assert spark.read.parquet(again.records_path).count() == 4
    assert spark.read.parquet(f"{out}/file_catalog").count() == 1
    assert spark.read.parquet(f"{out}/upload_metadata").first()["record_count"] == 1
    saved = writers.read_saved_records(spark, res.records_path).collect()
    assert len(saved) == 1 and saved[0]["source_id"] == 3 and saved[0]["sub_source_id"] == 5
    assert writers.read_rejects(spark, res.records_path).count() == 2
    cat = res.catalog.first()
    assert (cat["bucket"], cat["type"], cat["source"]) == ("ndjson-files", "ndjson", "dmas")
    with pytest.raises(LookupError):
        writers.export_file_records(writers.read_saved_records(spark, res.records_path), "nope", f"{out}/x")
    writers.write_csv(writers.read_saved_records(spark, res.records_path).drop("raw_data"), f"{out}/csv")
    assert any(n.endswith(".csv") for n in os.listdir(f"{out}/csv"))
    made = writers.create_tables(spark, f"{out}/tables")
    assert "cdf_data" in made and spark.table("cdf_data").count() == 0


def test_document_records(spark, folder):
    recs = {r["filename"]: r for r in office.document_records(
        files.read_binary(spark, folder, "*.{docx,xlsx,png}"), "2025-01-01 00:00:00").collect()}
    assert recs["d.docx"]["docx"]["paragraph_count"] == 2 and recs["d.docx"]["error"] is None
    assert recs["w.xlsx"]["xlsx"]["sheet_count"] == 2 and recs["w.xlsx"]["storage"]["bucket"] == "xlsx-files"
    assert recs["a.png"]["error"] == office.UNSUPPORTED_DOCUMENT


def test_store_p8i_tables(spark):
    from tidewater.operators.ingest import store_p8i_tables

    raw = spark.createDataFrame([
        ("p.csv", 0, "05-03-2024", "10:00:00", "1", "Redicent", None, None),
        ("p.csv", 1, "05-03-2024", "10:00:00", "fast", "Efficnt", None, None),
        ("p.csv", 2, "05-03-2024", "10:00:00", "1", "Esm emitters", "06-03-2024", None),
        ("p.csv", 3, "05-03-2024", "10:00:00", "1", "Falcon", None, None),
        ("p.csv", 4, "05-03-2024", "10:00:00", "1", None, None, None),
    ], "file_name string, row_no long, msg_date string, msg_time string, speed string, sub_source_name string, "
       "position_valid_date string, date string")
    out = tempfile.mkdtemp(prefix="tidewater-p8i-")
    paths = store_p8i_tables(raw, out)
    trk = spark.read.parquet(paths["tracking"])
    assert [r["row_no"] for r in trk.where("status = 'saved'").collect()] == [0]
    assert [r["reject_reason"] for r in trk.where("status = 'failed'").collect()] == ["Invalid number for speed: fast"]
    assert [r["row_no"] for r in spark.read.parquet(paths["esm"]).where("status = 'saved'").collect()] == [2]
    rej = {r["row_no"]: r["reject_reason"] for r in spark.read.parquet(paths["unrouted"]).collect()}
    assert rej == {3: "Unknown sub_source: Falcon", 4: "Missing 'sub_source_name' in row."}


def test_row_numbers_packed_and_split_files(spark):
    d = tempfile.mkdtemp(prefix="tidewater-rows-")
    for k, n in (("a", 5), ("b", 3), ("c", 2000)):
        open(f"{d}/{k}.csv", "w").write("x,y\n" + "".join(f"{k}{i},{i}\n" for i in range(n)))
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # tiny splits: c.csv spans several tasks, a.csv and b.csv share one
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = files.read_structured(spark, [f"{d}/a.csv", f"{d}/b.csv", f"{d}/c.csv"])
        assert df.rdd.getNumPartitions() > 2
        got = {(r["file_name"], r["row_no"]): r["y"] for r in df.collect()}
    finally:
        for key, v in old.items():
            spark.conf.set(key, v)
    assert len(got) == 2008
    assert all(got[(f, i)] == str(i) for (f, i) in got)
