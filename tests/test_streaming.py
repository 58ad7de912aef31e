"""L1: two stream runs over one folder convert each file exactly once."""

import shutil
import tempfile

from tidewater.schemas import SOURCE_SCHEMA, SUB_SOURCE_SCHEMA
from tidewater.streaming.ingest import start_file_ingest

LINE = ('{{"latitude": "1.5", "longitude": "2.5", "speed": "{s}", "bearing": "4", "course": "5", "sys_trk_no": "7", '
        '"struct_update_track_timestamp": {{"date_dd": "5", "date_mm": "3", "date_yy": "2024"}}}}')


def test_stream_twice_no_duplicates(spark):
    src_dir = tempfile.mkdtemp(prefix="tidewater-in-")
    out = tempfile.mkdtemp(prefix="tidewater-sout-")
    ckpt = tempfile.mkdtemp(prefix="tidewater-sckpt-")
    src = spark.createDataFrame([(3, "DMAS")], SOURCE_SCHEMA)
    sub = spark.createDataFrame([(1, "Redicent", 4)], SUB_SOURCE_SCHEMA)
    open(f"{src_dir}/a.ndjson", "w").write("\n".join(LINE.format(s=i) for i in range(5)) + "\n\n")

    def run():
        q = start_file_ingest(spark, src_dir, out, "DMAS", source_dim=src, sub_source_dim=sub,
                              checkpoint_location=ckpt)
        q.awaitTermination(120)

    run()
    run()  # nothing new: no new batch, nothing duplicated
    open(f"{src_dir}/b.ndjson", "w").write("\n".join(LINE.format(s=i) for i in range(3)) + "\nnot json\n")
    run()
    recs = spark.read.parquet(f"{out}/cdf_data")
    assert recs.where("status = 'saved'").count() == 8
    assert recs.where("status = 'failed'").count() == 1
    assert recs.select("uuid").distinct().count() == recs.count()
    summ = {r["file_name"]: (r["attempted"], r["saved"], r["failed"]) for r in spark.read.parquet(f"{out}/upload_summary").collect()}
    assert summ == {"a.ndjson": (6, 5, 0), "b.ndjson": (4, 3, 1)}
    shutil.rmtree(src_dir, ignore_errors=True)


def test_stream_csv_feed(spark):
    src_dir = tempfile.mkdtemp(prefix="tidewater-csvin-")
    out = tempfile.mkdtemp(prefix="tidewater-csvout-")
    ckpt = tempfile.mkdtemp(prefix="tidewater-csvckpt-")
    src = spark.createDataFrame([(2, "AIS")], SOURCE_SCHEMA)
    sub = spark.createDataFrame([(1, "Redicent", 4)], SUB_SOURCE_SCHEMA)
    cols = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "VesselName", "IMO"]
    rows = [",".join(cols), "1,2024-01-01T00:00:00,1.5,2.5,12,90,A,I1", "2,2024-01-01T00:01:00,1.5,2.5,NA,,B,I2",
            "3,not a time,1.5,2.5,9,90,C,I3"]
    open(f"{src_dir}/ais_1.csv", "w").write("\n".join(rows) + "\n")
    q = start_file_ingest(spark, src_dir, out, "AIS", source_dim=src, sub_source_dim=sub, kind="csv",
                          columns=[c.lower() for c in cols], checkpoint_location=ckpt)
    q.awaitTermination(120)
    recs = spark.read.parquet(f"{out}/cdf_data")
    saved = {r["row_no"]: r for r in recs.where("status = 'saved'").collect()}
    assert sorted(saved) == [0, 1] and saved[1]["speed"] is None and saved[0]["source_id"] == 2
    assert [r["reject_reason"] for r in recs.where("status = 'failed'").collect()] == ["Invalid timestamp: not a time"]
