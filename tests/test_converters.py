"""Converters on small literal frames: every feed, its rejects and the
adopted semantics of SURVEY 2.13."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import converters as C
from tidewater.operators.routing import route_p8i


def frame(spark, cols, data):
    df = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in cols))
    return df.select(F.lit("f.csv").alias("file_name"), F.monotonically_increasing_id().alias("row_no"), "*")


def test_ais_missing_vs_bad(spark):
    raw = C.structured_cells(frame(spark, ["basedatetime", "lat", "lon", "sog", "heading", "vesselname", "imo", "mmsi"], [
        ("2024-01-01T00:00:00", "1.5", "2.5", "NA", "", "  MV A ", None, "1"),     # missing -> NULL (X8)
        ("2024-01-01T00:00:00", "1.5", "2.5", "fast", "10", "B", "2", "3"),        # bad number -> reject
        ("", "1.5", "2.5", "3", "10", "C", "2", "3"),                               # blank time -> reject (X16)
    ]))
    out = C.convert_ais(raw).orderBy("row_no").collect()
    assert out[0]["reject_reason"] is None and out[0]["speed"] is None and out[0]["course"] is None
    assert out[0]["vessel_name"] == "MV A" and out[0]["imo"] == ""
    assert out[0]["logged_timestamp"] == dt.datetime(2024, 1, 1)
    assert out[1]["reject_reason"] == "Invalid number for SOG: fast"
    assert out[2]["reject_reason"].startswith("Invalid timestamp")


def test_refined_speed_excludes_missing(spark):
    raw = C.structured_cells(frame(spark, ["basedatetime", "lat", "lon", "sog", "heading"], [
        ("2024-01-01T00:00:00", "1", "2", "NaN", "1"), ("2024-01-01T00:00:00", "1", "2", "11", "1")]))
    good, _ = C.split_rejects(C.convert_ais(raw))
    assert [r["speed"] for r in good.where("speed > 10").collect()] == [11.0]


def test_p8i_csv(spark):
    cols = list(C.P8I_CSV_HEADERS.values())
    raw = C.structured_cells(frame(spark, cols, [
        ("20240105", "10:00:00.500", "10:30:00 N", "020:15:00 W", "12.5", None),
        ("20240105", "NA", "10:30:00", "020:15:00 W", "12.5", "90"),
    ]))
    out = C.convert_p8i_csv(raw).orderBy("row_no").collect()
    assert (out[0]["latitude"], out[0]["longitude"], out[0]["course"]) == (10.5, -20.25, None)
    assert out[0]["logged_timestamp"] == dt.datetime(2024, 1, 5, 10, 0, 0, 500000)
    assert out[1]["reject_reason"] == "Invalid coordinate format: 10:30:00"


def test_p8i_csv_without_course_column(spark):
    cols = [v for k, v in C.P8I_CSV_HEADERS.items() if k != "course"]
    raw = frame(spark, cols, [("20240105", "1:2:3", "1:0:0 N", "1:0:0 E", "3")])
    r = C.convert_p8i_csv(raw).first()
    assert (r["course"], r["bearing"], r["reject_reason"]) == (0.0, 0.0, None)


def test_dmas_lines(spark):
    good = ('{"latitude": "1.5", "longitude": "2.5", "speed": "3", "bearing": "4", "course": "5", "sys_trk_no": "7", '
            '"struct_update_track_timestamp": {"date_dd": "5", "date_mm": "3", "date_yy": "2024", '
            '"time_hour": "7", "time_minute": "8", "time_second": "9.5"}}')
    no_ts = '{"latitude": "1.5", "longitude": "2.5", "speed": "3", "bearing": "4", "course": "5", "sys_trk_no": "7"}'
    lines = spark.createDataFrame([("f.ndjson", 0, good), ("f.ndjson", 1, "  "), ("f.ndjson", 2, '{"latitude": '),
                                   ("f.ndjson", 3, no_ts)], "file_name string, row_no long, value string")
    out = {r["row_no"]: r for r in C.convert_dmas(lines, keep_blank=True).collect()}
    assert out[0]["reject_reason"] is None and out[0]["location"] == "POINT(2.5 1.5)"
    assert out[0]["logged_timestamp"] == dt.datetime(2024, 3, 5, 7, 8, 9, 500000) and out[0]["sys_trk_no"] == 7
    assert out[1]["reject_reason"] == C.BLANK_LINE
    assert out[2]["reject_reason"] == "Invalid JSON"
    assert out[3]["reject_reason"] == "Invalid date format: 00-00-0000"
    assert 1 not in {r["row_no"] for r in C.convert_dmas(lines).collect()}


def test_piracy_and_load(spark):
    cols = ["date", "time", "latitude", "longitude", "vessel_name", "attack_type"]
    raw = C.structured_cells(frame(spark, cols, [("05-03-2020", "NA", "1.5", "2.5", " MV X ", "NA"),
                                                ("unknown", "10:00:00", "1", "2", "Y", "b")]))
    out = C.convert_piracy(raw).orderBy("row_no").collect()
    assert out[0]["logged_timestamp"] == dt.datetime(2020, 3, 5) and out[0]["vessel_name"] == "MV X"
    assert out[1]["reject_reason"] == "Invalid date format: unknown"
    loaded = C.load_pirate_attacks(raw).collect()
    assert len(loaded) == 1 and loaded[0]["attack_type"] is None and loaded[0]["latitude"] == 1.5


def test_tracking_and_esm(spark):
    t = C.structured_cells(frame(spark, ["msg_date", "msg_time", "speed", "position valid date yyyymmdd",
                                         "position_valid_time", "sub_source_name"], [
        ("05-03-2024", "", "", "20240305", "1:2:3", "Redicent"),
        ("05-03-2024", "10:00:00", "fast", "20240305", "1:2:3", "Redicent")]))
    out = C.convert_p8i_tracking_rows(t).orderBy("row_no").collect()
    assert out[0]["msg_time"] is None and out[0]["speed"] == 0.0 and out[0]["position_valid_time"] == "01:02:03"
    assert out[0]["latitude"] == 0.0 and out[0]["reject_reason"] is None
    assert out[1]["reject_reason"] == "Invalid number for speed: fast"
    e = C.structured_cells(frame(spark, ["msg_date", "position_valid_date", "amplitude", "date"], [
        ("05-03-2024", "06-03-2024", "", None), ("05-03-2024", None, "1", None)]))
    out = C.convert_p8i_esm(e).orderBy("row_no").collect()
    assert out[0]["Position Valid Date YYYYMMDD"] == dt.date(2024, 3, 6) and out[0]["amplitude"] == 0.0
    assert out[1]["reject_reason"] == "Missing required field: Position Valid Date YYYYMMDD"


def test_routing_and_dispatch(spark):
    df = spark.createDataFrame([("Redicent",), ("Esm emitters",), ("Falcon",), ("",), (None,)], "sub_source_name string")
    r = route_p8i(df).collect()
    assert [x["target_table"] for x in r] == ["p8i_tracking.tracking_data", "p8i_esm.esm_data", None, None, None]
    assert r[2]["route_error"] == "Unknown sub_source: Falcon"
    conv = [x[0] for x in df.select(C.p8i_converter_name(F.col("sub_source_name"))).collect()]
    assert conv == ["tracking", "tracking", "p8i_csv", "p8i_csv", "p8i_csv"]
    assert C.convert_feed(df, "radar") is None


def test_refine_with_sql_writes_csv(spark, tmp_path):
    from tidewater.operators.refine import refine_with_sql

    rec = spark.createDataFrame([(1.0, 2.0, 11.0), (1.0, 2.0, None), (3.0, 4.0, 9.0)],
                                "latitude double, longitude double, speed double")
    out = refine_with_sql(rec, 10, str(tmp_path / "refined"))
    assert [r["speed"] for r in out.collect()] == [11.0]
    assert any(p.name.endswith(".csv") for p in (tmp_path / "refined").iterdir())


def test_ndjson_paths_for_other_feeds(spark):
    """AIS, piracy and P8I records in NDJSON go through the same
    converters (keys compared lower-cased); P8I uses the NDJSON name list."""
    from tidewater.operators.ingest import convert_ndjson

    def lines(*objs):
        return spark.createDataFrame([("f.ndjson", i, o) for i, o in enumerate(objs)],
                                     "file_name string, row_no long, value string")

    ais = convert_ndjson(lines('{"BaseDateTime": "2024-01-01T00:00:00", "LAT": "1", "LON": "2", "SOG": "3", "Heading": "4"}',
                               ""), "AIS").collect()
    assert len(ais) == 1 and ais[0]["speed"] == 3.0 and ais[0]["reject_reason"] is None
    pir = convert_ndjson(lines('{"date": "05-03-2020", "time": "NA", "latitude": "1", "longitude": "2"}'), "Piracy").first()
    assert pir["logged_timestamp"] == dt.datetime(2020, 3, 5)
    p8i = {r["row_no"]: r for r in convert_ndjson(lines(
        '{"sub_source_name": "Garud", "msg_date": "05-03-2024", "speed": "2"}',
        '{"sub_source_name": "Efficnt", "speed": "2"}'), "p8i").collect()}
    assert p8i[0]["reject_reason"] is None and p8i[0]["speed"] == 2.0 and p8i[0]["msg_date"] == dt.date(2024, 3, 5)
    assert p8i[1]["reject_reason"].startswith("Invalid date format") or p8i[1]["reject_reason"].startswith("Invalid coordinate")
    assert convert_ndjson(lines("{}"), "radar") is None


def test_ais_time_shapes_and_rejects(spark):
    times = {"2024-01-01T10:00": "2024-01-01T10:00:00", "2024-01-01 10:00Z": "2024-01-01T10:00:00", "2024-01-01T10:00:05.25+05:30": "2024-01-01T04:30:05.250000",
             "2024-01-01T23:30:00-0100": "2024-01-02T00:30:00", "2024-01-01T10:00:00+02": "2024-01-01T08:00:00", "2024-01-01": None, "2024-02-30T00:00:00": None, "": None}
    from tidewater.functions.timestamps import add_iso_timestamp, iso_text

    df = add_iso_timestamp(spark.createDataFrame([(t,) for t in times], "t string"), "t", "ts")
    assert {r.t: r.x for r in df.select("t", iso_text("ts").alias("x")).collect()} == times


def test_parsing_stages_are_methods_that_the_jvm_compiles(spark):
    from tidewater.session import METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT, keep_methods_small
    spark.conf.unset(METHOD_CONF)
    C.convert_ais(spark.createDataFrame([("f", 1, "0")], "file_name string, row_no int, lat string"))
    assert spark.conf.get(METHOD_CONF) == METHOD_LIMIT != METHOD_DEFAULT
    spark.conf.set(METHOD_CONF, "20000")
    keep_methods_small(spark)
    assert spark.conf.get(METHOD_CONF) == "20000"
    spark.conf.unset(METHOD_CONF)
