"""Unit cases for the Column functions."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import coords, records, text, timestamps
from tidewater.functions.text import normalise_headers, norm_header_structured


def j1(spark, pairs):
    df = spark.createDataFrame(pairs, "d string, t string")
    out = timestamps.add_python_timestamp(df, F.col("d"), F.col("t"), "ts")
    return [(r["ts"], r["ts_err"]) for r in out.collect()]


def test_j1_date_shapes(spark):
    got = j1(spark, [("01-02-2024", "10:00:00"), ("20240201", "10:00:00"), ("1-2-2024", "10:00:00"),
                     ("20240201.0", "10:00:00"), ("2024/02/01", "10:00:00"), ("31-02-2024", "1:0:0")])
    want = dt.datetime(2024, 2, 1, 10, 0)
    assert [g[0] for g in got[:4]] == [want] * 4
    assert got[4] == (None, "Invalid date format: 2024/02/01")
    assert got[5][0] is None and got[5][1].startswith("Invalid date format")


def test_j1_time_rules(spark):
    got = j1(spark, [
        ("01-01-2024", "NA"), ("01-01-2024", ""), ("01-01-2024", None), ("01-01-2024", "nan"),  # midnight
        ("01-01-2024", "05:30"),            # two parts: minutes:seconds
        ("01-01-2024", "10:05:07 UTC"),     # UTC removed
        ("01-01-2024", "10:05:07, approx"), # cut at the comma
        ("01-01-2024", "25:61:01.5"),       # rolls over, no range checks
        ("01-01-2024", "00:00:45.123"),     # microseconds truncated, then ms
        ("01-01-2024", "ab:cd"),
    ])
    d0 = dt.datetime(2024, 1, 1)
    assert [g[0] for g in got[:4]] == [d0] * 4
    assert got[4][0] == dt.datetime(2024, 1, 1, 0, 5, 30)
    assert got[5][0] == dt.datetime(2024, 1, 1, 10, 5, 7)
    assert got[6][0] == dt.datetime(2024, 1, 1, 10, 5, 7)
    assert got[7][0] == dt.datetime(2024, 1, 2, 2, 1, 1, 500000)
    assert got[8][0] == dt.datetime(2024, 1, 1, 0, 0, 45, 122000)
    assert got[9] == (None, "Invalid time format: AB:CD")


def test_dms(spark):
    df = spark.createDataFrame([("10:30:00 N",), ("10:30:00 S",), (" 045:15:36 W ",), ("10:30:00",),
                                ("10:30 N",), (None,), ("1:2:3 X",)], "v string")
    out = coords.add_dms(df, F.col("v"), "x").collect()
    assert [r["x"] for r in out] == [10.5, -10.5, -45.26, None, None, None, round(1 + 2 / 60 + 3 / 3600, 6)]
    assert out[3]["x_err"] == "Invalid coordinate format: 10:30:00"
    assert out[5]["x_err"] == "Invalid coordinate format: None"


def test_strict_date_time(spark):
    df = spark.createDataFrame([("05-03-2024", "7:5:3"), ("", ""), ("2024-03-05", "24:00:00"), (None, "23:59:59")],
                               "d string, t string")
    out = timestamps.add_strict_time(timestamps.add_strict_date(df, F.col("d"), "dmy", "d1"), F.col("t"), "t1")
    r = out.collect()
    assert (r[0]["d1"], r[0]["t1"]) == (dt.date(2024, 3, 5), "07:05:03")
    assert (r[1]["d1"], r[1]["d1_err"], r[1]["t1"], r[1]["t1_err"]) == (None, None, None, None)
    assert r[2]["d1_err"] == "Invalid date format: 2024-03-05" and r[2]["t1_err"] == "Invalid time format: 24:00:00"
    assert r[3]["t1"] == "23:59:59"


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a b\t", "x.TXT", 1572864, "line1\nline2")], "s string, f string, n long, t string")
    r = df.select(
        text.strip_ws("s").alias("s"), text.file_extension("f").alias("e"), text.size_mb("n").alias("mb"),
        text.word_count("t").alias("wc"), text.first_paragraph("t").alias("fp"),
        text.preview(F.lit("x" * 201)).alias("pv"), text.is_all_digits(F.lit("0042")).alias("dg"),
    ).first()
    assert r["s"] == "a b" and r["e"] == "txt" and r["mb"] == 1.5 and r["wc"] == 2 and r["fp"] == "line1"
    assert r["pv"] == "x" * 200 + "..." and r["dg"] is True


def test_extension_rules(spark):
    names = ["a.csv", "noext", ".bashrc", "a.", "dir.x/file", "a.b.C"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in df.select(text.file_extension("f")).collect()]
    assert got == ["csv", "", "", "", "", "c"]


def test_first_paragraph_blank_first_line(spark):
    df = spark.createDataFrame([(" \t\nsecond\nthird",), ("only",), ("",)], "t string")
    assert [r[0] for r in df.select(text.first_paragraph("t")).collect()] == ["second", "only", ""]


def test_headers():
    assert norm_header_structured("  Lat / Lat\tOrigin ") == "lat / lat origin"


def test_duplicate_headers_fail(spark):
    df = spark.createDataFrame([(1, 2)], "`A` int, `a ` int")
    try:
        normalise_headers(df)
    except ValueError as e:
        assert "duplicate" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_stable_uuid_and_iso(spark):
    df = spark.createDataFrame([("f.csv", 1, dt.datetime(2024, 1, 1, 0, 0, 0, 5))], "f string, r long, ts timestamp_ntz")
    r = df.select(records.stable_uuid("f", "r").alias("u"), records.stable_uuid("f", "r").alias("u2"),
                  timestamps.iso_text(F.col("ts")).alias("iso")).first()
    assert r["u"] == r["u2"] and len(r["u"]) == 36 and r["u"].count("-") == 4
    assert r["iso"] == "2024-01-01T00:00:00.000005"


def test_exif_time_and_coordinates(spark):
    df = spark.createDataFrame([("2024:03:05 10:20:30", 1.5, 2.25), ("not a date", None, 1.0)], "v string, a double, b double")
    stamp, d, t = timestamps.exif_time_fields(F.col("v"))
    r = df.select(stamp.alias("s"), d.alias("d"), t.alias("t"), coords.coordinates_text("a", "b").alias("c")).collect()
    assert (r[0]["s"], r[0]["d"], r[0]["t"], r[0]["c"]) == ("2024-03-05T10:20:30Z", "2024-03-05", "10:20:30", "1.500000, 2.250000")
    assert (r[1]["s"], r[1]["d"], r[1]["c"]) == ("not a date", None, None)


def test_row_json_nan_and_nulls(spark):
    df = spark.createDataFrame([(float("nan"), None, "x")], "a double, b string, c string")
    js = df.select(records.row_json(df).alias("j")).first()["j"]
    assert js == '{"a":null,"b":null,"c":"x"}'


def test_wkt_and_info_map(spark):
    from tidewater.sources.office import document_info_map

    df = spark.createDataFrame([("POINT(1.5 -2)",), ("POINT (a b)",), (None,)], "p string")
    assert [r[0] for r in df.select(coords.wkt_or_invalid("p")).collect()] == ["POINT(1.5 -2)", "Invalid geometry", None]
    m = spark.createDataFrame([({"/Title": "T", "/Author": "", "/Pages": "3"},)], "m map<string,string>")
    assert m.select(document_info_map(F.col("m")).alias("x")).first()["x"] == {"Title": "T", "Pages": "3"}


def test_first_match_and_upload_metadata(spark):
    from tidewater.operators import checks, enrich

    src = spark.createDataFrame([(3, "ais"), (2, "AIS"), (1, "Piracy")], "id int, name string")
    assert enrich.first_match(src, F.lower("name") == "ais").first()["id"] == 2
    summary = spark.createDataFrame([("u", "a.csv", 5)], "file_uuid string, file_name string, saved long")
    m = checks.upload_metadata(summary, 2, 1, "2025-01-01 00:00:00").first()
    assert (m["format"], m["record_count"], m["source_id"]) == ("CSV", 5, 2)
    assert m["timestamp"] == dt.datetime(2025, 1, 1)


def test_word_count_matches_python_split(spark):
    samples = ["a b", "x　y z", " lead trail ", "p\x1cq", "", "   ", "one", "tab\tsep\nnl"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(text.word_count("t")).collect()]
    assert got == [len(s.split()) for s in samples]


def test_cells_are_stripped_as_python_does(spark):
    from tidewater.functions.text import WS_CHARS, strip_cell
    texts = ["", " ", "a", " a", "a ", "a b", "~", "!", "\x7f", "\x7fa", "\u00e9", "\u00e9 ", "x\u00e9", "\u3000x", "x\u3000", "\x1fx", "\U0001f6a2 x", "x\U0001f6a2", None]
    texts += [f"{w}1.5{w}" for w in WS_CHARS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strip_cell(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: None if t is None else t.strip(WS_CHARS) for i, t in enumerate(texts)}


def test_uuid_text(spark):
    import hashlib
    import uuid
    from tidewater.functions.records import stable_uuid
    got = spark.createDataFrame([("f", 7), ("f", None), (None, None)], "a string, b int").select(stable_uuid("a", "b").alias("u"))
    assert [r["u"] for r in got.collect()] == [str(uuid.UUID(hashlib.md5(t).hexdigest())) for t in (b"f:7", b"f", b"")]
