"""Feed converters: raw feed rows -> common record.

Each converter is a pure ``DataFrame -> DataFrame`` of Column expressions, so
it runs unchanged on batch and streaming frames and stays inside whole-stage
codegen: no Python per row, no shuffle. Input frames carry ``file_name`` and
``row_no`` (the file and the row/line inside it) next to the raw text columns,
whose names are already normalised (C9). The output has every column of
``CDF_SCHEMA`` plus ``file_name`` and ``reject_reason``: NULL for a good
record, else the first failing check in the order the reference evaluates
fields (C10). Parsers are staged projections (see ``functions.text.staged``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import dms_layers, wkt_point
from ..functions.records import row_json, stable_uuid
from ..functions.text import (
    first_present,
    is_int_text,
    na_to_null,
    merge_layers,
    norm_header_esm,
    norm_header_tracking,
    normalise_headers,
    numbers_layers,
    staged,
    strip_ws,
    text_or_empty,
)
from ..functions.timestamps import (
    day_first_date,
    iso_timestamp_layers,
    python_timestamp_layers,
    strict_date_layers,
    strict_time_layers,
    zfill2,
)
from ..schemas import CDF_SCHEMA, P8I_ESM_SCHEMA, P8I_TRACKING_SCHEMA, PIRATE_ATTACKS_SCHEMA
from ..session import keep_methods_small

ID_COLUMNS = ("file_name", "row_no")
_OBS_IDS = itertools.count()
BLANK_LINE = "Blank line"

# ---- fixed values -----------------------------------------------------------
# Feed names (compared lower-cased) and the sub-source name lists used to pick
# the tracking converter for P8I rows, per upload path.
FEEDS = ("piracy", "ais", "dmas", "p8i")
P8I_TRACKING_NAMES_STRUCTURED = (
    "redicent", "efficnt", "esmcnt", "eoircnt", "ardrcnt", "esm emit beams", "esm emitters",
)
P8I_TRACKING_NAMES_NDJSON = (
    "redicent", "garud", "globaleye", "falcon", "netra", "sentinel", "jstars", "phalcon",
    "heron", "hera",
)
# -----------------------------------------------------------------------------


class _Raw:
    """Column access on a raw frame where a header may be absent."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def has(self, name: str) -> bool:
        return name in self.names

    def __call__(self, name: str) -> Column:
        if name in self.names:
            return F.col(f"`{name}`").cast("string")
        return F.lit(None).cast("string")


def _missing(name: str) -> Column:
    return F.lit(f"Missing field: {name}")


def structured_cells(df: DataFrame) -> DataFrame:
    """Apply the pandas reading rule to every raw text cell: NA tokens -> NULL."""
    return df.select(*[
        (F.col(f"`{c}`") if c in ID_COLUMNS else na_to_null(c)).alias(c)
        for c in df.columns
    ])


#: The text of the JSON object that an NDJSON row came from.
OBJECT_COLUMN = "_object"


def _raw_json(df: DataFrame) -> Column:
    """J5 + J6: the raw row (without the id columns) as JSON text; a row that
    came as a JSON object is kept as it came."""
    if OBJECT_COLUMN in df.columns:
        return F.col(OBJECT_COLUMN)
    return row_json(df, [c for c in df.columns if c not in ID_COLUMNS])


def _finish(df: DataFrame, feed: str, values: dict, checks: list) -> DataFrame:
    """Project to the full CDF record + reject_reason (first failing check)."""
    values = dict(values)
    values.setdefault("uuid", stable_uuid("file_name", "row_no"))
    values.setdefault("file_uuid", stable_uuid("file_name"))
    values.setdefault("row_no", F.col("row_no").cast("long"))
    values.setdefault("feed", F.lit(feed))
    cols = []
    for field in CDF_SCHEMA.fields:
        v = values.get(field.name)
        v = F.lit(None) if v is None else v
        cols.append(v.cast(field.dataType).alias(field.name))
    checks = [c for c in checks if c is not None]
    reason = F.coalesce(*checks) if checks else F.lit(None)
    out = df.select(*cols, F.col("file_name"), reason.cast("string").alias("reject_reason"))
    return observe_status(out, feed)


def skipped_rows(raw_df: DataFrame, feed: str, reason: str) -> DataFrame:
    """Rows no converter takes (unknown feed), as records with every field
    NULL and ``reason``, so one table schema holds all outcomes."""
    return _finish(raw_df.select("file_name", "row_no"), feed, {}, [F.lit(reason)])


def unreadable_rows(raw_df: DataFrame, feed: str, reason: str, raw_data: str) -> DataFrame:
    """Rows that never reach a converter, with the reason in a column of their own."""
    return _finish(raw_df, feed, {"raw_data": F.col(raw_data)}, [F.col(reason)])


def observe_status(df: DataFrame, label: str) -> DataFrame:
    """Attach the per-conversion counters (rows, saved, failed) as observed
    metrics, delivered to query execution listeners with each action.

    The observation also ends the converter's plan for the optimizer: a
    later filter on ``reject_reason`` is evaluated here instead of being
    rewritten, alias by alias, into every parsing stage below.
    """
    keep_methods_small(df.sparkSession)
    reason = F.col("reject_reason")
    name = f"convert_{label.lower()}_{next(_OBS_IDS)}"
    return df.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(reason.isNull()).alias("saved"),
        F.count_if(reason.isNotNull() & (reason != BLANK_LINE)).alias("failed"),
    )


def _err(name: str) -> Column:
    return F.col(f"{name}_err")


# ---- D4 AIS -------------------------------------------------------------------

def convert_ais(raw_df: DataFrame) -> DataFrame:
    """AIS position rows. Time from ``timestamp`` else ``basedatetime``;
    LAT/LON/SOG/Heading -> latitude/longitude/speed/course (Heading, not COG).
    Missing numbers stay NULL (X8), non-numeric text and a blank or bad time
    are rejects (X16)."""
    r = _Raw(raw_df)
    df = raw_df.select(*[F.col(f"`{c}`") for c in raw_df.columns], _raw_json(raw_df).alias("_raw_json"))
    df = staged(df, *merge_layers(
        [{"_ts_text": text_or_empty(first_present(r("timestamp"), r("basedatetime")))}]
        + iso_timestamp_layers(F.col("_ts_text"), "_ts"),
        numbers_layers([(r("lat"), "_lat", None, "LAT"), (r("lon"), "_lon", None, "LON"),
                        (r("sog"), "_sog", None, "SOG"), (r("heading"), "_heading", None, "Heading")]),
    ))
    values = {
        "logged_timestamp": F.col("_ts"),
        "vessel_name": text_or_empty(r("vesselname")),
        "imo": text_or_empty(r("imo")),
        "mmsi": text_or_empty(r("mmsi")),
        "latitude": F.col("_lat"),
        "longitude": F.col("_lon"),
        "speed": F.col("_sog"),
        "course": F.col("_heading"),
        "raw_data": F.col("_raw_json"),
    }
    checks = [
        None if r.has("sog") else _missing("SOG"),
        None if r.has("heading") else _missing("Heading"),
        _err("_sog"), _err("_heading"), _err("_lat"), _err("_lon"),
        F.when(F.col("_ts").isNull(), F.concat(F.lit("Invalid timestamp: "), F.col("_ts_text"))),
    ]
    return _finish(df, "AIS", values, checks)


# ---- D2 P8I generic CSV -------------------------------------------------------

P8I_CSV_HEADERS = {
    "date": "position valid date yyyymmdd",
    "time": "position valid time hh:mm:ss.sss",
    "lat": "lat / lat origin",
    "lon": "long / long origin",
    "speed": "speed kts / spare",
    "course": "course deg / bearing deg",
}


def convert_p8i_csv(raw_df: DataFrame) -> DataFrame:
    """P8I rows with DMS coordinates and a J1 timestamp. Course (default
    0.0 when the column is absent) fills both bearing and course."""
    r = _Raw(raw_df)
    h = P8I_CSV_HEADERS
    missing = [k for k in (h["date"], h["time"], h["lat"], h["lon"], h["speed"]) if not r.has(k)]
    if missing:  # known when the plan is built: every row fails the same way, nothing to parse
        return _finish(raw_df, "P8I", {"raw_data": _raw_json(raw_df)}, [_missing(missing[0])])
    df = raw_df.select(*[F.col(f"`{c}`") for c in raw_df.columns], _raw_json(raw_df).alias("_raw_json"))
    df = staged(df, *merge_layers(
        python_timestamp_layers(r(h["date"]), r(h["time"]), "_ts"),
        dms_layers(r(h["lat"]), "_lat"),
        dms_layers(r(h["lon"]), "_lon"),
        numbers_layers([(r(h["speed"]), "_speed", None, "Speed Kts / Spare"),
                        (r(h["course"]), "_course", None, "Course Deg / Bearing Deg")]),
    ))
    course = F.col("_course") if r.has(h["course"]) else F.lit(0.0)
    values = {
        "latitude": F.col("_lat"),
        "longitude": F.col("_lon"),
        "speed": F.col("_speed"),
        "bearing": course,
        "course": course,
        "logged_timestamp": F.col("_ts"),
        "raw_data": F.col("_raw_json"),
    }
    checks = [_err("_ts"), _err("_lat"), _err("_lon"), _err("_speed"), _err("_course")]
    return _finish(df, "P8I", values, checks)


# ---- D1 DMAS (NDJSON) -----------------------------------------------------------

DMAS_SCHEMA = (
    "latitude string, longitude string, speed string, bearing string, course string, "
    "sys_trk_no string, struct_update_track_timestamp struct<date_dd:string, date_mm:string, "
    "date_yy:string, time_hour:string, time_minute:string, time_second:string>, "
    "_corrupt_record string"
)
_DMAS_NUMBERS = ("latitude", "longitude", "speed", "bearing", "course")


def convert_dmas(lines: DataFrame, value_col: str = "value", keep_blank: bool = False) -> DataFrame:
    """DMAS NDJSON lines (``file_name``, ``row_no``, ``value``).

    Blank lines are dropped (C2); with ``keep_blank`` they stay, marked
    with the reason ``BLANK_LINE``, so one scan feeds both the records and
    the attempted-line count (F2). A line that is not a JSON object is a
    reject; the date parts are zero-padded (J9) with defaults, so a record
    without its timestamp struct fails as 'Invalid date format: 00-00-0000'.
    Numbers are required; the point is built from the raw texts (J4).
    """
    text = F.col(value_col)
    df = staged(lines, {"_blank": strip_ws(F.coalesce(text, F.lit(""))) == ""})
    if not keep_blank:
        df = df.where(~F.col("_blank"))
    j = F.from_json(text, DMAS_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    df = df.select("file_name", "row_no", "_blank", text.alias("_line"), j.alias("j"))
    t = F.col("j.struct_update_track_timestamp")
    df = staged(df, {
        "_md": F.concat(zfill2(F.coalesce(t.date_dd, F.lit("00"))), F.lit("-"),
                        zfill2(F.coalesce(t.date_mm, F.lit("00"))), F.lit("-"),
                        F.coalesce(t.date_yy, F.lit("0000"))),
        "_mt": F.concat(zfill2(F.coalesce(t.time_hour, F.lit("00"))), F.lit(":"),
                        zfill2(F.coalesce(t.time_minute, F.lit("00"))), F.lit(":"),
                        F.coalesce(t.time_second, F.lit("00"))),
        "_trk": F.col("j.sys_trk_no"),
    })
    df = staged(df, *merge_layers(
        python_timestamp_layers(F.col("_md"), F.col("_mt"), "_ts"),
        numbers_layers([(F.col(f"j.{n}"), f"_{n}", None, n) for n in _DMAS_NUMBERS]),
        [{"_trk_int": F.when(is_int_text(F.col("_trk")), F.col("_trk").try_cast("int"))}],
    ))

    def required(n):
        return F.when(F.col(f"_{n}").isNull(), F.concat(
            F.lit(f"Invalid number for {n}: "), F.coalesce(F.col(f"j.{n}"), F.lit("None"))))

    values = {n: F.col(f"_{n}") for n in _DMAS_NUMBERS}
    values.update({
        "logged_timestamp": F.col("_ts"),
        "sys_trk_no": F.col("_trk_int"),
        "location": wkt_point(F.col("j.longitude"), F.col("j.latitude")),
        "raw_data": F.col("_line"),
    })
    checks = [
        F.when(F.col("_blank"), F.lit(BLANK_LINE)),
        F.when(F.col("j._corrupt_record").isNotNull(), F.lit("Invalid JSON")),
        F.when(_err("_ts").isNotNull(), F.concat(F.lit("Invalid date format: "), F.col("_md"))),
        *[required(n) for n in _DMAS_NUMBERS],
        F.when(F.col("_trk_int").isNull(), F.concat(F.lit("Invalid integer for sys_trk_no: "),
                                                    F.coalesce(F.col("_trk"), F.lit("None")))),
    ]
    return _finish(df, "DMAS", values, checks)


# ---- D3 piracy ------------------------------------------------------------------

def convert_piracy(raw_df: DataFrame) -> DataFrame:
    """D3: piracy incident rows: J1 time from date+time, coordinates passed
    through as numbers, trimmed vessel name, the row as JSON."""
    r = _Raw(raw_df)
    df = raw_df.select(*[F.col(f"`{c}`") for c in raw_df.columns], _raw_json(raw_df).alias("_raw_json"))
    df = staged(df, *merge_layers(
        python_timestamp_layers(r("date"), r("time"), "_ts"),
        numbers_layers([(r("latitude"), "_lat", None, "latitude"), (r("longitude"), "_lon", None, "longitude")]),
    ))
    values = {
        "latitude": F.col("_lat"),
        "longitude": F.col("_lon"),
        "logged_timestamp": F.col("_ts"),
        "raw_data": F.col("_raw_json"),
        "vessel_name": text_or_empty(r("vessel_name")),
    }
    return _finish(df, "Piracy", values, [_err("_ts"), _err("_lat"), _err("_lon")])


# ---- D5 P8I tracking ------------------------------------------------------------

_TRACK_NUMBERS = ("latitude", "longitude", "altitude", "course", "bearing", "speed")


def convert_p8i_tracking_rows(raw_df: DataFrame) -> DataFrame:
    """D5 in its own table shape (``P8I_TRACKING_SCHEMA`` + reject_reason).

    Headers stripped and lower-cased; dates d-M-yyyy (msg_date) and yyyyMMdd
    / d-M-yyyy (position date); times H:M:S; numbers absent, blank or
    missing -> 0.0 (X24), non-numeric text -> reject. The record id and the
    true file id are both kept (X7).
    """
    df = normalise_headers(raw_df, norm_header_tracking)
    r = _Raw(df)
    ymd = r("position valid date yyyymmdd")
    df = staged(df, *merge_layers(
        [{"_use_ymd": F.coalesce(ymd, F.lit("")) != ""}],
        strict_date_layers(r("msg_date"), "dmy", "_msg_date"),
        strict_time_layers(r("msg_time"), "_msg_time"),
        [{}, {"_pvd_src": F.when(F.col("_use_ymd"), ymd).otherwise(r("position_valid_date"))}]
        + strict_date_layers(F.col("_pvd_src"), F.col("_use_ymd"), "_pvd"),
        strict_time_layers(r("position_valid_time"), "_pvt"),
        numbers_layers([(r(n), f"_{n}", 0.0, n) for n in _TRACK_NUMBERS]),
    ))
    values = {
        "uuid": stable_uuid("file_name", "row_no"),
        "file_uuid": stable_uuid("file_name"),
        "row_no": F.col("row_no").cast("long"),
        "msg_date": F.col("_msg_date"),
        "msg_time": F.col("_msg_time"),
        "change_type": r("change_type"),
        "position_valid_date": F.col("_pvd"),
        "position_valid_time": F.col("_pvt"),
        "trk_short_name": r("trk_short_name"),
        "sub_source_name": r("sub_source_name"),
    }
    values.update({n: F.col(f"_{n}") for n in _TRACK_NUMBERS})
    checks = [_err("_msg_date"), _err("_msg_time")] + [_err(f"_{n}") for n in _TRACK_NUMBERS] + [
        _err("_pvd"), _err("_pvt")]
    cols = [values[f.name].cast(f.dataType).alias(f.name) for f in P8I_TRACKING_SCHEMA.fields]
    return observe_status(df.select(*cols, F.col("file_name"), F.coalesce(*checks).alias("reject_reason")), "tracking")


def convert_p8i_tracking(raw_df: DataFrame) -> DataFrame:
    """D5 as a common record (what the P8I upload path stores)."""
    t = convert_p8i_tracking_rows(raw_df)
    keep = {f.name for f in CDF_SCHEMA.fields} & set(t.columns)
    values = {n: F.col(n) for n in keep}
    return _finish(t, "P8I", values, [F.col("reject_reason")])


# ---- D6 P8I ESM -----------------------------------------------------------------

_ESM_NUMBERS = ("amplitude", "frequency", "azimuth_degree", "latitude", "longitude", "azimuth_accuracy_degree")


def convert_p8i_esm(raw_df: DataFrame) -> DataFrame:
    """ESM emitter rows in their own table shape (``P8I_ESM_SCHEMA``).

    The position date is required (first present of three header names);
    its format is yyyyMMdd when it came from 'position valid date yyyymmdd',
    else d-M-yyyy. Numbers absent/blank/missing -> 0.0."""
    df = normalise_headers(raw_df, norm_header_esm)
    r = _Raw(df)
    ymd_raw = r("position valid date yyyymmdd")
    df = staged(df, {
        "_use_ymd": F.coalesce(ymd_raw, F.lit("")) != "",
        "_pos_date": first_present(ymd_raw, r("position_valid_date"), r("date")),
        "_pos_time": first_present(r("position valid time"), r("position_valid_time"), r("time")),
    })
    df = staged(df, *merge_layers(
        strict_date_layers(F.col("_pos_date"), F.col("_use_ymd"), "_pvd"),
        strict_date_layers(r("msg_date"), "dmy", "_msg_date"),
        strict_time_layers(r("msg_time"), "_msg_time"),
        strict_time_layers(F.col("_pos_time"), "_pvt"),
        strict_date_layers(r("last_beam_intercept_date"), "dmy", "_lbd"),
        strict_time_layers(r("last_beam_intercept_time"), "_lbt"),
        numbers_layers([(r(n), f"_{n}", 0.0, n) for n in _ESM_NUMBERS]),
    ))
    values = {
        "uuid": stable_uuid("file_name", "row_no"),
        "file_uuid": stable_uuid("file_name"),
        "row_no": F.col("row_no").cast("long"),
        "msg_date": F.col("_msg_date"),
        "msg_time": F.col("_msg_time"),
        "emitter": r("emitter"),
        "emitter_enumeration": r("emitter_enumeration"),
        "beam_enumeration": r("beam_enumeration"),
        "change_type": r("change_type"),
        "Position Valid Date YYYYMMDD": F.col("_pvd"),
        "Position Valid Time": F.col("_pvt"),
        "last_beam_intercept_date": F.col("_lbd"),
        "last_beam_intercept_time": F.col("_lbt"),
        "sub_source_name": r("sub_source_name"),
    }
    values.update({n: F.col(f"_{n}") for n in _ESM_NUMBERS})
    checks = [
        F.when(F.col("_pos_date").isNull(), F.lit("Missing required field: Position Valid Date YYYYMMDD")),
        _err("_msg_date"), _err("_msg_time"), _err("_amplitude"), _err("_frequency"),
        _err("_pvd"), _err("_pvt"), _err("_lbd"), _err("_lbt"),
        _err("_azimuth_degree"), _err("_latitude"), _err("_longitude"), _err("_azimuth_accuracy_degree"),
    ]
    cols = [values[f.name].cast(f.dataType).alias(f.name) for f in P8I_ESM_SCHEMA.fields]
    return observe_status(df.select(*cols, F.col("file_name"), F.coalesce(*checks).alias("reject_reason")), "esm")


# ---- D7 pirate attack load ------------------------------------------------------

_PIRACY_DOUBLES = {"longitude", "latitude", "shore_distance", "shore_longitude", "shore_latitude"}
PIRACY_FIELDS = PIRATE_ATTACKS_SCHEMA.fields


def load_pirate_attacks(raw_df: DataFrame) -> DataFrame:
    """Day-first date (J13), rows without a date dropped (C7), NA -> NULL
    (C8, already done by the reader rule), the 15 target columns (C5)."""
    r = _Raw(raw_df)
    df = staged(raw_df, *numbers_layers([(r(n), f"_{n}", None, n) for n in sorted(_PIRACY_DOUBLES)]))
    cols = []
    for f in PIRACY_FIELDS:
        if f.name == "attack_datetime":
            v = day_first_date(r("date")).cast("timestamp_ntz")
        elif f.name in _PIRACY_DOUBLES:
            v = F.col(f"_{f.name}")
        else:
            v = r(f.name)
        cols.append(v.cast(f.dataType).alias(f.name))
    return df.select(*cols).where(F.col("attack_datetime").isNotNull())


# ---- dispatch (C11, C12) ----------------------------------------------------------

def p8i_converter_name(sub_source_name: Column, path: str = "structured") -> Column:
    """C12: 'tracking' when the lower-cased sub-source name is in the path's
    list, else 'p8i_csv' (the generic DMS converter)."""
    names = P8I_TRACKING_NAMES_STRUCTURED if path == "structured" else P8I_TRACKING_NAMES_NDJSON
    key = F.lower(F.coalesce(sub_source_name, F.lit("")))
    return F.when(key.isin(*names), F.lit("tracking")).otherwise(F.lit("p8i_csv"))


def convert_p8i(raw_df: DataFrame, path: str = "structured") -> DataFrame:
    """P8I rows go row by row to the tracking or the generic converter;
    both halves are narrow projections over the same scan, then unioned."""
    r = _Raw(raw_df)
    which = p8i_converter_name(r("sub_source_name"), path)
    tagged = raw_df.withColumn("_conv", which)
    tracking = convert_p8i_tracking(tagged.where(F.col("_conv") == "tracking").drop("_conv"))
    generic = convert_p8i_csv(tagged.where(F.col("_conv") == "p8i_csv").drop("_conv"))
    return tracking.unionByName(generic)


def convert_feed(raw_df: DataFrame, feed: str, path: str = "structured") -> DataFrame | None:
    """C11: pick the converter by feed name (case-insensitive) on the driver,
    one feed per file. Unknown feed -> None (the caller reports it skipped)."""
    key = (feed or "").lower()
    if key == "piracy":
        return convert_piracy(raw_df)
    if key == "ais":
        return convert_ais(raw_df)
    if key == "dmas":
        # a row of a delimited file is taken as the JSON object of its cells
        lines = raw_df if "value" in raw_df.columns else raw_df.select("file_name", "row_no", _raw_json(raw_df).alias("value"))
        return convert_dmas(lines)
    if key == "p8i":
        return convert_p8i(raw_df, path)
    return None


def record_status(reason) -> Column:
    """'saved', 'skipped' (blank line) or 'failed'."""
    r = F.col(reason) if isinstance(reason, str) else reason
    return F.when(r.isNull(), F.lit("saved")).when(r == BLANK_LINE, F.lit("skipped")).otherwise(F.lit("failed"))


def split_rejects(converted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, rejects with reason). Both read the same plan; a
    writer that needs both should write once partitioned by status."""
    status = record_status("reject_reason")
    good = converted.where(status == "saved").drop("reject_reason")
    bad = converted.where(status == "failed")
    return good, bad
