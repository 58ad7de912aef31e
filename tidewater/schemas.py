"""Table schemas of the common record ("CDF") and the side tables."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


# The common record. Times of day are kept as 'HH:mm:ss' text (the TIME type is
# off by default in this Spark); the point is WKT text plus the two doubles.
CDF_SCHEMA = _s(
    ("uuid", StringType()),
    ("file_uuid", StringType()),
    ("row_no", LongType()),
    ("feed", StringType()),
    ("source_id", IntegerType()),
    ("sub_source_id", IntegerType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("speed", DoubleType()),
    ("bearing", DoubleType()),
    ("course", DoubleType()),
    ("altitude", DoubleType()),
    ("sys_trk_no", IntegerType()),
    ("location", StringType()),
    ("raw_data", StringType()),
    ("logged_timestamp", TimestampNTZType()),
    ("msg_date", DateType()),
    ("msg_time", StringType()),
    ("change_type", StringType()),
    ("trk_short_name", StringType()),
    ("position_valid_date", DateType()),
    ("position_valid_time", StringType()),
    ("trk_display_number", StringType()),
    ("sub_source_name", StringType()),
    ("vessel_name", StringType()),
    ("imo", StringType()),
    ("mmsi", StringType()),
)

CDF_COLUMNS = [f.name for f in CDF_SCHEMA.fields]

REJECT_SCHEMA = _s(
    ("file_uuid", StringType()),
    ("row_no", LongType()),
    ("feed", StringType()),
    ("reject_reason", StringType()),
    ("raw_data", StringType()),
)

SOURCE_SCHEMA = _s(("id", IntegerType()), ("name", StringType()))
SUB_SOURCE_SCHEMA = _s(("id", IntegerType()), ("name", StringType()), ("source_id", IntegerType()))

UPLOAD_METADATA_SCHEMA = _s(
    ("file_uuid", StringType()),
    ("file_name", StringType()),
    ("source_id", IntegerType()),
    ("sub_source_id", IntegerType()),
    ("format", StringType()),
    ("record_count", LongType()),
    ("timestamp", TimestampNTZType()),
)

# One row per stored file; the timestamp is UTC text 'YYYY-MM-DD HH:MM:SS'.
FILE_CATALOG_SCHEMA = _s(
    ("uuid", StringType()),
    ("filename", StringType()),
    ("timestamp", StringType()),
    ("type", StringType()),
    ("bucket", StringType()),
    ("content_type", StringType()),
    ("size", LongType()),
    ("source", StringType()),
)

PIRATE_ATTACKS_SCHEMA = _s(
    ("attack_datetime", TimestampNTZType()),
    ("longitude", DoubleType()),
    ("latitude", DoubleType()),
    ("attack_type", StringType()),
    ("location_description", StringType()),
    ("nearest_country", StringType()),
    ("eez_country", StringType()),
    ("shore_distance", DoubleType()),
    ("shore_longitude", DoubleType()),
    ("shore_latitude", DoubleType()),
    ("attack_description", StringType()),
    ("vessel_name", StringType()),
    ("vessel_type", StringType()),
    ("vessel_status", StringType()),
    ("data_source", StringType()),
)

P8I_TRACKING_SCHEMA = _s(
    ("uuid", StringType()),
    ("file_uuid", StringType()),
    ("row_no", LongType()),
    ("msg_date", DateType()),
    ("msg_time", StringType()),
    ("change_type", StringType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("altitude", DoubleType()),
    ("course", DoubleType()),
    ("bearing", DoubleType()),
    ("speed", DoubleType()),
    ("position_valid_date", DateType()),
    ("position_valid_time", StringType()),
    ("trk_short_name", StringType()),
    ("sub_source_name", StringType()),
)

P8I_ESM_SCHEMA = _s(
    ("uuid", StringType()),
    ("file_uuid", StringType()),
    ("row_no", LongType()),
    ("msg_date", DateType()),
    ("msg_time", StringType()),
    ("emitter", StringType()),
    ("emitter_enumeration", StringType()),
    ("beam_enumeration", StringType()),
    ("change_type", StringType()),
    ("amplitude", DoubleType()),
    ("frequency", DoubleType()),
    ("Position Valid Date YYYYMMDD", DateType()),
    ("Position Valid Time", StringType()),
    ("last_beam_intercept_date", DateType()),
    ("last_beam_intercept_time", StringType()),
    ("azimuth_degree", DoubleType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("azimuth_accuracy_degree", DoubleType()),
    ("sub_source_name", StringType()),
)

EXIF_TAG_SCHEMA = _s(
    ("file_uuid", StringType()),
    ("filename", StringType()),
    ("tag", StringType()),
    ("value", StringType()),
)
