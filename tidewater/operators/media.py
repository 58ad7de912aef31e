"""Image and document profiles over tables (SURVEY 2.10: F7, M3, M6, J3, J17,
J19, J20, J24-J26). The binary readers that produce these tables from files
live in :mod:`tidewater.sources.files`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import coordinates_text, exif_degrees
from ..functions.text import first_paragraph, preview, word_count
from ..functions.timestamps import exif_time_fields

# ---- fixed values -----------------------------------------------------------
CAMERA_TAGS = ("Make", "Model", "Software", "Artist", "Copyright")
GPS_TAGS = ("GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef")
# -----------------------------------------------------------------------------


def _tag(name: str):
    return F.max(F.when(F.col("tag") == name, F.col("value")))


def fold_exif(tags: DataFrame) -> DataFrame:
    """the long (file_uuid, filename, tag, value) table -> one row per
    image with the tags the record needs. A plain aggregate with partial
    (map-side) folding; no per-image list is gathered."""
    aggs = [F.max("filename").alias("filename")]
    aggs += [_tag(t).alias(t) for t in CAMERA_TAGS + GPS_TAGS + ("DateTime", "DateTimeOriginal")]
    aggs.append(F.max(F.col("tag").startswith("GPS").cast("int")).alias("_gps_tags"))
    return tags.groupBy("file_uuid").agg(*aggs)


def image_record(tags: DataFrame) -> DataFrame:
    """M3: camera info, GPS position and time of each image (X9: the EXIF
    time is parsed; DateTimeOriginal wins over DateTime)."""
    w = fold_exif(tags)
    lat = exif_degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef"))
    lon = exif_degrees(F.col("GPSLongitude"), F.col("GPSLongitudeRef"))
    raw_time = F.coalesce(F.col("DateTimeOriginal"), F.col("DateTime"))
    stamp, date_taken, time_taken = exif_time_fields(raw_time)
    camera = F.map_filter(
        F.create_map(*[x for t in CAMERA_TAGS for x in (F.lit(t.lower()), F.col(t))]),
        lambda k, v: v.isNotNull(),
    )
    return w.select(
        "file_uuid", "filename",
        F.col("Make").alias("camera_make"), F.col("Model").alias("camera_model"),
        camera.alias("camera_info"),
        lat.alias("latitude"), lon.alias("longitude"),
        coordinates_text(lat, lon).alias("coordinates"),
        (F.col("_gps_tags") == 1).alias("has_gps"),
        stamp.alias("timestamp"), date_taken.alias("date_taken"), time_taken.alias("time_taken"),
    )


def image_summary(records: DataFrame) -> DataFrame:
    """M3 summary block (J17): presence flags and the headline fields."""
    return records.select(
        "file_uuid", "filename",
        F.col("has_gps"),
        (F.size("camera_info") > 0).alias("has_camera_info"),
        (F.coalesce(F.col("timestamp"), F.lit("")) != "").alias("has_timestamp"),
        "timestamp", "camera_make", "camera_model",
        F.col("coordinates").alias("gps_coordinates"),
    )


def image_document(tags: DataFrame) -> DataFrame:
    """M3, the whole document that is stored for an image: camera info, GPS
    data, times and the summary's flags (X10: always filled)."""
    rec = image_record(tags)
    gps = F.struct("latitude", "longitude", "coordinates")
    return rec.select(
        "file_uuid", "filename", "camera_make", "camera_model", "camera_info",
        F.when(F.col("has_gps"), gps).alias("gps_data"), "latitude", "longitude", F.col("coordinates").alias("gps_coordinates"),
        "timestamp", "date_taken", "time_taken", "has_gps", (F.size("camera_info") > 0).alias("has_camera_info"),
        (F.coalesce(F.col("timestamp"), F.lit("")) != "").alias("has_timestamp"))


def text_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M6: length, word count and first paragraph (cut at 200 + '...') of
    whole texts; all JVM-side string functions."""
    t = F.col(text_col)
    return docs.select(
        F.col(id_col),
        F.length(t).cast("long").alias("text_length"),
        word_count(t).cast("long").alias("word_count"),
        preview(first_paragraph(t)).alias("first_paragraph"),
    )
