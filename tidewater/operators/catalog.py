"""File catalogue.

A catalogue row describes one stored upload: uuid, filename, timestamp,
type, bucket, content type, size and source. Files are not copied into
buckets; the bucket is a derived column, and "what the store would return"
is computed from the catalogue history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, file_extension, size_mb

# ---- fixed values -----------------------------------------------------------
# Upload kinds, tested in this order (first match wins).
NDJSON_TYPES = ("application/x-ndjson", "application/json")
STRUCTURED_TYPES = ("text/csv", "application/vnd.ms-excel",
                    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
STRUCTURED_SUFFIXES = (".csv", ".tsv", ".xlsx")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
AUDIO_SUFFIXES = (".mp3", ".wav")
# Category -> bucket.
CATEGORY_BUCKETS = {"image": "images", "pdf": "pdf", "video": "videos", "audio": "audio",
                    "csv": "csv", "json": "json"}
# -----------------------------------------------------------------------------


def _ends(name: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def file_kind(content_type, filename) -> Column:
    """C14: 'ndjson', 'structured', 'image', 'audio', 'pdf' or 'unsupported'
    from the content type or the lower-cased file name (X23: .tsv and .xlsx
    count as structured too)."""
    ct = F.coalesce(col_(content_type), F.lit(""))
    name = F.lower(F.coalesce(col_(filename), F.lit("")))
    return (
        F.when(ct.isin(*NDJSON_TYPES) | name.endswith(".ndjson"), F.lit("ndjson"))
        .when(ct.isin(*STRUCTURED_TYPES) | _ends(name, STRUCTURED_SUFFIXES), F.lit("structured"))
        .when(ct.startswith("image/") | _ends(name, IMAGE_SUFFIXES), F.lit("image"))
        .when(ct.startswith("audio/") | _ends(name, AUDIO_SUFFIXES), F.lit("audio"))
        .when((ct == "application/pdf") | name.endswith(".pdf"), F.lit("pdf"))
        .otherwise(F.lit("unsupported"))
    )


def file_category(content_type) -> Column:
    """MIME type -> category, NULL when unknown."""
    ct = F.coalesce(col_(content_type), F.lit(""))
    return (
        F.when(ct.startswith("image/"), F.lit("image"))
        .when(ct == "application/pdf", F.lit("pdf"))
        .when(ct.startswith("video/"), F.lit("video"))
        .when(ct.startswith("audio/"), F.lit("audio"))
        .when(ct.isin("text/csv", "application/vnd.ms-excel"), F.lit("csv"))
        .when(ct == "application/json", F.lit("json"))
    )


def bucket_for(category: Column, filename) -> Column:
    """Category bucket, else '<ext>-files', else 'misc-files'."""
    ext = file_extension(filename)
    by_cat = F.create_map(*[x for k, v in CATEGORY_BUCKETS.items() for x in (F.lit(k), F.lit(v))])[category]
    return F.coalesce(by_cat, F.when(ext != "", F.concat(ext, F.lit("-files"))), F.lit("misc-files"))


def with_storage_columns(files: DataFrame) -> DataFrame:
    """Type and bucket for each upload (type = category or extension)."""
    cat = file_category(F.col("content_type"))
    return (files.withColumn("_cat", cat)
            .withColumn("type", F.coalesce(F.col("_cat"), file_extension(F.col("filename"))))
            .withColumn("bucket", bucket_for(F.col("_cat"), F.col("filename")))
            .drop("_cat"))


def catalog_rows(files: DataFrame, source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalogue rows in the fixed schema order (and columns to ``keep`` beside them)."""
    f = with_storage_columns(files)
    return f.select("uuid", "filename", "timestamp", "type", "bucket", "content_type",
                    F.col("size").cast("long").alias("size"), F.col(source_col).alias("source"), *keep)


def file_history(catalog: DataFrame) -> DataFrame:
    """H2: the whole catalogue, newest first (uuid breaks ties, so the
    range partitioning of the sort can split a hot timestamp)."""
    return catalog.orderBy(F.desc("timestamp"), F.desc("uuid"))


def latest_objects(catalog: DataFrame, keys=("bucket", "filename")) -> DataFrame:
    """G1: the object a store holds per (bucket, filename): the last write.

    ``max(struct(timestamp, uuid, ...))`` is an ordinary aggregate with a
    map-side partial step, so a filename written a billion times costs one
    row per map task in the shuffle instead of a sorted window partition.
    """
    others = [c for c in catalog.columns if c not in keys and c not in ("timestamp", "uuid")]
    latest = F.max(F.struct("timestamp", "uuid", *others)).alias("_l")
    return catalog.groupBy(*keys).agg(latest).select(*keys, "_l.timestamp", "_l.uuid", *[f"_l.{c}" for c in others])


def file_by_uuid(catalog: DataFrame) -> DataFrame:
    """E7 for every catalogue entry: where its bytes would be fetched from,
    and whether that object is still this upload (a later upload with the
    same bucket and filename replaces it, G1)."""
    cur = latest_objects(catalog.select("bucket", "filename", "timestamp", "uuid")).select(
        F.col("bucket").alias("_b"), F.col("filename").alias("_f"), F.col("uuid").alias("current_uuid"))
    # one row per object name on this side; a name written by a third of all
    # uploads is split by AQE's skew handling when the join is shuffled
    j = catalog.join(cur, (F.col("bucket") == F.col("_b")) & (F.col("filename") == F.col("_f")), "left")
    return j.select("uuid", "bucket", "filename", "content_type",
                    (F.col("current_uuid") == F.col("uuid")).alias("found"), "current_uuid")


def with_size_mb(catalog: DataFrame) -> DataFrame:
    """J16."""
    return catalog.withColumn("size_mb", size_mb(F.col("size")))


def lookup_file(catalog: DataFrame, uuid: str) -> DataFrame:
    """E7 for one uuid: the entry (an equality the Parquet scan can push
    down), and whether the object stored under its bucket and filename is
    still this upload. Only rows with that bucket and filename are
    aggregated (semi join against the one matched key), not the catalogue."""
    entry = catalog.where(F.col("uuid") == F.lit(uuid))
    key = entry.select("bucket", "filename").distinct()
    same_name = catalog.join(key, ["bucket", "filename"], "left_semi")
    cur = latest_objects(same_name.select("bucket", "filename", "timestamp", "uuid")).select(
        "bucket", "filename", F.col("uuid").alias("current_uuid"))
    j = entry.join(cur, ["bucket", "filename"], "left")
    return j.select("uuid", "bucket", "filename", "content_type",
                    (F.col("current_uuid") == F.col("uuid")).alias("found"), "current_uuid")
