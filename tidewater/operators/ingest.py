"""Upload jobs: files -> records, rejects, summary, catalogue.

``scan (A) -> normalise (C9) -> convert (D) -> split (C10) -> append (B1) +
rejects + summary (F1-F4) + catalogue (B7)``. The converted rows are written
once; the summary is computed from that written table (which also cuts the
lineage). Row numbers read the input a second time, for a table of its splits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import stable_uuid
from ..sinks import objects, store, writers
from ..sinks.scratch import is_scratch
from ..sources import files
from ..sources.office import UNREADABLE
from . import catalog as cat
from . import checks, converters, enrich


@dataclass
class UploadResult:
    records_path: str
    summary: DataFrame
    catalog: DataFrame


def read_upload(spark: SparkSession, paths, kind: str) -> list[DataFrame]:
    """Raw feed frames for an upload kind ('ndjson' or 'structured'), one for
    each header among the files."""
    if kind == "ndjson":
        return [files.read_ndjson_lines(spark, paths)]
    return [converters.structured_cells(f) for f in files.structured_frames(spark, paths)]


def no_rows(spark: SparkSession) -> DataFrame:
    """What an upload of empty files reads."""
    return spark.createDataFrame([], "file_name string, row_no long")


def _ndjson_keys(feed: str) -> list[str]:
    """The (lower-cased) JSON keys each converter reads."""
    key = feed.lower()
    if key == "ais":
        return ["timestamp", "basedatetime", "lat", "lon", "sog", "heading", "vesselname", "imo", "mmsi"]
    if key == "piracy":
        return ["date", "time", "longitude", "latitude", "attack_type", "location_description", "nearest_country",
                "eez_country", "shore_distance", "shore_longitude", "shore_latitude", "attack_description",
                "vessel_name", "vessel_type", "vessel_status", "data_source"]
    return sorted(set(converters.P8I_CSV_HEADERS.values()) | {
        "msg_date", "msg_time", "change_type", "latitude", "longitude", "altitude", "course", "bearing", "speed",
        "position_valid_date", "position_valid_time", "trk_short_name", "sub_source_name"})


#: JSON keys that must be there, with the name used in the reject reason.
REQUIRED_KEYS = {"ais": (("lat", "LAT"), ("lon", "LON"), ("sog", "SOG"), ("heading", "Heading"))}


def convert_ndjson(lines: DataFrame, feed: str, keep_blank: bool = False) -> DataFrame | None:
    """NDJSON upload path: DMAS lines directly; for the other feeds each
    JSON object becomes text columns (keys compared lower-cased, X3) and
    goes through the same converter as a structured row (X5, X6). With
    ``keep_blank`` blank lines stay, marked as such, so that they count (F2)."""
    key = (feed or "").lower()
    if key == "dmas":
        return converters.convert_dmas(lines, keep_blank=True)
    if key not in converters.FEEDS:
        return None
    m = F.transform_keys(F.from_json("value", "map<string,string>"), lambda k, v: F.lower(k))
    keyed = lines.select("file_name", "row_no", "value", m.alias("m"))
    # an absent key is no blank value: AIS numbers are required, though they may be blank
    absent = [F.when(~F.map_contains_key("m", k), F.lit(f"Missing {name}")) for k, name in REQUIRED_KEYS.get(key, ())]
    problem = F.when(F.btrim(F.coalesce(F.col("value"), F.lit(""))) == "", F.lit(converters.BLANK_LINE)).otherwise(
        F.coalesce(F.when(F.col("m").isNull(), F.lit("Invalid JSON")), *absent))
    keyed = keyed.withColumn("_problem", problem)
    if not keep_blank:
        keyed = keyed.where(~F.col("_problem").eqNullSafe(converters.BLANK_LINE))
    good = keyed.where(F.col("_problem").isNull())
    flat = good.select("file_name", "row_no", *[F.col("m")[k].alias(k) for k in _ndjson_keys(key)],
                       F.btrim("value").alias(converters.OBJECT_COLUMN))
    converted = converters.convert_feed(flat, feed, path="ndjson")
    bad = converters.unreadable_rows(keyed.where(F.col("_problem").isNotNull()), feed, "_problem", "value")
    return converted.unionByName(bad.select(*converted.columns))


def with_upload_ids(converted: DataFrame, scope: str) -> DataFrame:
    """Record and file ids scoped by the upload: the same file name uploaded
    twice gives different ids, running the same upload again the same ids
    (the catalogue row of a file carries its ``file_uuid``)."""
    return (converted.withColumn("file_uuid", stable_uuid(F.lit(scope), "file_name"))
            .withColumn("uuid", stable_uuid(F.lit(scope), "file_name", "row_no")))


def upload_id_of(spark: SparkSession, paths) -> str:
    """Id of an upload from path, size and modification time of its files:
    the same job run again has the same id and replaces its own output; a
    changed file at the same path is an upload of its own."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    at = F.unix_micros("modificationTime")
    files_in = files.read_binary(spark, paths).select("path", "size", at.alias("at"))
    # sums of hashes do not depend on the order, and no list of files comes to the driver
    sums = [F.sum(F.xxhash64(F.lit(k), "path", "size", "at").cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    row = files_in.agg(F.count("*").alias("n"), F.sum("size").alias("size"), *sums).first()
    return hashlib.md5(":".join(str(x) for x in row).encode()).hexdigest()


def upload_kind(paths, content_type: str | None) -> str:
    """C14 for an upload: 'ndjson' by content type or suffix, else 'structured'."""
    if content_type in cat.NDJSON_TYPES or all(p.lower().endswith(".ndjson") for p in paths):
        return "ndjson"
    return "structured"


def content_type_of(filename) -> Column:
    """MIME type of a feed file by its suffix."""
    name = F.lower(filename)
    return (F.when(name.endswith(".ndjson"), "application/x-ndjson").when(name.endswith(".json"), "application/json")
            .when(name.endswith(".tsv"), "text/tab-separated-values")
            .when(name.endswith(".xlsx"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
            .otherwise("text/csv"))


def ingest_upload(spark: SparkSession, paths, feed: str, out_dir: str, *, source_dim: DataFrame,
                  sub_source_dim: DataFrame, uploaded_at: str, content_type: str | None = None,
                  keep_bytes: bool = False) -> UploadResult:
    """Convert one or more uploaded files of a feed and store the results.

    Files are read by header, so columns are never taken from another file's
    header. Unknown feed: nothing is converted and
    every row is reported skipped (the structured path's 'Row <i> skipped:
    unknown source type'). ``keep_bytes`` keeps the files' bytes under the
    same commit; otherwise they are never read whole."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    upload_id = upload_id_of(spark, paths)
    run = store.begin(spark, out_dir, upload_id)
    kind = upload_kind(paths, content_type)
    converted, cat_rows = None, None
    for k, group in enumerate(files.name_groups(paths)):
        scope = upload_id if k == 0 else f"{upload_id}/{k}"  # files of one name in two groups keep apart
        for raw in read_upload(spark, group, kind) or [no_rows(spark)]:
            if kind == "ndjson":
                part = convert_ndjson(raw, feed, keep_blank=True)
            elif UNREADABLE in raw.columns:  # a file that could not be read is one rejected row; the others go on
                part = converters.unreadable_rows(raw.withColumn("_none", F.lit(None).cast("string")), feed, UNREADABLE, "_none")
            else:
                part = converters.convert_feed(raw, feed)
            if part is None:  # every row reported, in the same record shape as converted rows
                part = converters.skipped_rows(raw, feed, "Row skipped: unknown source type")
            part = with_upload_ids(part, scope)
            converted = part if converted is None else converted.unionByName(part)
        blobs = files.read_binary(spark, group)
        blobs = blobs.select(stable_uuid(F.lit(scope), F.col("filename")).alias("uuid"), "filename", "size", "content")
        cat_rows = blobs if cat_rows is None else cat_rows.unionByName(blobs)
    converted = enrich.with_source_id(converted.drop("source_id"), source_dim, feed_col="feed")
    converted = enrich.with_sub_source_id(converted.drop("sub_source_id"), sub_source_dim)
    ct = F.lit(content_type) if content_type else content_type_of(F.col("filename"))
    cat_rows = cat_rows.select("uuid", "filename", F.lit(uploaded_at).alias("timestamp"), ct.alias("content_type"), "size",
                               F.lit(feed).alias("upload_source"), "content")
    result = store_upload(converted, cat_rows.drop("content"), out_dir, upload_id, source_dim, uploaded_at)
    if keep_bytes:
        held = cat.catalog_rows(cat_rows, source_col="upload_source", keep=("content",))
        objects.put_objects(held, f"{out_dir.rstrip('/')}/objects", upload_id)
    store.commit(spark, out_dir, upload_id, run, UPLOAD_TABLES + (["objects"] if keep_bytes else []))
    return result


#: What one upload writes before its commit.
UPLOAD_TABLES = ["cdf_data", "upload_summary", "upload_metadata", "file_catalog"]


def store_upload(converted: DataFrame, files_in: DataFrame, out_dir: str, upload_id: str, source_dim: DataFrame,
                 uploaded_at: str) -> UploadResult:
    """The tables of one upload: records and rejects (B1), counts per file
    (F1-F3), upload metadata (F4), catalogue rows (B7). ``files_in`` has the
    uploaded files: uuid, filename, timestamp, content_type, size,
    upload_source."""
    base = out_dir.rstrip("/")
    written = writers.write_upload_records(converted, f"{base}/cdf_data", upload_id)
    summary = writers.write_upload(checks.upload_summary(written), f"{base}/upload_summary", upload_id)
    per_file = written.groupBy("file_uuid", "file_name").agg(
        F.min("source_id").alias("source_id"), F.min("sub_source_id").alias("sub_source_id"),
        F.count_if(F.col("status") == "saved").alias("saved"))
    meta = checks.upload_metadata(per_file, F.col("source_id"), F.col("sub_source_id"), uploaded_at)
    writers.write_upload(meta, f"{base}/upload_metadata", upload_id)
    catalog_rows = cat.catalog_rows(enrich.with_upload_source_name(files_in, source_dim), source_col="source_name")
    writers.append_catalog(catalog_rows, f"{base}/file_catalog", upload_id)
    return UploadResult(f"{base}/cdf_data", summary.drop("upload_id"), catalog_rows)


def store_p8i_tables(raw: DataFrame, out_dir: str, upload_id: str | None = None) -> dict:
    """B2 after C13, per row (X17): rows of tracking sub-sources are
    converted by D5 into the tracking table, rows of ESM sub-sources by D6
    into the ESM table (each written once, partitioned by status, so the
    converter's rejects sit in ``status=failed``); rows with no or an unknown
    sub-source go to the unrouted table with the reason. The raw frame is
    split by narrow filters, so each row is parsed once. Everything is stored
    under the upload's id (default: from the input files), so a rerun replaces
    its own rows."""
    from .routing import ESM_TABLE, TRACKING_TABLE, route_p8i

    routed = route_p8i(raw)
    base = out_dir.rstrip("/")
    tracking = converters.convert_p8i_tracking_rows(
        routed.where(F.col("target_table") == TRACKING_TABLE).drop("target_table", "route_error"))
    esm = converters.convert_p8i_esm(
        routed.where(F.col("target_table") == ESM_TABLE).drop("target_table", "route_error"))
    uid = upload_id or hashlib.md5("\n".join(sorted(f for f in raw.inputFiles() if not is_scratch(f))).encode()).hexdigest()
    writers.write_upload_records(tracking, f"{base}/tracking_data", uid)
    writers.write_upload_records(esm, f"{base}/esm_data", uid)
    writers.write_upload(routed.where(F.col("route_error").isNotNull()).select(
        "file_name", "row_no", F.col("route_error").alias("reject_reason")), f"{base}/p8i_unrouted", uid)
    return {"tracking": f"{base}/tracking_data", "esm": f"{base}/esm_data", "unrouted": f"{base}/p8i_unrouted"}
