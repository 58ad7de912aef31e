"""Jobs over a store folder: what a user of the original upload service runs.

Each function is one Spark job (or a few) over tables under ``store``:

    store/source, store/sub_source          dimension tables
    store/cdf_data                          records as uploads wrote them (by upload, status, feed)
    store/records, store/records_runs       the same, compacted (by status, source, month)
    store/upload_summary, store/upload_metadata, store/file_catalog
    store/image_metadata, store/document_metadata
    store/objects                           bytes of kept files (images, documents; others on demand)
    store/history                           the catalogue in blocks by time, for pages
    store/commits                           uploads whose tables are all there; readers see these only

Nothing is gathered on the driver except small answers the caller asked
for (a row count, a not-found check).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.coords import wkt_or_invalid
from .functions.records import stable_uuid
from .functions.timestamps import iso_text
from .operators import catalog as cat
from .operators import enrich, history, media
from .operators.ingest import UploadResult, ingest_upload, upload_id_of
from .schemas import FILE_CATALOG_SCHEMA, SOURCE_SCHEMA, SUB_SOURCE_SCHEMA
from .sinks import objects, writers
from .sinks import store as records_store
from .sources import files, images, office


def _p(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def init_store(spark: SparkSession, store: str, sources: list[tuple], sub_sources: list[tuple]) -> None:
    """Create the dimension tables (small, given rows: A10 + B9)."""
    files.frame_from_rows(spark, sources, SOURCE_SCHEMA).write.mode("overwrite").parquet(_p(store, "source"))
    files.frame_from_rows(spark, sub_sources, SUB_SOURCE_SCHEMA).write.mode("overwrite").parquet(_p(store, "sub_source"))
    nothing = spark.createDataFrame([], records_store.COMMIT_SCHEMA)
    nothing.write.mode("append").partitionBy("upload_id").parquet(_p(store, "commits"))


def compact(spark: SparkSession, store: str) -> int:
    """B1: committed uploads into the compacted record table; returns how many."""
    return records_store.compact(spark, store)


def _dims(spark: SparkSession, store: str):
    return spark.read.parquet(_p(store, "source")), spark.read.parquet(_p(store, "sub_source"))


def detect_kind(path: str, content_type: str | None) -> str:
    """C14 for one upload, before any job starts."""
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(content_type, path.rsplit("/", 1)[-1])], "ct string, name string").select(
        cat.file_kind(F.col("ct"), F.col("name")).alias("k")).first()
    return row["k"]


def upload(spark: SparkSession, paths, feed: str, store: str, uploaded_at: str,
           content_type: str | None = None, keep_bytes: bool = False) -> UploadResult:
    """Feed files (NDJSON or CSV/TSV/XLSX) -> records, rejects, upload
    metadata and catalogue rows, idempotent per upload. With ``keep_bytes``
    the files themselves (of at most 2 GB each) are kept too, see
    :func:`open_file`."""
    s, ss = _dims(spark, store)
    return ingest_upload(spark, paths, feed, store, source_dim=s, sub_source_dim=ss,
                         uploaded_at=uploaded_at, content_type=content_type, keep_bytes=keep_bytes)


def _keep(rows: DataFrame, bins: DataFrame, store: str, uid: str) -> None:
    """Keep the bytes of the files that have these catalogue rows."""
    held = rows.select("uuid", "bucket", "filename").join(bins.select(stable_uuid(F.col("path")).alias("uuid"), "content"), "uuid")
    objects.put_objects(held, _p(store, "objects"), uid)


def extract_images(spark: SparkSession, paths, store: str, uploaded_at: str) -> DataFrame:
    """M1-M3 for uploaded images: the image document (header profile, camera
    and GPS data, times, summary flags) and a catalogue row for each, under
    one commit; non-images keep an error."""
    uid = f"images-{upload_id_of(spark, paths)}"
    run = records_store.begin(spark, store, uid)
    bins = files.read_binary(spark, paths)
    decoded = images.decode_images(bins)
    prof = images.image_profile(bins, decoded)
    rec = media.image_document(images.exif_tag_table(decoded, stable_uuid(F.col("path")))).drop("filename")
    out = prof.withColumn("file_uuid", stable_uuid(F.col("path"))).join(rec, "file_uuid", "left")
    stored = writers.write_upload(out, _p(store, "image_metadata"), uid)
    ct = F.concat(F.lit("image/"), F.lower(F.coalesce(F.col("format"), F.lit("unknown"))))
    catalog_rows = cat.catalog_rows(prof.select(
        stable_uuid(F.col("path")).alias("uuid"), "filename", F.lit(uploaded_at).alias("timestamp"),
        ct.alias("content_type"), F.col("file_size_bytes").alias("size"), F.lit(None).cast("string").alias("source")))
    writers.append_catalog(catalog_rows, _p(store, "file_catalog"), uid)
    _keep(catalog_rows, bins, store, uid)
    records_store.commit(spark, store, uid, run, ["image_metadata", "file_catalog", "objects"])
    return stored


def upload_documents(spark: SparkSession, paths, store: str, uploaded_at: str) -> DataFrame:
    """M4/M5/M7: office documents -> document metadata and catalogue rows
    (a document is in the file history like any other upload)."""
    uid = f"documents-{upload_id_of(spark, paths)}"
    run = records_store.begin(spark, store, uid)
    bins = files.read_binary(spark, paths)
    docs = office.document_records(bins, uploaded_at)
    stored = writers.write_upload(docs, _p(store, "document_metadata"), uid)
    rows = stored.select("uuid", "filename", F.col("upload_time").alias("timestamp"), "content_type",
                         F.col("storage.size").alias("size"), F.lit(None).cast("string").alias("source"))
    writers.append_catalog(cat.catalog_rows(rows), _p(store, "file_catalog"), uid)
    _keep(cat.catalog_rows(rows), bins, store, uid)
    records_store.commit(spark, store, uid, run, ["document_metadata", "file_catalog", "objects"])
    return stored


def _saved(spark: SparkSession, store: str) -> DataFrame:
    return records_store.read_records(spark, store, F.col("status") == "saved").drop(
        "reject_reason", "status", "day", "month", "upload_id", "run")


def export_cdf(spark: SparkSession, store: str, out_json: str | None = None) -> DataFrame:
    """The enriched export (3.2): saved records with source names, WKT and
    ISO times; optionally written as JSON records (B5)."""
    s, ss = _dims(spark, store)
    rec = enrich.with_dimension_names(_saved(spark, store), s, ss)
    out = rec.select("uuid", "file_uuid", "latitude", "longitude", "speed", "bearing", "course", "sys_trk_no",
                     "source", "sub_source", wkt_or_invalid(F.col("location")).alias("location"),
                     iso_text(F.col("logged_timestamp")).alias("logged_timestamp"), "vessel_name", "imo", "mmsi")
    if out_json:
        writers.write_json(out, out_json)
    return out


def list_upload_metadata(spark: SparkSession, store: str) -> DataFrame:
    """H1 + E3: upload metadata with source names, newest first."""
    s, ss = _dims(spark, store)
    meta = enrich.with_dimension_names(records_store.read_committed(spark, store, "upload_metadata"), s, ss)
    return meta.select("file_uuid", "file_name", "source", "sub_source", "format", "record_count",
                       "timestamp").orderBy(F.desc("timestamp"), F.desc("file_uuid"))


def file_history(spark: SparkSession, store: str) -> DataFrame:
    """A7 + H2: the catalogue without internal columns, newest first."""
    return cat.file_history(records_store.read_committed(spark, store, "file_catalog").drop("upload_id"))


def file_metadata(spark: SparkSession, store: str, uuid: str) -> DataFrame:
    """C3 + E7: one catalogue entry by uuid with where its bytes are and
    whether that object is still this upload; empty frame = not found."""
    return cat.lookup_file(records_store.read_committed(spark, store, "file_catalog"), uuid)


def open_file(spark: SparkSession, store: str, uuid: str) -> DataFrame:
    """The bytes of a kept file by uuid, as chunks in order (what is
    under its bucket and filename now; ``found`` tells whether that is this
    upload). LookupError when no file has the uuid."""
    held = records_store.read_committed(spark, store, "objects")
    return objects.open_file(records_store.read_committed(spark, store, "file_catalog"), held, uuid)


def index_history(spark: SparkSession, store: str, block_rows: int = history.BLOCK_ROWS) -> str:
    """Write the committed catalogue into blocks by time, as a new folder; returns it."""
    path = f"{_p(store, 'history')}/{uuid4().hex}"
    rows = records_store.read_committed(spark, store, "file_catalog").select(*FILE_CATALOG_SCHEMA.fieldNames())
    history.append_history(rows, path, "all", block_rows)
    return path


def file_history_page(spark: SparkSession, index: str, size: int = 100, before: tuple[str, str] | None = None) -> DataFrame:
    """H2: a page of the history as of :func:`index_history`; ``before`` is
    the (timestamp, uuid) of the last row of the page before it."""
    return history.history_page(spark, index, FILE_CATALOG_SCHEMA, size, before)


def download_file_records(spark: SparkSession, store: str, file_uuid: str, out_csv: str) -> None:
    """One file's records as CSV; LookupError when there are none."""
    writers.export_file_records(_saved(spark, store), file_uuid, out_csv)


def list_sources(spark: SparkSession, store: str) -> DataFrame:
    """E8 list."""
    return _dims(spark, store)[0].select("id", "name").orderBy("id")


def sub_sources(spark: SparkSession, store: str, source_id: int) -> DataFrame:
    """Sub-sources of one source; LookupError when there are none."""
    ss = _dims(spark, store)[1].where(F.col("source_id") == source_id).select("id", "name", "source_id")
    if ss.limit(1).count() == 0:
        raise LookupError("No sub-sources found for this source_id")
    return ss


def source_name(spark: SparkSession, store: str, source_id: int) -> str:
    """A source's name; LookupError when it does not exist."""
    row = enrich.first_match(_dims(spark, store)[0], F.col("id") == source_id).first()
    if row is None:
        raise LookupError("Source not found")
    return row["name"]
