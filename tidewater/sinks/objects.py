"""Stored files: their bytes, opened by uuid.

The table ``objects`` holds the bytes of kept files as chunks, partitioned by
upload, bucket and a hash of the file name. The catalogue says which upload
wrote a (bucket, filename) last; the bytes are then read from that upload's
partitions only. A file of any size goes through as rows of bounded size, but
is read as one value when it is kept, so it may have 2 GB at most (the limit of
``binaryFile``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import writers
from .scratch import stored

CHUNK_BYTES = 4 << 20
#: Partitions of one upload's files in a bucket.
PARTS = 16


def part_of(filename) -> Column:
    return F.pmod(F.xxhash64(filename), F.lit(PARTS)).cast("int")


def put_objects(files: DataFrame, path: str, upload_id: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Keep the bytes of one upload's files (uuid, bucket, filename, content);
    a rerun replaces them. An empty file has one empty chunk."""
    chunks = F.greatest(F.lit(1), F.ceil(F.length("content") / chunk_bytes)).cast("int")
    cut = files.select("uuid", "bucket", part_of(F.col("filename")).alias("part"), "filename",
                       F.length("content").cast("long").alias("size"), "content",
                       F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    cut = cut.withColumn("content", F.expr(f"substring(content, chunk * {chunk_bytes} + 1, {chunk_bytes})"))
    placed = cut.hint("rebalance", "bucket", "part").sortWithinPartitions("bucket", "part", "uuid", "chunk")
    return writers.write_upload(placed, path, upload_id, ("bucket", "part"))


def locate(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalogue entries of the ``wanted`` uuids, with the upload that wrote
    their bucket and filename last; unknown uuids have no row. Only entries
    of the same names are aggregated."""
    entries = catalog.join(wanted.select("uuid").distinct(), "uuid", "left_semi")
    same = catalog.join(entries.select("bucket", "filename").distinct(), ["bucket", "filename"], "left_semi")
    last = same.groupBy("bucket", "filename").agg(F.max(F.struct("timestamp", "uuid", "upload_id")).alias("last"))
    last = last.select("bucket", "filename", F.col("last.uuid").alias("current_uuid"), F.col("last.upload_id").alias("current_upload"))
    out = entries.select("uuid", "bucket", "filename", "content_type").join(last, ["bucket", "filename"])
    return out.withColumn("found", F.col("current_uuid") == F.col("uuid"))


def open_files(catalog: DataFrame, objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes under the bucket and filename of each wanted uuid, a row
    for each chunk. ``found`` tells whether they are this upload's own or those
    of a later one (``current_uuid``). What is located is written first: its
    size decides the join, and as a broadcast it prunes the partitions."""
    at = stored(locate(catalog, wanted).withColumn("part", part_of(F.col("filename"))), "located")
    at = at.where(F.length("current_upload") > 0)  # a condition of its own, so that partitions are pruned by the join
    held = objects.select(F.col("uuid").alias("current_uuid"), F.col("upload_id").alias("current_upload"),
                          "bucket", "part", "size", "chunk", "content")
    return at.join(held, ["current_upload", "bucket", "part", "current_uuid"]).select(
        "uuid", "bucket", "filename", "content_type", "found", "current_uuid", "size", "chunk", "content")


def open_file(catalog: DataFrame, objects: DataFrame, uuid: str) -> DataFrame:
    """E7 for one uuid: its chunks in order. The one row that locates it
    becomes constants, so listing and row groups are pruned before the read."""
    at = locate(catalog, catalog.where(F.col("uuid") == uuid).select("uuid")).first()
    if at is None:
        raise LookupError(f"No file found with uuid: {uuid}")
    place = (F.col("upload_id") == at["current_upload"]) & (F.col("bucket") == at["bucket"]) & (F.col("part") == part_of(F.lit(at["filename"])))
    rows = objects.where(place & (F.col("uuid") == at["current_uuid"]))
    return rows.select(F.lit(uuid).alias("uuid"), "filename", F.lit(at["content_type"]).alias("content_type"),
                       F.lit(at["found"]).alias("found"), "size", "chunk", "content").orderBy("chunk")
