"""Incremental file ingest with Structured Streaming.

Each file that arrives in the input folder is converted, appended, catalogued
and summarised once. The stream reads new files (``readStream``), and every
micro-batch goes through the same converter and the same writes as the batch
job inside ``foreachBatch``. A batch writes under its own upload id (stream,
checkpoint, batch id) and commits last (:mod:`..sinks.store`): its records,
rejects, catalogue and metadata rows appear together, and a batch replayed
after a failure replaces its own output; the checkpoint records which files
were taken.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.records import stable_uuid
from ..operators import converters, enrich
from ..session import CHECKPOINT_CONF
from ..sources.files import with_file_row_numbers


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    if given:
        return given
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_CONF} or pass checkpoint_location")
    return f"{base.rstrip('/')}/streams/{name}"


def _process(batch: DataFrame, batch_id: int, feed: str, out_dir: str, source_dim: DataFrame,
             sub_source_dim: DataFrame, kind: str, scope: str, uploaded_at: str | None) -> None:
    """One micro-batch, with the tables of a batch upload under one commit: a
    batch that fails between two writes shows nothing, and its replay (same
    id) replaces what it left."""
    from ..operators.ingest import UPLOAD_TABLES, content_type_of, convert_ndjson, store_upload, with_upload_ids
    from ..sinks import store

    spark = batch.sparkSession
    upload_id = f"{scope}-{batch_id}"
    run = store.begin(spark, out_dir, upload_id)
    at = uploaded_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    sized = batch.select("_file_name", "_file_size").withColumnsRenamed({"_file_name": "filename", "_file_size": "size"})
    batch = batch.drop("_file_size")
    if kind == "ndjson":
        lines = with_file_row_numbers(batch).select("file_name", "row_no", "value")
        conv = convert_ndjson(lines, feed, keep_blank=True)
    else:
        lines = raw = with_file_row_numbers(batch)
        conv = converters.convert_feed(converters.structured_cells(raw), feed)
    if conv is None:  # the checkpoint takes these files too, so their rows must be somewhere
        conv = converters.skipped_rows(lines, feed, "Row skipped: unknown source type")
    conv = with_upload_ids(conv, upload_id)
    conv = enrich.with_source_id(conv.drop("source_id"), source_dim)
    conv = enrich.with_sub_source_id(conv.drop("sub_source_id"), sub_source_dim)
    # a file of the batch is known by its rows; one without a row is not in the stream
    files_in = sized.groupBy("filename").agg(F.max("size").alias("size")).select(
        stable_uuid(F.lit(upload_id), F.col("filename")).alias("uuid"), "filename", F.lit(at).alias("timestamp"),
        content_type_of(F.col("filename")).alias("content_type"), "size", F.lit(feed).alias("upload_source"))
    store_upload(conv, files_in, out_dir, upload_id, source_dim, at)
    store.commit(spark, out_dir, upload_id, run, UPLOAD_TABLES)


def start_file_ingest(spark: SparkSession, in_dir: str, out_dir: str, feed: str, *, source_dim: DataFrame,
                      sub_source_dim: DataFrame, kind: str = "ndjson", columns: list[str] | None = None,
                      checkpoint_location: str | None = None, available_now: bool = True,
                      max_files_per_trigger: int | None = None, uploaded_at: str | None = None) -> StreamingQuery:
    """L1: start the stream. ``kind`` 'ndjson' reads lines; 'csv' needs the
    header names in ``columns`` (a stream has a fixed schema); cells are
    text. With ``available_now`` the query takes every file present and
    stops; otherwise it keeps watching the folder. ``uploaded_at`` is the
    catalogue's time (default: when a batch runs)."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if kind == "ndjson":
        stream = reader.format("text").load(in_dir)
    else:
        schema = StructType([StructField(c, StringType(), True) for c in columns or []])
        stream = reader.schema(schema).option("header", True).option("enforceSchema", True).csv(in_dir)
    stream = stream.select(
        "*",
        F.col("_metadata.file_name").alias("_file_name"),
        F.col("_metadata.file_path").alias("_file_path"),
        F.col("_metadata.file_block_start").alias("_file_block_start"),
        F.col("_metadata.file_size").alias("_file_size"),
    )
    name = f"ingest_{feed.lower()}"
    ckpt = _checkpoint(spark, name, checkpoint_location)
    # batch ids restart with a new checkpoint: the checkpoint is part of the id
    scope = f"stream-{feed.lower()}-{hashlib.md5(ckpt.encode()).hexdigest()[:12]}"
    writer = stream.writeStream.queryName(name).option("checkpointLocation", ckpt)
    writer = writer.foreachBatch(
        lambda df, bid: _process(df, bid, feed, out_dir, source_dim, sub_source_dim, kind, scope, uploaded_at))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
