"""Writers. No per-row commits: each is one Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.converters import record_status
from ..schemas import (
    CDF_SCHEMA,
    FILE_CATALOG_SCHEMA,
    P8I_ESM_SCHEMA,
    P8I_TRACKING_SCHEMA,
    PIRATE_ATTACKS_SCHEMA,
    SOURCE_SCHEMA,
    SUB_SOURCE_SCHEMA,
    UPLOAD_METADATA_SCHEMA,
)


def write_records(converted: DataFrame, path: str, mode: str = "append") -> None:
    """B1 + C10: converted rows written once, partitioned by status
    ('saved' / 'failed' / 'skipped') and feed (when there is one). The
    record table is the ``status=saved`` part (partition pruning), the
    rejects table the ``status=failed`` part: one scan of the input feeds
    both, no cache needed."""
    out = converted.withColumn("status", record_status("reject_reason"))
    parts = ["status", "feed"] if "feed" in out.columns else ["status"]
    out.write.mode(mode).partitionBy(*parts).parquet(path)


def upload_path(path: str, upload_id: str) -> str:
    return f"{path.rstrip('/')}/upload_id={upload_id}"


def write_upload(df: DataFrame, path: str, upload_id: str, partition_by=()) -> DataFrame:
    """Replace everything one upload has in the table at ``path`` and return
    it as stored. A job that runs again leaves no row of its earlier run
    behind, whatever partitions that run made, and no other upload is
    touched or listed."""
    own = upload_path(path, upload_id)
    (df.drop("upload_id").write.mode("overwrite").option("partitionOverwriteMode", "static")
       .partitionBy(*partition_by).parquet(own))
    stored = df.sparkSession.read.schema(df.drop("upload_id").schema).parquet(own)
    return stored.withColumn("upload_id", F.lit(upload_id))


def write_upload_records(converted: DataFrame, path: str, upload_id: str) -> DataFrame:
    """:func:`write_records` for one upload, see :func:`write_upload`."""
    out = converted.withColumn("status", record_status("reject_reason"))
    return write_upload(out, path, upload_id, [c for c in ("status", "feed") if c in out.columns])


def read_saved_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("status") == "saved").drop("reject_reason")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("status") == "failed")


def write_table(df: DataFrame, target: str, mode: str = "append", jdbc: dict | None = None) -> None:
    """Append to a table. With ``jdbc`` options (url, user,
    password, driver -- passed in, never stored in code) it goes to a
    database table named ``target``; otherwise ``target`` is a Parquet path."""
    if jdbc:
        df.write.format("jdbc").options(**jdbc).option("dbtable", target).mode(mode).save()
    else:
        df.write.mode(mode).parquet(target)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A query result as CSV with a header, written by the executors."""
    df.write.mode(mode).option("header", True).csv(path)


def export_file_records(records: DataFrame, file_uuid: str, path: str) -> int:
    """The records of one file as CSV; no records -> LookupError.
    The emptiness test reads at most one row."""
    sel = records.where(F.col("file_uuid") == F.lit(file_uuid)).drop("raw_data")
    if sel.limit(1).count() == 0:
        raise LookupError(f"No CDF data found for this UUID: {file_uuid}")
    write_csv(sel, path)
    return 1


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records (one object per line)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_catalog(rows: DataFrame, path: str, upload_id: str | None = None) -> None:
    """Catalogue rows in the fixed schema (of one upload when given, so
    a rerun replaces its own rows)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in FILE_CATALOG_SCHEMA.fields]
    if upload_id is not None:
        write_upload(rows.select(*cols), path, upload_id)
    else:
        rows.select(*cols).write.mode("append").parquet(path)


TABLE_SCHEMAS = {
    "source": SOURCE_SCHEMA,
    "sub_source": SUB_SOURCE_SCHEMA,
    "cdf_data": CDF_SCHEMA,
    "upload_metadata": UPLOAD_METADATA_SCHEMA,
    "file_catalog": FILE_CATALOG_SCHEMA,
    "pirate_attacks": PIRATE_ATTACKS_SCHEMA,
    "tracking_data": P8I_TRACKING_SCHEMA,
    "esm_data": P8I_ESM_SCHEMA,
}


def create_tables(spark: SparkSession, base: str) -> list[str]:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet`` for every table."""
    made = []
    for name, schema in TABLE_SCHEMAS.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{base.rstrip('/')}/{name}'")
        made.append(name)
    return made
