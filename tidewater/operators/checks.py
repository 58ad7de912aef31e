"""Per-file counts and table constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import stable_uuid
from .converters import record_status


def upload_summary(converted: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Per file, records attempted, saved and failed.

    ``converted`` is a converter output (reject_reason NULL = saved).
    ``attempted`` is the raw scan with ``file_name`` when it has rows the
    converter drops before conversion (blank NDJSON lines count as attempted,
    F2). All counts are partial aggregates, so one huge file is fine.
    """
    # a file holds one feed: grouping by both keeps a hash aggregate (a
    # string-valued aggregate buffer would force a sort-based one)
    if "file_uuid" not in converted.columns:
        converted = converted.withColumn("file_uuid", stable_uuid("file_name"))
    conv = converted.groupBy("file_uuid", "file_name", "feed").agg(
        F.count_if(record_status("reject_reason") == "saved").alias("saved"),
        F.count_if(record_status("reject_reason") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("attempted"),
    )
    if attempted is not None:
        att = attempted.groupBy("file_name").agg(F.count(F.lit(1)).alias("_att"))
        conv = conv.join(att, "file_name", "full").withColumn("attempted", F.col("_att"))
    return conv.select(
        "file_uuid", "file_name", "feed",
        F.col("attempted").cast("long").alias("attempted"),
        F.coalesce(F.col("saved"), F.lit(0)).cast("long").alias("saved"),
        F.coalesce(F.col("failed"), F.lit(0)).cast("long").alias("failed"),
    )


def failure_messages(converted: DataFrame) -> DataFrame:
    """one 'Row <n> failed: <reason>' line per reject (a table, never a
    list gathered into one row)."""
    bad = converted.where(record_status("reject_reason") == "failed")
    return bad.select(
        stable_uuid("file_name").alias("file_uuid"), "file_name", "row_no",
        F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(" failed: "), F.col("reject_reason")).alias("message"),
    )


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def upload_metadata(summary: DataFrame, source_id, sub_source_id, timestamp: str) -> DataFrame:
    """the upload_metadata row of each file (format = the feed's upload
    path, record_count = saved records). ``source_id``/``sub_source_id`` are
    values or Columns of ``summary``."""
    return summary.select(
        "file_uuid", "file_name",
        _as_col(source_id).cast("int").alias("source_id"),
        _as_col(sub_source_id).cast("int").alias("sub_source_id"),
        F.upper(F.regexp_extract(F.col("file_name"), r"\.([^./]+)$", 1)).alias("format"),
        F.col("saved").alias("record_count"),
        F.to_timestamp_ntz(F.lit(timestamp)).alias("timestamp"),
    )


def duplicate_keys(df: DataFrame, key: str = "uuid") -> DataFrame:
    """keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """child rows whose non-NULL key has no parent row (left anti join;
    the parent side is only the distinct keys)."""
    parents = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("_pk"), "left_anti")


def reference_violations(child: DataFrame, key: str, refs) -> DataFrame:
    """F6 for several references of one table in a single pass.

    ``refs``: (relation label, child column, parent frame with ``id``). Each
    parent contributes its distinct keys through a left join (keys are
    unique, so no row is multiplied; Spark broadcasts small parents); one ``explode`` then emits a (relation, key, value) row per
    broken reference. The child is read and computed once, however many
    references it has."""
    out = child
    found = []
    for i, (relation, col, parent) in enumerate(refs):
        pk = f"_pk{i}"
        keys = parent.select(F.col("id").alias(pk)).distinct()
        out = out.join(keys, F.col(col) == F.col(pk), "left")
        found.append(F.when(F.col(col).isNotNull() & F.col(pk).isNull(), F.struct(
            F.lit(relation).alias("relation"), F.col(key).cast("string").alias("key"),
            F.col(col).cast("int").alias("value"))))
    broken = F.filter(F.array(*found), lambda v: v.isNotNull())
    return out.select(F.explode(broken).alias("v")).select("v.*")
