"""Tables that are kept up to date bucket by bucket, copy on write.

A table is Parquet under ``data/<bucket columns>/gen=<generation>`` and a small
table ``current`` that names each bucket's generation. A change writes the new
contents of the buckets it touches, and only these, as a new generation, then
one row for each of them to ``current``: that last write is the commit. Until
it is there readers see the buckets as they were, and what a job that failed
left behind is in a generation that no row names. Old generations are the
table's earlier versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _schema(schema: StructType, by: tuple[str, ...]) -> StructType:
    rest = [f for f in schema.fields if f.name not in by]
    return StructType([*rest, *[schema[c] for c in by], StructField("gen", StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any version of the table was written (by Spark's own file system layer, whatever store it is)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/current")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def current_buckets(spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...], version: int | None = None) -> DataFrame:
    """Bucket columns and the generation of each bucket, as of a version (default: the last)."""
    cols = StructType([*[schema[c] for c in by], StructField("gen", StringType())])
    rows = spark.read.schema(cols).parquet(f"{path.rstrip('/')}/current")
    if version is not None:
        rows = rows.where(F.col("gen") < f"{version + 1:08d}")
    return rows.groupBy(*by).agg(F.max("gen").alias("gen"))


def read_buckets(spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...], version: int | None = None,
                 where: Column | None = None) -> DataFrame:
    """The table's rows. ``where`` is a condition on bucket columns; it prunes
    directories before the join with the buckets' generations."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(_schema(schema, by)).parquet(f"{path.rstrip('/')}/data")
    live = current_buckets(spark, path, schema, by, version)
    if where is not None:
        rows, live = rows.where(where), live.where(where)
    live = live.select(*[F.col(c).alias(f"_{c}") for c in (*by, "gen")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "gen")]
    return rows.join(live, same, "left_semi").select(*schema.fieldNames())


def last_version(spark: SparkSession, path: str) -> int:
    """Number of commits so far."""
    if not exists(spark, path):
        return 0
    last = spark.read.schema("gen string").parquet(f"{path.rstrip('/')}/current").agg(F.max("gen")).first()[0]
    return int(last.split("-")[0]) if last else 0


def replace_buckets(rows: DataFrame, changed: DataFrame, path: str, by: tuple[str, ...], options: dict | None = None) -> int:
    """Make ``rows`` the whole contents of the ``changed`` buckets (which have
    the columns ``by``); returns the version. ``rows`` may be
    computed from the table itself: nothing that exists is overwritten."""
    spark, base = rows.sparkSession, path.rstrip("/")
    version = last_version(spark, path) + 1
    gen = f"{version:08d}-{uuid.uuid4().hex[:12]}"
    rows.withColumn("gen", F.lit(gen)).write.mode("append").options(**(options or {})).partitionBy(*by, "gen").parquet(f"{base}/data")
    # a bucket that lost all its rows has a generation without files
    changed.select(*by).distinct().withColumn("gen", F.lit(gen)).coalesce(1).write.mode("append").parquet(f"{base}/current")
    return version
