"""Pages of the file history.

The history is kept as blocks: runs of catalogue rows, newest first, and a
small table with the first and last key of each block. A page is asked for by
the key where the one before it ended, and reads the blocks that can hold its
rows, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BLOCK_ROWS = 100_000
BLOCKS = "n long, low struct<at string, uuid string>, high struct<at string, uuid string>, block int, run string"


def _key() -> Column:
    return F.struct(F.coalesce(F.col("timestamp"), F.lit("")).alias("at"), F.coalesce(F.col("uuid"), F.lit("")).alias("uuid"))


def append_history(rows: DataFrame, path: str, run: str, block_rows: int = BLOCK_ROWS) -> None:
    """Catalogue rows of one run into blocks of about ``block_rows``. Rows of
    one time are split by uuid. The table of blocks is written last: a run
    that fails before is not read, one that is repeated replaces itself."""
    spark, base = rows.sparkSession, path.rstrip("/")
    blocks = max(1, -(-rows.count() // block_rows))
    newest = [F.desc(F.coalesce(F.col("timestamp"), F.lit(""))), F.desc(F.coalesce(F.col("uuid"), F.lit("")))]
    placed = rows.repartitionByRange(blocks, *newest).withColumn("block", F.spark_partition_id())
    placed.sortWithinPartitions("block", *newest).write.mode("overwrite").partitionBy("block").parquet(f"{base}/rows/run={run}")
    schema = StructType([*rows.schema.fields, StructField("block", IntegerType())])
    ends = spark.read.schema(schema).parquet(f"{base}/rows/run={run}").groupBy("block")
    ends = ends.agg(F.count("*").alias("n"), F.min(_key()).alias("low"), F.max(_key()).alias("high"))
    ends.select("n", "low", "high", "block").coalesce(1).write.mode("overwrite").parquet(f"{base}/blocks/run={run}")


def history_page(spark: SparkSession, path: str, schema: StructType, size: int, before: tuple[str, str] | None = None) -> DataFrame:
    """The ``size`` newest rows, or the newest of those ``before`` a
    (timestamp, uuid). Blocks of several runs may overlap: a block is read when
    it begins before the key and does not end below the rows that whole
    blocks are known to give. At most ``size`` rows come to the driver."""
    base = path.rstrip("/")
    blocks = spark.read.schema(BLOCKS).parquet(f"{base}/blocks")
    key = None if before is None else F.struct(F.lit(before[0]).alias("at"), F.lit(before[1]).alias("uuid"))
    live = blocks if key is None else blocks.where(F.col("low") < key)
    whole = live if key is None else live.where(F.col("high") < key)
    held, floor = 0, None
    # no block is empty, so as many blocks as rows are enough
    for b in whole.orderBy(F.desc("low")).limit(size).select("n", "low").collect():
        held += b["n"]
        if held >= size:
            floor = b["low"]
            break
    if floor is not None:
        live = live.where(F.col("high") >= F.struct(F.lit(floor["at"]).alias("at"), F.lit(floor["uuid"]).alias("uuid")))
    fields = [*schema.fields, StructField("block", IntegerType()), StructField("run", StringType())]
    rows = spark.read.schema(StructType(fields)).parquet(f"{base}/rows")
    rows = rows.join(live.where("n > 0").select("run", "block"), ["run", "block"], "left_semi")
    if key is not None:
        rows = rows.where(_key() < key)
    return rows.select(*schema.fieldNames()).orderBy(F.desc(_key())).limit(size)
