"""Tables kept up to date upload by upload (G1, F5), instead of computed anew.

* ``merge_latest``: the objects a store holds. Objects are divided into parts by
  hash; an upload rewrites the parts it touches, nothing else.
* ``duplicates_on_write``: which keys of an upload are stored already. A Bloom
  filter of the stored keys, kept as a table and added to by each upload, lets
  through the few keys that may be there; only these are looked up exactly, so
  stored keys are scanned but not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..sinks import buckets
from ..sinks.scratch import stored as written
from . import catalog as cat

# ---- G1 / B7 -------------------------------------------------------------------

#: Parts of the object table; an upload of few objects rewrites a few of them.
PARTS = 16
OBJECT_SCHEMA = StructType([*[StructField(c, StringType()) for c in ("bucket", "filename", "timestamp", "uuid")], StructField("part", IntegerType())])


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("bucket", "filename"), F.lit(parts)).cast("int")


def merge_latest(spark: SparkSession, path: str, uploaded: DataFrame, parts: int = PARTS) -> int:
    """Take the catalogue rows of an upload into the object table at ``path``;
    returns its version. An upload that is merged twice changes nothing.
    ``parts`` must stay the same for a table."""
    fresh = cat.latest_objects(uploaded.select("bucket", "filename", "timestamp", "uuid")).withColumn("part", _part(parts))
    touched = fresh.select("part").distinct()
    old = buckets.read_buckets(spark, path, OBJECT_SCHEMA, ("part",))
    old = old.join(touched.withColumnRenamed("part", "_part"), F.col("part") == F.col("_part"), "left_semi")
    merged = cat.latest_objects(old.unionByName(fresh).drop("part")).withColumn("part", _part(parts))
    return buckets.replace_buckets(merged.repartition("part"), touched, path, ("part",))


def current_objects(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """G1: the last write of every (bucket, filename), as of a version."""
    return buckets.read_buckets(spark, path, OBJECT_SCHEMA, ("part",), version).drop("part")


# ---- F5 at write time ----------------------------------------------------------

#: Pages of the filter; each has 256 bits in four words. A key sets four bits of one page.
PAGES = 1 << 14
WORDS, HASHES = 4, 4
FILTER_SCHEMA = StructType([StructField("page", IntegerType()), *[StructField(f"w{k}", LongType()) for k in range(WORDS)], StructField("slice", IntegerType())])
#: Slices of the filter that are rewritten or kept as a whole.
SLICES = 4


def _bits(key: str) -> list[Column]:
    """The bits, 0 to 255, that a key sets in its page."""
    h = F.xxhash64(F.lit(1), key)
    return [F.pmod(F.shiftrightunsigned(h, 8 * k), F.lit(64 * WORDS)) for k in range(HASHES)]


def _word(key: str, k: int) -> Column:
    """The key's bits that are in word ``k`` of its page."""
    out = F.lit(0).cast("long")
    for bit in _bits(key):
        bit_in_word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        out = out.bitwiseOR(F.when(F.floor(bit / 64) == k, bit_in_word).otherwise(F.lit(0).cast("long")))
    return out


def _paged(keys: DataFrame, key: str, pages: int) -> DataFrame:
    page = F.pmod(F.xxhash64(F.lit(0), key), F.lit(pages)).cast("int")
    return keys.select(key, page.alias("page"), *[_word(key, k).alias(f"w{k}") for k in range(WORDS)])


def may_hold(spark: SparkSession, path: str, keys: DataFrame, key: str, pages: int = PAGES) -> DataFrame:
    """The ``keys`` that the filter at ``path`` may hold: all that it does, and few others."""
    stored = buckets.read_buckets(spark, path, FILTER_SCHEMA, ("slice",)).drop("slice")
    stored = stored.toDF("_page", *[f"_w{k}" for k in range(WORDS)])
    has_all = F.lit(True)
    for k in range(WORDS):
        has_all = has_all & (F.col(f"w{k}").bitwiseAND(F.col(f"_w{k}")) == F.col(f"w{k}"))
    found = _paged(keys, key, pages).join(stored, F.col("page") == F.col("_page"))
    return found.where(has_all).select(key)


def add_keys(spark: SparkSession, path: str, keys: DataFrame, key: str, pages: int = PAGES) -> None:
    """Take keys into the filter; only the slices that gain bits are rewritten."""
    words = [f"w{k}" for k in range(WORDS)]
    new = _paged(keys, key, pages).groupBy("page").agg(*[F.bit_or(w).alias(w) for w in words])
    new = new.withColumn("slice", F.col("page") % SLICES)
    touched = new.select("slice").distinct()
    old = buckets.read_buckets(spark, path, FILTER_SCHEMA, ("slice",))
    old = old.join(touched.withColumnRenamed("slice", "_slice"), F.col("slice") == F.col("_slice"), "left_semi")
    merged = old.unionByName(new).groupBy("slice", "page").agg(*[F.bit_or(w).alias(w) for w in words])
    buckets.replace_buckets(merged.select(*FILTER_SCHEMA.fieldNames()).repartition("slice"), touched, path, ("slice",))


#: Candidates (40 bytes each) that are broadcast; more are joined by key.
BROADCAST_KEYS = 500_000


def among(stored: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is a candidate. The candidates are counted first;
    as few as they are unless the upload itself was stored before, they go to
    the stored rows, which are not shuffled."""
    candidates = written(candidates, "candidates")
    few = candidates.count() <= BROADCAST_KEYS
    return stored.join(F.broadcast(candidates) if few else candidates, key, "left_semi")


def duplicates_on_write(spark: SparkSession, base: str, upload: DataFrame, upload_id: str, key: str = "uuid") -> DataFrame:
    """F5 for one upload, before its keys are stored under ``base``: keys that
    will then occur more than once, with their count (null keys count as
    none). Its keys are stored under ``upload_id``; a job that runs again
    replaces them and finds the same."""
    own = upload.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if buckets.exists(spark, f"{base}/filter"):
        path = f"{base}/keys"
        others = spark.read.schema(f"{key} string, n long, upload_id string").parquet(path).where(F.col("upload_id") != upload_id)
        candidates = may_hold(spark, f"{base}/filter", own.select(key), key)
        before = among(others, candidates, key).groupBy(key).agg(F.sum("n").alias("before"))
        own_all = own.join(before, key, "left")
    else:
        own_all = own.withColumn("before", F.lit(None).cast("long"))
    total = F.col("n") + F.coalesce(F.col("before"), F.lit(0))
    found = written(own_all.select(key, total.alias("n")).where(F.col("n") > 1), "duplicates")
    own.write.mode("overwrite").parquet(f"{base}/keys/upload_id={upload_id}")
    add_keys(spark, f"{base}/filter", own.select(key), key)
    return found
