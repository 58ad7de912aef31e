"""The record store: how converted records are laid out, committed and looked up.

* An upload (or a micro-batch of a stream) writes its records, rejects,
  catalogue and metadata under its own ``upload_id``, and last a row in
  ``commits``. Readers take committed uploads only, so the tables of an upload
  appear together or not at all, and a job that runs again replaces its own.
* ``compact`` moves committed records into the table ``records``: buckets by
  status, source and month (copy on write, see :mod:`.buckets`), rows in the
  order of day, file and row, Bloom filters on the ids. Files are as many as
  the data needs, however many uploads brought it.
* Look-ups prune buckets by source and month, row groups by the day's
  statistics and by the Bloom filters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..operators.converters import record_status
from ..schemas import CDF_SCHEMA
from . import buckets, writers

#: Columns of a stored record beside those of the common record.
_EXTRA = [("file_name", StringType()), ("reject_reason", StringType()), ("day", DateType()), ("upload_id", StringType()),
          ("run", StringType()), ("status", StringType()), ("month", StringType())]
STORE_SCHEMA = StructType([*CDF_SCHEMA.fields, *[StructField(n, t) for n, t in _EXTRA]])
BUCKETS = ("status", "source_id", "month")
CLUSTER = (*BUCKETS, "day", "file_uuid", "row_no")
NO_MONTH = "none"
#: Keys that records are looked up by and that are spread over the row groups.
BLOOM_KEYS = ("file_uuid", "uuid")
#: Sizes that a row group's Bloom filters are tried in: 1 MB, for about 800,000 distinct keys, and halves of it.
BLOOM_SIZES = 12
#: Rows of one round of ``write_clustered_rounds``: what they shuffle, about 200 bytes each, is on disk at once.
ROUND_ROWS = 8 << 20
#: Classes of files by the hash of their names; whole classes go to a round.
FILE_CLASSES = 4096
#: Whether Spark removes the shuffle files of a query when it ends, and not only when the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COMMIT_SCHEMA = "upload_id string, run string, done boolean, tables array<string>"


def _p(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def layout_options(row_group_bytes: int | None = None) -> dict:
    """Writer options. A Bloom filter gets the smallest of several sizes that its row group's keys need."""
    out = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": str(BLOOM_SIZES)}
    for k in BLOOM_KEYS:
        out[f"parquet.bloom.filter.enabled#{k}"] = "true"
    if row_group_bytes:
        out["parquet.block.size"] = str(row_group_bytes)
    return out


def with_layout_columns(records: DataFrame) -> DataFrame:
    """status, day (of the record's time, else its message date) and month."""
    out = records if "status" in records.columns else records.withColumn("status", record_status("reject_reason"))
    day = F.coalesce(F.col("logged_timestamp").cast("date"), F.col("msg_date"))
    out = out.withColumn("day", day)
    return out.withColumn("month", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit(NO_MONTH)))


def clustered(records: DataFrame) -> DataFrame:
    """Rows of a bucket in few tasks, in order: AQE joins small buckets in a
    task and divides large ones, so files have about one size and a source
    and month with a third of all rows is no single task's work.

    A bucket column that the optimizer knows to be constant would drop out of
    the sort; the writer then sorts by bucket alone, and the order is lost."""
    records = records.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in BUCKETS})
    return records.hint("rebalance", *BUCKETS).sortWithinPartitions(*CLUSTER)


def write_clustered(records: DataFrame, path: str, row_group_bytes: int | None = None, mode: str = "errorifexists") -> None:
    """Records once, in the store's layout, as a plain table (no commits)."""
    out = clustered(with_layout_columns(records))
    out.write.mode(mode).options(**layout_options(row_group_bytes)).partitionBy(*BUCKETS).parquet(path)


def write_clustered_rounds(rounds: Iterable[DataFrame], path: str, row_group_bytes: int | None = None) -> None:
    """Records of several frames of one schema in one table. The shuffle files
    of a round go before the next, so the disk holds the table and one round's."""
    mode = "errorifexists"
    for records in rounds:
        with shuffles_removed(records.sparkSession):
            write_clustered(records, path, row_group_bytes, mode)
        mode = "append"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start and end meanwhile leave no shuffle files."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def file_rounds(raw: DataFrame, most_rows: int = ROUND_ROWS) -> list[tuple[Column, int]]:
    """Conditions that deal the rows of a raw feed to rounds of about
    ``most_rows``, each row to one, and the rows of each. A file stays in one
    round where it can, so that rounds share few buckets; a larger one is
    divided by row number."""
    of = F.pmod(F.xxhash64("file_name"), F.lit(FILE_CLASSES)).cast("int")
    with shuffles_removed(raw.sparkSession):
        counts = sorted(raw.groupBy(of.alias("of")).agg(F.count(F.lit(1)).alias("n")).collect())
    ranges: list[list[int]] = []  # first class, last class, rows
    for k, n in counts:
        if ranges and ranges[-1][2] + n <= most_rows:
            ranges[-1][1:] = k, ranges[-1][2] + n
        else:
            ranges.append([k, k, n])
    out = []
    for first, last, n in ranges:
        parts = -(-n // most_rows)
        for j in range(parts):
            own = F.pmod(F.xxhash64("row_no"), F.lit(parts)) == j if parts > 1 else F.lit(True)
            out.append((of.between(first, last) & own, -(-n // parts)))
    return out


# ---- commits -------------------------------------------------------------------

def begin(spark: SparkSession, store: str, upload_id: str) -> str:
    """Start a run of an upload: what an earlier run committed is out of sight from now on."""
    run = uuid.uuid4().hex
    _write_commit(spark, store, upload_id, run, False, [])
    return run


def commit(spark: SparkSession, store: str, upload_id: str, run: str, tables: list[str]) -> None:
    """The last write of a run: its tables appear."""
    _write_commit(spark, store, upload_id, run, True, tables)


def _write_commit(spark: SparkSession, store: str, upload_id: str, run: str, done: bool, tables: list[str]) -> None:
    row = spark.createDataFrame([(upload_id, run, done, tables)], COMMIT_SCHEMA).coalesce(1)
    writers.write_upload(row, _p(store, "commits"), upload_id)


def commits(spark: SparkSession, store: str) -> DataFrame:
    """(upload_id, run) of committed uploads."""
    rows = spark.read.schema(COMMIT_SCHEMA).parquet(_p(store, "commits"))
    return rows.where("done").select("upload_id", "run")


def read_committed(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table of the store, committed uploads only (ids as text, whatever they look like)."""
    fields = [f for f in spark.read.parquet(_p(store, table)).schema.fields if f.name != "upload_id"]
    rows = spark.read.schema(StructType([*fields, StructField("upload_id", StringType())])).parquet(_p(store, table))
    return rows.join(commits(spark, store).select("upload_id"), "upload_id", "left_semi")


# ---- compaction ----------------------------------------------------------------

def _landed(spark: SparkSession, store: str, runs: DataFrame) -> DataFrame:
    """Records as their uploads wrote them, of the given (upload_id, run)s."""
    fields = [f for f in STORE_SCHEMA.fields if f.name not in ("run", "day", "month")]
    rows = spark.read.schema(StructType(fields)).parquet(_p(store, "cdf_data")).join(runs, "upload_id")
    return with_layout_columns(rows).select(*STORE_SCHEMA.fieldNames())


def _compacted_runs(spark: SparkSession, store: str) -> DataFrame:
    if not buckets.exists(spark, _p(store, "records")):
        return spark.createDataFrame([], "upload_id string, run string")
    return spark.read.schema("upload_id string, run string").parquet(_p(store, "records_runs"))


def compact(spark: SparkSession, store: str, row_group_bytes: int | None = None) -> int:
    """Take all committed uploads that are not there yet into ``records``.

    Only buckets that get rows are written; what these hold of runs that were
    replaced goes. A run that fails changes nothing: the buckets' commit is
    the last but one write, and rows count only once ``records_runs`` (the
    last) names their run. Returns the number of uploads taken."""
    pending = commits(spark, store).join(_compacted_runs(spark, store), ["upload_id", "run"], "left_anti")
    n = pending.count()
    if not n:
        return 0
    fresh = _landed(spark, store, pending)
    touched = fresh.select(*BUCKETS).distinct()
    path = _p(store, "records")
    live = commits(spark, store).join(_compacted_runs(spark, store), ["upload_id", "run"], "left_semi")
    names = touched.select(*[F.col(c).alias(f"_{c}") for c in BUCKETS])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BUCKETS]
    old = buckets.read_buckets(spark, path, STORE_SCHEMA, BUCKETS).join(names, same, "left_semi")
    old = old.join(live, ["upload_id", "run"], "left_semi").select(*STORE_SCHEMA.fieldNames())
    buckets.replace_buckets(clustered(old.unionByName(fresh)), touched, path, BUCKETS, layout_options(row_group_bytes))
    pending.coalesce(1).write.mode("append").parquet(_p(store, "records_runs"))
    return n


def read_records(spark: SparkSession, store: str, where: Column | None = None) -> DataFrame:
    """All committed records: the compacted ones, and those of uploads that
    came since. ``where`` is a condition on status, source_id and month."""
    runs, done = commits(spark, store), _compacted_runs(spark, store)
    landed = _landed(spark, store, runs.join(done, ["upload_id", "run"], "left_anti"))
    if where is not None:
        landed = landed.where(where)
    old = buckets.read_buckets(spark, _p(store, "records"), STORE_SCHEMA, BUCKETS, where=where)
    live = runs.join(done, ["upload_id", "run"], "left_semi")
    return old.join(live, ["upload_id", "run"], "left_semi").select(*STORE_SCHEMA.fieldNames()).unionByName(landed)


# ---- look-ups ------------------------------------------------------------------

def of_file(records: DataFrame, file_uuid) -> DataFrame:
    """Saved records of one file: an equality that the Bloom filters of row groups answer."""
    key = file_uuid if isinstance(file_uuid, Column) else F.lit(file_uuid)
    return records.where((F.col("status") == "saved") & (F.col("file_uuid") == key))


def of_days(records: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Saved records of some days: months prune buckets, days prune row groups."""
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    months = F.col("month").between(first_day[:7], last_day[:7])
    return records.where((F.col("status") == "saved") & months & F.col("day").between(first, last))
