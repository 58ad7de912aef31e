"""File sources.

Structured files (CSV, TSV, XLSX) and NDJSON become raw feed frames with
``file_name`` and ``row_no`` (0-based row of the data in its file, as the
reference's row index), every cell as text. Binary files (images, office
documents) come in through the ``binaryFile`` source.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.text import file_extension
from ..sinks.scratch import stored
from .delimited import BROADCAST_SPLITS, frames_by_header, read_delimited

STRUCTURED_SUFFIXES = (".csv", ".tsv", ".xlsx")


def _suffix(path: str) -> str:
    return os.path.splitext(path.lower())[1]


def check_structured(paths) -> str:
    """A1-A3 dispatch on the lower-cased suffix; all paths must agree.
    Anything else raises ValueError before a job starts."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {_suffix(p) for p in paths}
    if len(kinds) != 1 or not kinds <= set(STRUCTURED_SUFFIXES):
        raise ValueError(f"Unsupported file format: {sorted(kinds)}")
    return kinds.pop()


def with_file_row_numbers(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Add ``file_name`` and the exact 0-based position of each row inside
    its file, distributed.

    A file can be split over several tasks, and a task can hold splits of
    several files, so a global sort or a per-file window would be the naive
    way -- and would put a huge file into one task. Instead: each row gets
    ``monotonically_increasing_id`` (stable for a given split on retry); per
    split (file, block start) the smallest id and the row count are
    aggregated -- one small row per split -- and a running sum over the
    splits of a file gives each split's first row number. The split table is
    written, counted and joined back: broadcast up to ``BROADCAST_SPLITS``
    rows, so raw rows are not shuffled; joined by key beyond that.
    """
    if "_file_path" in df.columns:  # a stream selected the metadata already
        df = df.withColumnsRenamed({"_file_name": "file_name", "_file_path": "_fp", "_file_block_start": "_fb"})
        meta = []
    else:
        meta = [F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_fp"),
                F.col("_metadata.file_block_start").alias("_fb")]
    tagged = df.select("*", *meta, F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy("_fp", "_fb").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_fp").orderBy("_fb").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(splits.select("_fp", "_fb", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset")), "splits")
    j = tagged.join(F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits, ["_fp", "_fb"])
    return j.withColumn(name, (F.col("_mid") - F.col("_first") + F.col("_offset")).cast("long")).drop(
        "_fp", "_fb", "_mid", "_first", "_offset")


def read_structured(spark: SparkSession, paths) -> DataFrame:
    """A1-A3: CSV, TSV or XLSX by suffix into a raw feed frame."""
    kind = check_structured(paths)
    if kind == ".csv":
        return read_delimited(spark, paths, ",")
    if kind == ".tsv":
        return read_delimited(spark, paths, "\t")
    from .office import read_xlsx_rows

    return read_xlsx_rows(spark, paths)


def structured_frames(spark: SparkSession, paths) -> list[DataFrame]:
    """A1-A3: a raw feed frame for each header among the files (columns are
    never taken from another file's header), and for workbooks that cannot be read."""
    kind = check_structured(paths)
    if kind == ".xlsx":
        from .office import xlsx_frames

        return xlsx_frames(spark, paths)
    return frames_by_header(spark, paths, "\t" if kind == ".tsv" else ",")


def name_groups(paths) -> list[list[str]]:
    """Paths in groups without two files of one name."""
    groups: list[list[str]] = []
    seen: dict[str, int] = {}
    for path in paths:
        name = os.path.basename(path.rstrip("/"))
        again = seen[name] = seen.get(name, -1) + 1
        groups.extend([] for _ in range(again + 1 - len(groups)))
        groups[again].append(path)
    return groups


def read_ndjson_lines(spark: SparkSession, paths) -> DataFrame:
    """A4: NDJSON as lines (``file_name``, ``row_no``, ``value``); blank and
    broken lines stay so the converter can count and reject them. Line
    breaks are LF, CR LF (X20)."""
    return with_file_row_numbers(spark.read.text(paths)).select("file_name", "row_no", "value")


def read_piracy_csv(spark: SparkSession, paths) -> DataFrame:
    """The piracy incident file (NA cells are handled by the loader)."""
    return read_delimited(spark, paths, ",")


def read_binary(spark: SparkSession, root, pattern: str | None = None) -> DataFrame:
    """Every file under ``root`` (a folder, a file or a list of files)
    with path, name, size, modification time and bytes (``binaryFile``;
    recursive). Selecting without ``content`` never reads the bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(root)
    return df.select(
        "path", F.col("_metadata.file_name").alias("filename"), F.col("length").alias("size"),
        "modificationTime", "content", file_extension(F.col("path")).alias("extension"),
    )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded image headers (width, height, channels, OpenCV mode);
    undecodable files keep a row with width/height -1 so they can be
    rejected instead of silently dropped."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    return df.select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
        F.col("image.mode").alias("cv_mode"),
    )


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A temporary view for SQL text."""
    df.createOrReplaceTempView(name)
    return df


def frame_from_rows(spark: SparkSession, rows, schema=None) -> DataFrame:
    """A10: in-memory rows (dicts or tuples) as a DataFrame, with an explicit
    schema when given (types inferred otherwise). For small, bounded inputs
    such as a dimension table or a test fixture."""
    return spark.createDataFrame(rows, schema) if schema is not None else spark.createDataFrame(rows)
