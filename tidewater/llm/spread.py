"""Units of consecutive documents, and the exchange of n-gram tables between them.

Corpus-wide n-gram statistics need every n-gram of every document once.  A row
for each would cost more to move than the text itself, so documents are put
into units (ranges of document ids), and what moves is one packed array for
each (unit, hash bucket): first from the units to the buckets, then the
buckets' answers back to the units.  All steps are Spark shuffles; no array
grows with the corpus.
"""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import CHECKPOINT_CONF, ensure_checkpoint_dir

#: Text bytes of a unit: the corpus / 256, within these limits.  Beyond 8 GB of
#: text units keep their size and their number grows.
LEAST_UNIT_BYTES, MOST_UNIT_BYTES, UNITS = 1 << 20, 32 << 20, 256
#: Quantile ranges of ids; each is cut into equal ranges until there are enough units.
SEGMENTS = 64

BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Module object on which a Python worker keeps its word caches (see ``packing.worker_cache``).
WORD_CACHES = "_tidewater_word_caches"

MESSAGE = "unit int, bucket int, body binary"
MESSAGE_SCHEMA = pa.schema([("unit", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])


def unit_count(docs: DataFrame, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // min(MOST_UNIT_BYTES, max(LEAST_UNIT_BYTES, total // UNITS))))


def in_units(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(unit, id, text) rows and the number of units.

    A larger id never has a smaller unit; null ids are in unit 0.  Unit
    borders are quantiles of the ids (64 ranges, each cut evenly), so units
    hold about equal numbers of documents however the ids are spread.
    """
    units = unit_count(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    segments = min(SEGMENTS, units)
    cuts = -(-units // segments)
    points = rows.approxQuantile("id", [i / segments for i in range(segments + 1)], 0.25 / segments) if units > 1 else []
    lows = sorted({int(x) for x in points[:-1]}) or [0]
    highs = [*lows[1:], int(points[-1]) + 1 if points else 1]
    at_least = F.aggregate(F.lit(lows), F.lit(0), lambda n, low: n + (low <= F.col("id")).cast("int"))
    rows = rows.select(F.greatest(F.coalesce(at_least, F.lit(1)), F.lit(1)).alias("seg"), "id", "text")
    widths = [max(1, -(-(h - low) // cuts)) for low, h in zip(lows, highs)]
    cut = F.expr("(id - element_at(lows, seg)) div element_at(widths, seg)")
    rows = rows.withColumns({"lows": F.lit(lows).cast("array<bigint>"), "widths": F.lit(widths).cast("array<bigint>")})
    cut = F.when(F.col("id").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(cuts - 1), cut)))  # both skip nulls
    unit = ((F.col("seg") - 1) * cuts + cut).cast("int")
    return rows.select(unit.alias("unit"), "id", "text"), len(lows) * cuts


def by_id(table: pa.Table) -> pa.Table:
    """Rows of one unit in the order of documents: id (null first), then text (null first)."""
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def messages(unit: int, buckets: np.ndarray, n_buckets: int, pack: Callable[[slice], bytes]) -> pa.Table:
    """One message for each bucket that occurs in ``buckets`` (sorted ascending)."""
    edges = np.searchsorted(buckets, np.arange(n_buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    return pa.table(
        [
            pa.array(np.full(len(used), unit, np.int32)),
            pa.array(used.astype(np.int32)),
            pa.array([pack(slice(int(edges[b]), int(edges[b + 1]))) for b in used], pa.binary()),
        ],
        schema=MESSAGE_SCHEMA,
    )


def exchange(units: DataFrame, ask: Callable, answer: Callable, settle: Callable, schema: str, then: tuple[Callable, ...] = ()) -> DataFrame:
    """``ask(unit, texts)`` sends messages to buckets, ``answer(bucket, messages)`` sends
    messages to units, ``settle(unit, texts, answers)`` makes the result.

    Each of ``then`` is a further question, ``more(unit, texts, answers)``, asked with
    all answers so far at hand; it must use buckets that no earlier question used."""

    def asked(key, texts):
        return ask(key[0].as_py(), by_id(texts))

    def answered(key, got):
        return answer(key[0].as_py(), got.sort_by("unit"))

    def with_answers(f):
        return lambda key, texts, got: f(key[0].as_py(), by_id(texts), got.sort_by("bucket"))

    # with later questions, answers are dealt by unit once: these and the result read the same shuffle, also in the union
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answers_to(asks: DataFrame) -> DataFrame:
        answers = asks.groupBy("bucket").applyInArrow(answered, MESSAGE)
        return answers.repartition(parts, "unit") if then else answers

    answers = answers_to(units.groupBy("unit").applyInArrow(asked, MESSAGE))
    for more in then:
        asks = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(with_answers(more), MESSAGE)
        answers = answers.unionAll(answers_to(asks))
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(with_answers(settle), schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = ensure_checkpoint_dir(spark)  # one process, as in tests: a folder of its own
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Jobs started meanwhile send their Python stages batches of about ``most_bytes``, unless the session sets a bound of its own."""
    before = spark.conf.get(BATCH_CONF)
    try:
        if before == BATCH_DEFAULT:
            spark.conf.set(BATCH_CONF, str(most_bytes))
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def fresh_worker() -> None:
    """Give back what tasks of other stages left in this Python worker, which Spark uses again: the words
    that packing knows (up to 1.2 million) and memory that Arrow holds for later."""
    if sys.modules.pop(WORD_CACHES, None) is not None:
        gc.collect()
    pa.default_memory_pool().release_unused()
