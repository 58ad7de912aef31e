"""A training corpus from ``documents``, in five stages.

1. language ID: documents without letters, or of which hardly an n-gram
   belongs to a learned language, go;
2. near-dedup: one document of each group of near copies stays;
3. decontamination: documents with a window of a benchmark item go;
4. secret scans: secrets are replaced by a mark;
5. packing: what is left becomes sequences of 2048 tokens; a text's first line
   is its prompt and bears no loss.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that the one
before kept, and all but the last return the columns of ``docs``.  ``run``
writes each result as Parquet in the shared folder and reads it again, so a
lost executor never costs more than the running stage.

Rows are told apart by doc_id and text.  Null ids and texts pass through the
stages like other rows (a null text has no letters, so the first stage ends
it); an empty table gives an empty result.  Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontamination import decontaminate
from tidewater.llm.language_id import identify, learn
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import pack_documents
from tidewater.llm.queries import PACKING_LIMITS, PACKING_TOKENIZER, tokenizer_path
from tidewater.llm.secrets import base_spans, entropy_spans, redacted
from tidewater.llm.spread import written

#: Texts of at least this many characters go if less of their n-grams belong to their language.
LEAST_COVERAGE, LEAST_CHARS = 0.1, 40


def _same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["of_id"]) & (F.xxhash64(F.coalesce(left["text"], F.lit(""))) == right["of_hash"])


def _unused(docs: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column begins with it."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))
    model = learn(docs.where(learned).select("lang", "text", F.col("doc_id").alias("key")))
    prefix = _unused(docs, "judged_")
    judged = identify(docs, model, keep=tuple(docs.columns), prefix=prefix)
    foreign = (F.col(f"{prefix}coverage") < LEAST_COVERAGE) & (F.length("text") >= LEAST_CHARS)
    return judged.where((F.col(f"{prefix}lang_pred") != "und") & ~foreign).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows, equal in doc_id and text, count as one."""
    first = near_duplicates(docs).where("first").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    return docs.join(first.hint("shuffle_hash"), _same_row(docs, first), "left_semi")  # texts are not sorted


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    return docs.join(hit, _same_row(docs, hit), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [_unused(docs, "scan_") + x for x in ("text", "base", "spans")]
    text, base, spans = map(F.col, names)
    found = docs.withColumn(names[0], F.col("text")).withColumn(names[1], base_spans(text))  # found once, used twice
    found = found.withColumn(names[2], F.concat(base, entropy_spans(text, base)))
    found = found.withColumn("text", redacted(text, spans)).drop(*names)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(PACKING_TOKENIZER), PACKING_LIMITS, prompt_line=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL has no tokenizer, and the first stage learns a model: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir).select(*docs.columns))
    return STAGES[-1][1](spark, docs, sf_dir)
