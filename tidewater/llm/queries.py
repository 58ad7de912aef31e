"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontamination import decontaminate
from tidewater.llm.fingerprints import document_fingerprints
from tidewater.llm.language_id import identify, learn
from tidewater.llm.license_scan import scan_licenses
from tidewater.llm.lm_scoring import stupid_backoff
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import Limits, pack_documents
from tidewater.llm.perspectives import rotate_perspectives
from tidewater.llm.reversed_search import search
from tidewater.llm.secrets import scan_secrets, span_text
from tidewater.llm.substring_dedup import substring_dedup
from tidewater.llm.token_alignment import align_tokens
from tidewater.llm.toxicity import learn_toxicity, score_toxicity

#: File names in the folder of public tokenizers.
PACKING_TOKENIZER = "word_bpe_49k.json"
#: A document's first line is its prompt; a sequence leaves 32 tokens at least to prompts, and holds 32 segments at most.
PACKING_LIMITS = Limits(2048, 32, 2016)
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def _fold(divisor: int):
    """Remainder of the crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # a null id is in no held-out fold
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    model = learn(docs.where(~held_out).select("lang", "text", F.col("doc_id").alias("key")))
    return identify(docs, model, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "coverage")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER), PACKING_LIMITS, prompt_line=True, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_length")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.75, shingle=5)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    # one label for a document: toxic if any of its rows says so
    labels = _table(spark, sf_dir, "labels").where(~held_out).groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("label"))
    model = learn_toxicity(labels, texts=docs.select(F.col("doc_id").alias("key"), "text"))
    out = score_toxicity(docs, model, keep=("doc_id",))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(_table(spark, sf_dir, "documents"), order=3)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document_fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda p: p["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_chat_perspectives": op7_chat_perspectives,
    "op8_secret_scans": op8_secret_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_fingerprints": op10_fingerprints,
    "op11_token_alignment": op11_token_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_reversed_search": op13_reversed_search,
}
