"""Benchmark decontamination: item-sized word windows of a benchmark found in documents.

Method: a prefix-filtered set join.  Each window is a set of shingles; shingles
are ordered by rarity in the documents.  Containment of a whole window needs
every shingle, so the necessary prefix is the single rarest one.  Documents are
joined on prefix shingles; a match must pass the positional bound (the window
starts inside the document), the length bound (and ends there) and the exact
comparison of its words.

Two scans of the documents, one counting shingles and one placing the prefix
shingles.  Both look shingles up in a bit table of fixed size first, so that
only likely ones are shuffled; a benchmark too large for the table makes the
table pass more, never less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import written
from tidewater.llm.text import Hasher, Words, alnum_bytes, ascii_lower, pieces, utf8, window_starts

SHINGLE = 3  # words; windows of fewer words are one shingle
TABLE_BITS = 24  # the bit table has 2**24 bits: 2 MB


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Item rows to windows: item (its row), item_id, window, words, shingles (hashes, in order)."""
    hasher, table, lower = Hasher(), alnum_bytes(), ascii_lower()
    for batch in batches:
        rows = []
        data, offsets = utf8(batch.column(2))
        for item, item_id, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets, offsets[1:]):
            w = Words(lower[data[a:b]], np.array([0, b - a]), table)
            if not len(w):
                continue
            raw = w.data.tobytes()
            words = [raw[s:e].decode() for s, e in zip(w.starts, w.ends)]
            g = min(SHINGLE, len(words))
            shingles = hasher.windows(hasher.words(w), g).view(np.int64).tolist()
            n = min(size, len(words))
            rows += [(item, item_id, k, words[k : k + n], shingles[k : k + n - g + 1]) for k in range(len(words) - n + 1)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item", "item_id", "window", "words", "shingles"])


def _bit_table(shingles: DataFrame) -> np.ndarray:
    """Packed bit table of the hashes in column ``shingle``; at most 2**(TABLE_BITS - 15) rows reach the driver."""
    slot = F.expr(f"shingle & {(1 << TABLE_BITS) - 1}")
    slots = shingles.select(slot.alias("slot")).distinct().withColumn("page", F.expr("slot >> 15"))

    def page(key, rows):
        bits = np.zeros(1 << 15, dtype=bool)
        bits[rows["slot"].to_numpy() & 0x7FFF] = True
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in slots.groupBy("page").applyInArrow(page, "page long, bits binary").collect():
        table[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return table


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _likely(column: pa.Array, table: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """For each piece of texts: its rows, its words, and place and hash of the shingles that the table has."""
    hasher, words, lower = Hasher(), alnum_bytes(), ascii_lower()
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        w = Words(lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], words)
        each = hasher.words(w)
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for g in sizes:
            starts = window_starts(w.bounds, g)
            if len(starts):
                h = hasher.windows(each, g)[starts]
                ok = _in_table(table, h)
                places.append(starts[ok])
                hashes.append(h[ok])
        yield a, b, w, np.concatenate(places), np.concatenate(hashes)


def _shingle_counts(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, n) over all documents, counted in each batch before the shuffle."""

    def count(batches):
        for batch in batches:
            found = np.concatenate([h for *_, h in _likely(batch.column(1), table, sizes)] or [np.zeros(0, np.uint64)])
            values, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    return docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, table: np.ndarray, sizes: list[int], size: int) -> DataFrame:
    """One row for each document, with the places of likely prefix shingles and the words around each."""
    around = pa.list_(pa.struct([("place", pa.int64()), ("shingle", pa.int64()), ("from", pa.int64()), ("words", pa.list_(pa.string()))]))

    def place(batches):
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, w, places, hashes in _likely(batch.column(1), table, sizes):
                n_words[a:b] = w.counts()
                rows = np.searchsorted(w.bounds, places, "right") - 1
                for k, p, h in zip(rows.tolist(), places.tolist(), hashes.view(np.int64).tolist()):
                    low, high = max(p - size + 1, int(w.bounds[k])), min(p + size, int(w.bounds[k + 1]))
                    at = int(w.starts[low])
                    raw = w.data[at : int(w.ends[high - 1])].tobytes()
                    words = [raw[s - at : e - at].decode() for s, e in zip(w.starts[low:high].tolist(), w.ends[low:high].tolist())]
                    base = int(w.bounds[k])
                    found[a + k].append({"place": p - base, "shingle": h, "from": low - base, "words": words})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words), pa.array(found, around)], names=["doc_id", "text_hash", "row", "n_words", "found"])

    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", text_hash.alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(place, "doc_id long, text_hash long, row long, n_words long, found array<struct<place:long,shingle:long,from:long,words:array<string>>>")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Find windows of ``window`` consecutive item words in documents.

    A-Z count as a-z; a word is a run of a-z, 0-9 and characters beyond ASCII.
    An item of fewer words than a window (but not none) is one window.

    Result, one row for each document row: doc_id, text_hash (xxhash64 of the
    text), n_words, n_hit (words inside
    any occurrence), items (ids, as strings, of items with occurring windows,
    sorted) and hits (start and length in words of every occurring window, by
    start; of several from one word the longest).

    Null or empty texts have no words.  Rows of the benchmark are items of
    their own: those of one id all count, whatever their texts; the words of an
    item with a null id are hit, but ``items`` does not list it.  Items without
    words never count.  Rows of one doc_id are documents of
    their own.  Other columns are ignored.  An empty benchmark hits nothing.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    )
    windows = written(items.mapInArrow(lambda batches: _windows(batches, window), "item long, item_id string, window long, words array<string>, shingles array<long>"))
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())

    every = windows.select("item", "window", F.posexplode("shingles").alias("at", "shingle"))
    counts = _shingle_counts(texts, _bit_table(every.select("shingle")), sizes)
    order = F.min(F.struct("n", "shingle", "at")).alias("rarest")
    same = ["item", "window"]  # the item's row, not its id: ids may be null, or repeated with other texts
    prefix = every.join(counts, "shingle").groupBy(*same).agg(order, F.count("*").alias("in_documents"))
    prefix = windows.join(prefix, same).where(F.col("in_documents") >= F.size("shingles"))
    prefix = written(prefix.select("item_id", "words", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("at")))

    found = written(_candidates(texts, _bit_table(prefix.select("shingle")), sizes, window))
    places = found.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    start = F.col("place") - F.col("at")
    pairs = places.withColumnRenamed("words", "around").join(prefix, "shingle")
    inside = (start >= F.col("from")) & (start + F.size("words") <= F.col("n_words"))
    same_words = F.slice("around", (start - F.col("from") + 1).cast("int"), F.size("words")) == F.col("words")
    hits = pairs.where(inside).where(same_words).select("row", start.alias("start"), F.size("words").alias("length"), "item_id")
    by_start = hits.groupBy("row", "start").agg(F.max("length").alias("length"), F.collect_set("item_id").alias("items"))
    by_row = by_start.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    reach = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def cover(acc, h):
        end = F.greatest(acc["to"], h["start"] + h["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["to"], h["start"])).alias("n"), end.alias("to"))

    n_hit = F.aggregate("hits", reach, cover, lambda acc: acc["n"])
    return found.select("row", "doc_id", "text_hash", "n_words").join(by_row, "row", "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:bigint,length:int>>")).alias("hits"),
    )
