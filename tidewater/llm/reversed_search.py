"""Ranked lexical search, reversed: documents stream past an index of the queries.

The items (queries) are few and the documents many, so it is the items' terms
that are inverted: term -> items.  The index goes to every task.  A task hashes
the words of its documents, counts those that are terms of an item, sends the
counts through the index and keeps a bounded heap of the best documents for each
item.  Heaps leave the tasks and are merged in two steps, first those of
neighbouring tasks.  A document that no heap takes never leaves its task.

Weights need the numbers of documents of the corpus, so there are two passes
over the texts: one counts (summed in each task before the shuffle), one scores.

The index that is sent is bounded: items are divided into blocks by hash, of
about ``BLOCK_TERMS`` (item, term) pairs each, and every block has its own
passes.  A block is larger only by what a single item has.  Words are compared
by 64-bit hashes and their length in bytes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.text import Hasher, Words, alnum_bytes, ascii_lower, pieces, utf8

#: (item, term) pairs of an index that is sent to the tasks, on average: at most 64 MB.
BLOCK_TERMS = 2_000_000
#: (document, item) pairs that are scored at once.
CELLS = 4_000_000
#: Tasks whose heaps are merged first.
NEIGHBOURS = 256

_LOWER, _WORDS = ascii_lower(), alnum_bytes()


def _words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[Words, np.ndarray]:
    w = Words(_LOWER[data], offsets, _WORDS)
    return w, hasher.words(w)


@dataclass
class Index:
    """Terms (hash ascending, length in bytes) and the items of each."""

    hashes: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray  # of a term's items, and the end of the last
    items: np.ndarray
    item_ids: pa.Array

    @classmethod
    def of(cls, rows: pa.Table) -> Index:
        """From (item_id, hash, length), one row for each term of an item."""
        coded = rows["item_id"].combine_chunks().dictionary_encode("encode")
        order = np.argsort(rows["hash"].to_numpy().view(np.uint64), kind="stable")
        hashes, first, counts = np.unique(rows["hash"].to_numpy().view(np.uint64)[order], return_index=True, return_counts=True)
        return cls(
            hashes,
            rows["length"].to_numpy()[order][first],
            np.concatenate(([0], np.cumsum(counts))),
            coded.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64),
            coded.dictionary,
        )

    def found(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and the terms that they are."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        is_term = (self.hashes[at] == hashes) & (self.lengths[at] == w.ends - w.starts)
        return np.flatnonzero(is_term), at[is_term]

    def counts(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) of the terms in each text, by text."""
        word, term = self.found(w, hashes)
        key, times = np.unique(w.texts()[word] * len(self.hashes) + term, return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), times


class Heaps:
    """The best ``k`` documents of each item: highest score, then smallest id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, np.int64)  # a score below cannot enter; from 1 on

    def offer(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        able = np.flatnonzero(scores >= np.maximum(self.least[items], 1))
        if len(able) > 4 * self.k * len(self.heaps):  # of many, the best k of each item by score, with ties
            order = able[np.lexsort((-scores[able], items[able]))]
            sorted_items = items[order]
            first = np.searchsorted(sorted_items, sorted_items)
            kth = np.minimum(first + self.k, np.searchsorted(sorted_items, sorted_items, "right")) - 1
            able = order[scores[order] >= scores[order[kth]]]
        for item, score, doc in zip(items[able].tolist(), scores[able].tolist(), docs[able].tolist()):
            i = ids[doc]
            entry = (score, i is not None, -i if i is not None else 0)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def batch(self, item_ids: pa.Array, neighbours: int) -> pa.RecordBatch:
        rows = [(item, -neg if has else None, score) for item, heap in enumerate(self.heaps) for score, has, neg in heap]
        items, ids, scores = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [item_ids.take(pa.array(items, pa.int64())), pa.array([neighbours] * len(rows), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
            names=["item_id", "neighbours", "doc_id", "score"],
        )


def length_part(n_terms: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """``10 + (90 * n * docs) div terms``, exactly."""
    if len(n_terms) and 90 * int(n_terms.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * n * docs // terms for n in n_terms.tolist()], np.int64)
    return 10 + 90 * n_terms * docs // max(terms, 1)


def _score(texts: pa.Array, ids: list, index: Index, weights: np.ndarray, docs: int, terms: int, heaps: Heaps, hasher: Hasher) -> None:
    data, offsets = utf8(texts)
    for a, b in pieces(offsets):
        w, hashes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
        m = length_part(w.counts(), docs, terms)
        text, term, times = index.counts(w, hashes)
        part = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[text]))
        reach = index.starts[term + 1] - index.starts[term]
        cost = np.concatenate(([0], np.cumsum(reach)))[np.searchsorted(text, np.arange(b - a + 1))]
        n_items, at = len(index.item_ids), 0
        while at < b - a:  # as many texts as fit the cells, at least one
            to = max(at + 1, min(b - a, at + CELLS // n_items, int(np.searchsorted(cost, cost[at] + CELLS, "right")) - 1))
            low, high = np.searchsorted(text, [at, to])
            n = reach[low:high]
            place = np.repeat(index.starts[term[low:high]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            cells = np.zeros((to - at) * n_items, np.int64)
            np.add.at(cells, np.repeat((text[low:high] - at) * n_items, n) + index.items[place], np.repeat(part[low:high], n))
            some = np.flatnonzero(cells)
            heaps.offer(some % n_items, cells[some], some // n_items + (a + at), ids)
            at = to


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, hash, length) of the distinct terms of each item; rows of one id are one item."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                w, hashes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                of = batch.column(0).take(pa.array(w.texts() + a))
                yield pa.RecordBatch.from_arrays([of, pa.array(hashes.view(np.int64)), pa.array((w.ends - w.starts).astype(np.int64))], names=["item_id", "hash", "length"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(terms, f"item_id {rows.schema['item_id'].dataType.simpleString()}, hash long, length long").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents of the highest score for each item.

    Terms are runs of letters A-Z (as a-z), a-z, 0-9 and characters beyond
    ASCII.  With N documents that have a term, L terms in all of them, n in the
    document, df documents that hold the term and tf occurrences in this one, a
    term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and the score the
    sum of ``weight * (10**9 * tf div (1000 * tf + 8 * (10 + 90 * n * N div L)))``
    over the item's distinct terms, in whole numbers.

    Result: item_id, rank (from 1), doc_id, score, for scores above 0 only; of
    equal scores the smaller doc_id first, null ids last.  Null or empty texts
    have no terms.  Very long texts are scored whole.  Repeated rows, and rows
    of one doc_id, are documents of their own; rows of one item_id (null
    included) are one item with the terms of all.  Items without a term that
    occurs have no rows.  Other columns are ignored, whatever their names; an
    empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    terms = item_terms(items, item_col, item_text_col)
    kind = terms.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        best = _search_block(rows, Index.of(part.toArrow()), k, kind)
        out = best if out is None else out.unionAll(best)
    return out


def _search_block(rows: DataFrame, index: Index, k: int, kind: str) -> DataFrame:
    schema = f"item_id {kind}, neighbours long, doc_id long, score long"
    if not len(index.item_ids):
        return rows.sparkSession.createDataFrame([], schema).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, df = Hasher(), np.zeros(2, np.int64), np.zeros(len(index.hashes), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in pieces(offsets):
                w, hashes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher)
                total += [int((w.counts() > 0).sum()), len(w)]
                df += np.bincount(index.counts(w, hashes)[1], minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], used))), pa.array(np.concatenate((total, df[used])))], names=["term", "n"])

    sums = rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist()))  # one entry for each term of the block
    n_docs, n_terms = number.get(-2, 0), number.get(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * number.get(t, 0) + 1))) for t in range(len(index.hashes))], np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, heaps = Hasher(), Heaps(len(index.item_ids), k)
        for batch in batches:
            _score(batch.column(1), batch.column(0).to_pylist(), index, weights, n_docs, n_terms, heaps, hasher)
        yield heaps.batch(index.item_ids, TaskContext.get().partitionId() // NEIGHBOURS)

    def best(found: DataFrame, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = best(rows.mapInArrow(scored, schema), "item_id", "neighbours")
    return best(near.drop("rank"), "item_id").select("item_id", "rank", "doc_id", "score")
