"""Substring dedup: words of repeated fixed-length windows are removed.

Method: Rabin-Karp hashes of every window of ``window`` words; a shuffle to
hash buckets tells which windows occur in more than one place; windows that
have an earlier occurrence are merged into maximal removal intervals.

Hashes: a window is known by 64 bits within a bucket that independent bits
choose, 64 + log2(buckets) bits in all; buckets grow with the corpus.

Hot windows: a unit sends each distinct window once, so a window that a third
of all documents hold costs its bucket one value for each unit.  The text is
shuffled once (both grouped steps reuse that exchange), a window 8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.spread import MESSAGE_SCHEMA, exchange, in_units, messages
from tidewater.llm.text import Hasher, Words, joined_words, non_space_bytes, pieces, utf8, window_starts

SCHEMA = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)


def _windows(texts: pa.ChunkedArray, size: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bucket) of every window of some texts, in order."""
    data, offsets = utf8(texts)
    hasher, table, hashes, buckets = Hasher(), non_space_bytes(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for a, b in pieces(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        each, at = hasher.words(w), window_starts(w.bounds, size)
        hashes.append(hasher.windows(each, size)[at] if len(at) else np.zeros(0, np.uint64))
        high = hasher.windows(each, size, second=True)[at] >> np.uint64(32) if len(at) else np.zeros(0, np.uint64)
        buckets.append(((high * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(buckets)


def _distinct(hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a unit in (bucket, hash) order: position of the first, its bucket, and each window's index."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(buckets[order], kind="stable")]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (buckets[order[1:]] != buckets[order[:-1]])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    first = order[new]
    return first, buckets[first], index


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window which also starts earlier.

    "Earlier" means in a document with a smaller id, or further left in the
    same document; windows are judged on the input.  Words are runs of
    characters other than space and ``\\t\\n\\v\\f\\r``.

    Result, one row for each input row: doc_id, n_words, removed (maximal
    intervals of word positions, end exclusive), kept_text (kept words joined
    by one space).

    Null or empty text: no words, empty kept_text.  Texts shorter than a
    window are kept whole.  Rows of one id count as separate documents in the
    order of their texts; null ids come first.  Other columns are ignored, so
    their names cannot clash.  An empty table gives an empty result.
    """
    units, n_buckets = in_units(docs, id_col, text_col)

    def ask(unit, rows):
        hashes, buckets = _windows(rows["text"], window, n_buckets)
        first, of, _ = _distinct(hashes, buckets)
        sent = hashes[first]
        return messages(unit, of, n_buckets, lambda s: sent[s].tobytes())

    def answer(bucket, got):
        lists = [np.frombuffer(x, np.uint64) for x in got["body"].to_pylist()]
        hashes = np.concatenate(lists)
        order = np.argsort(hashes, kind="stable")  # messages are sorted by unit: the first of a hash is the earliest
        again = np.zeros(len(hashes), dtype=bool)
        again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        edges = np.cumsum([0, *map(len, lists)])
        bits = [again[a:b] for a, b in zip(edges, edges[1:])]
        keep = [i for i, x in enumerate(bits) if x.any()]
        return pa.table(
            [got["unit"].combine_chunks().take(pa.array(keep, pa.int64())), pa.array([bucket] * len(keep), pa.int32()), pa.array([np.packbits(bits[i]).tobytes() for i in keep], pa.binary())],
            schema=MESSAGE_SCHEMA,
        )

    def settle(unit, rows, got):
        hashes, buckets = _windows(rows["text"], window, n_buckets)
        first, of, index = _distinct(hashes, buckets)
        earlier = np.zeros(len(first), dtype=bool)
        edges = np.searchsorted(of, np.arange(n_buckets + 1))
        for b, body in zip(got["bucket"].to_pylist(), got["body"].to_pylist()):
            size = edges[b + 1] - edges[b]
            earlier[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=size).astype(bool)
        removed = earlier[index] if len(index) else np.zeros(0, dtype=bool)
        local = np.ones(len(hashes), dtype=bool)
        local[first] = False
        return _cut(rows, removed | local, window)

    return exchange(units, ask, answer, settle, SCHEMA)


def _cut(rows: pa.Table, removed: np.ndarray, size: int) -> pa.Table:
    """The result rows of one unit; ``removed`` has a flag for each of its windows."""
    data, offsets = utf8(rows["text"])
    table, at, out = non_space_bytes(), 0, []
    for a, b in pieces(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        starts = window_starts(w.bounds, size)
        hit = starts[removed[at : at + len(starts)]]
        at += len(starts)
        depth = np.zeros(len(w) + 1, np.int64)
        depth[hit] += 1
        depth[hit + size] -= 1  # window starts are distinct, so plain indexing adds each once
        gone = np.cumsum(depth[:-1]) > 0
        text = w.texts()
        edge = np.ones(len(w) + 1, dtype=bool)
        edge[1:-1] = (gone[1:] != gone[:-1]) | (text[1:] != text[:-1])
        runs = np.flatnonzero(edge)
        begin, end = runs[:-1], runs[1:]
        begin, end = (begin[gone[begin]], end[gone[begin]]) if len(w) else (begin[:0], end[:0])
        of = text[begin] if len(w) else np.zeros(0, np.int64)
        base = w.bounds[of]
        lists = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=b - a)))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], names=["start", "end"])
        out.append(
            pa.table(
                [rows["id"].combine_chunks()[a:b], pa.array(w.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(lists), spans), joined_words(w, ~gone)],
                schema=_ARROW,
            )
        )
    return pa.concat_tables(out) if out else _ARROW.empty_table()
