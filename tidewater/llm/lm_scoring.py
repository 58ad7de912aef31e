"""LM scoring: stupid-backoff scores of every document, from counts of the other documents.

Method: count tables of n-grams partitioned by hash, joined to the n-grams of
the documents, summed per document.  The join is done on packed tables
(``spread.exchange``): each unit of documents asks each hash bucket for the
n-grams it has, with its own counts; the bucket adds the counts up and answers
in the order of the question.  Counts are local before they move, so the most
frequent n-gram costs its bucket one entry for each unit.

N-grams of two and more words go in rounds of their own: one that another
document holds has both its shorter n-grams there too, so after the answers of
the round before only such n-grams are asked for.  The others' counts in the
other documents are 0.  Hashes of a message are sorted and packed without loss;
counts are a bit for "1" and, for the others, a byte or more.

An n-gram is known by ``HASH_BITS`` = 52 bits within a bucket that independent
bits choose.  Of ten million n-grams, as in the bucket of a large corpus, two
share these bits by chance in one bucket of 90; their counts are then added up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import MESSAGE_SCHEMA, exchange, in_units, messages, written
from tidewater.llm.text import Hasher, Words, non_space_bytes, pieces, utf8, window_starts

_SCHEMA = "doc_id long, n_words long, n_top long, n_base long, log_sum double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_top", pa.int64()), ("n_base", pa.int64()), ("log_sum", pa.float64())])


HASH_BITS = 52


def _small(values: np.ndarray) -> bytes:
    """Positive integers: a bit for each that is 1, then the others as a byte (255: see below), then those from 255 on in full."""
    rest = values[values != 1]
    return np.packbits(values == 1).tobytes() + np.minimum(rest, 255).astype(np.uint8).tobytes() + rest[rest >= 255].astype(np.int64).tobytes()


def _unsmall(body: bytes, n: int) -> np.ndarray:
    at = -(-n // 8)
    out = np.unpackbits(np.frombuffer(body, np.uint8, at), count=n).astype(np.int64)
    n_rest = n - int(out.sum())
    rest = np.frombuffer(body, np.uint8, n_rest, at).astype(np.int64)
    rest[rest == 255] = np.frombuffer(body, np.int64, int((rest == 255).sum()), at + n_rest)
    out[out == 0] = rest
    return out


def _pack(hashes: np.ndarray) -> bytes:
    """Ascending hashes of ``HASH_BITS`` bits as Elias-Fano code: the upper ``k`` bits in unary steps, the lower bits as they are."""
    n = len(hashes)
    k = max(1, n.bit_length() - 1)
    upper = np.zeros(n + (1 << k), np.uint8)
    upper[(hashes >> np.uint64(HASH_BITS - k)).astype(np.int64) + np.arange(n)] = 1
    lower = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - HASH_BITS + k :]
    return np.packbits(upper).tobytes() + np.packbits(lower).tobytes()


def _unpack(body: bytes, n: int) -> tuple[np.ndarray, int]:
    """The hashes, and the bytes that they took."""
    k = max(1, n.bit_length() - 1)
    middle = -(-(n + (1 << k)) // 8)
    end = middle + -(-n * (HASH_BITS - k) // 8)
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, middle))) - np.arange(n)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - HASH_BITS + k :] = np.unpackbits(np.frombuffer(body, np.uint8, end - middle, middle), count=n * (HASH_BITS - k)).reshape(n, HASH_BITS - k)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64) | (upper.astype(np.uint64) << np.uint64(HASH_BITS - k)), end


def _split(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece of a unit's texts: the word range of each text, the hash of each word."""
    data, offsets = utf8(rows["text"])
    hasher, table, out = Hasher(), non_space_bytes(), []
    for a, b in pieces(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        out.append((w.bounds, hasher.words(w)))
    return out


def _grams(split: list[tuple[np.ndarray, np.ndarray]], size: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a unit's n-grams of ``size`` words: hash, bucket, position of the last word."""
    hasher, parts, at = Hasher(), [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
    for bounds, each in split:
        starts = window_starts(bounds, size)
        if len(starts):
            high = hasher.windows(each, size, second=True)[starts] >> np.uint64(32)
            bucket = ((high * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
            parts.append((hasher.windows(each, size)[starts] >> np.uint64(64 - HASH_BITS), bucket, starts + (size - 1 + at)))
        at += len(each)
    return *(np.concatenate(x) for x in zip(*parts)),


def _distinct(hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of one of each distinct n-gram in (bucket, hash) order; each n-gram's index there."""
    base = int(buckets.min()) if len(buckets) else 0
    if not len(buckets) or int(buckets.max()) - base < 1 << (64 - HASH_BITS):  # both fit one number
        key = ((buckets - base).astype(np.uint64) << np.uint64(HASH_BITS)) | hashes
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[1:] != key[:-1]
    else:
        order = np.argsort(hashes)
        order = order[np.argsort(buckets[order], kind="stable")]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (buckets[order[1:]] != buckets[order[:-1]])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def _own(index: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """For each n-gram how often its own document has it; what the unit has once needs no sort."""
    own = np.ones(len(index), np.int64)
    often = np.flatnonzero(np.bincount(index)[index] > 1) if len(index) else index
    _, at, counts = np.unique(index[often] * n_docs + docs[often], return_inverse=True, return_counts=True)
    own[often] = counts[at]
    return own


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stupid-backoff log score of every document under the counts of all other documents.

    For each word the longest n-gram of at most ``order`` words that ends in it
    and that other documents hold is taken: its score is its count divided by
    its context's (for a single word: by all words of the other documents),
    times ``alpha`` for each word that was given up.  A word no other document
    holds scores ``alpha ** (words given up + 1)`` divided by all words.

    Result, one row for each input row: doc_id, n_words, n_top (words whose
    longest n-gram, as the place allows, was found), log_score (sum of natural
    logarithms) and mean_log_score, both rounded to 6 places.

    Words are runs of characters other than space and ``\\t\\n\\v\\f\\r``.  Null or
    empty text: no words, log_score 0, mean_log_score null.  Repeated rows are
    documents of their own.  Other columns are ignored.
    """
    units, n_buckets = in_units(docs, id_col, text_col)

    def grams(split, k, by_size):
        """The n-grams of round ``k``, of ``k + 1`` words, that other documents can hold."""
        hashes, buckets, last = _grams(split, k + 1, n_buckets)
        if k:
            held = (by_size[k, last] > 0) & (by_size[k, last - 1] > 0)
            hashes, buckets, last = hashes[held], buckets[held], last[held]
        return hashes, buckets + np.int32(k * n_buckets), last

    def known(split, got, n_rounds):
        """After ``n_rounds`` rounds: counts in the other documents, for the n-gram that ends in each word, by length; words of each text."""
        bodies = dict(zip(got["bucket"].to_pylist(), got["body"].to_pylist()))
        n_words = np.concatenate([np.zeros(0, np.int64), *(np.diff(bounds) for bounds, _ in split)])
        by_size = np.zeros((order + 1, int(n_words.sum())), np.int64)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        for k in range(n_rounds):
            hashes, buckets, last = grams(split, k, by_size)
            first, index = _distinct(hashes, buckets)
            edges = np.searchsorted(buckets[first], np.arange(k * n_buckets, (k + 1) * n_buckets + 1))
            total = np.zeros(len(first), np.int64)
            for b, low, high in zip(range(k * n_buckets, (k + 1) * n_buckets), edges, edges[1:]):
                if low < high:
                    total[low:high] = _unsmall(bodies[b], int(high - low))
            by_size[k + 1, last] = total[index] - _own(index, doc[last], len(n_words))
        return by_size, n_words, doc

    def question(unit, split, k, by_size):
        hashes, buckets, _ = grams(split, k, by_size)
        first, index = _distinct(hashes, buckets)
        sent, count = hashes[first], np.bincount(index, minlength=len(first))
        return messages(unit, buckets[first], (k + 1) * n_buckets, lambda s: np.int64(s.stop - s.start).tobytes() + _pack(sent[s]) + _small(count[s]))

    def ask(unit, rows):
        return question(unit, _split(rows), 0, None)

    def ask_more(k):
        def more(unit, rows, got):
            split = _split(rows)
            return question(unit, split, k, known(split, got, k)[0])

        return more

    def answer(bucket, got):
        hashes, counts = [], []
        for body in got["body"].to_pylist():
            n = int(np.frombuffer(body, np.int64, 1)[0])
            some, end = _unpack(body[8:], n)
            hashes.append(some)
            counts.append(_unsmall(body[8 + end :], n))
        edges = np.cumsum([0, *map(len, hashes)])
        _, index = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)[index]
        bodies = [_small(total[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table([got["unit"], pa.array([bucket] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], schema=MESSAGE_SCHEMA)

    def settle(unit, rows, got):
        by_size, n_words, doc = known(_split(rows), got, order)
        words = int(n_words.sum())
        place = np.arange(words) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        top = np.minimum(place + 1, order)
        level = np.zeros(words, np.int64)
        for size in range(1, order + 1):
            level[(by_size[size] > 0) & (size <= top)] = size
        score = np.log(alpha) * (top - level)  # level 0 has given up one word more
        seen = level > 0
        score[seen] += np.log(by_size[level[seen], np.flatnonzero(seen)])
        deep = np.flatnonzero(level > 1)
        score[deep] -= np.log(by_size[level[deep] - 1, deep - 1])  # the context ends one word before
        n = len(n_words)
        return pa.table(
            [
                rows["id"],
                pa.array(n_words, pa.int64()),
                pa.array(np.bincount(doc[level == top], minlength=n), pa.int64()),
                pa.array(np.bincount(doc[level < 2], minlength=n), pa.int64()),
                pa.array(np.bincount(doc, weights=score, minlength=n), pa.float64()),
            ],
            schema=_ARROW,
        )

    sums = written(exchange(units, ask, answer, settle, _SCHEMA, tuple(ask_more(k) for k in range(1, order))))
    words = sums.agg(F.sum("n_words")).first()[0] or 0
    total = F.col("log_sum") - F.col("n_base") * F.log(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)))
    return sums.select("doc_id", "n_words", "n_top", F.round(total, 6).alias("log_score"), F.round(total / F.nullif(F.col("n_words"), F.lit(0)), 6).alias("mean_log_score"))
