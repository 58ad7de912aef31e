"""Document fingerprints by content-defined chunking.

Method: a gear hash (the sum of shifted byte values, so it depends on the last
32 bytes only) marks boundaries.  Chunk lengths are normalised: up to the
normal length a boundary must pass a strict mask, beyond it a loose one.  A
fingerprint is the set of chunk digests with their lengths; shares of length
in common measure containment, which an insertion or a shift hardly changes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.spread import by_id, in_units, written
from tidewater.llm.text import Hasher, pieces, utf8

#: Bytes of a chunk.  The least length is the reach of the hash: no boundary depends on bytes before its chunk.
LEAST, NORMAL, MOST = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
_NEVER = 1 << 62
#: Units whose neighbours are found together.
SPAN = 1024
_SCHEMA = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_text", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of ``gear[data[i - j]] << j`` over j < 32, by doubling."""
    h = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, np.uint32)[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step].copy() << np.uint32(step)
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, and where the chunks of each text begin in that list."""
    top = gear_hashes(data) >> np.uint32(32 - STRICT_BITS)
    loose = np.flatnonzero(top < (1 << (STRICT_BITS - LOOSE_BITS)))
    strict = [*(loose[top[loose] == 0] + 1).tolist(), _NEVER]
    loose = [*(loose + 1).tolist(), _NEVER]
    ends: list[int] = []
    first = [0]
    i = j = 0
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while stop - start > LEAST:
            i = bisect_left(strict, start + LEAST, i)
            end = strict[i]
            if end > start + NORMAL:
                j = bisect_left(loose, start + NORMAL + 1, j)
                end = min(loose[j], start + MOST)
            if end >= stop:
                break
            ends.append(end)
            start = end
        if stop > start:
            ends.append(stop)
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first)


def chunk_sets(texts: pa.Array | pa.ChunkedArray) -> list[dict[int, int]]:
    """Chunk digests with their lengths, for each text."""
    data, offsets = utf8(texts)
    hasher, out = Hasher(), []
    for a, b in pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        ends, first = chunk_ends(part, offsets[a : b + 1] - offsets[a])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        digests, lengths = hasher.spans(part, starts, ends).tolist(), (ends - starts).tolist()
        out += [dict(zip(digests[x:y], lengths[x:y])) for x, y in zip(first, first[1:])]
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the common chunks as a share of the smaller set; two empty sets are alike."""
    if not a or not b:
        return float(len(a) == len(b))
    common = sum(a[k] for k in a.keys() & b.keys())
    return common / min(sum(a.values()), sum(b.values()))


def fingerprint_text(chunks: dict[int, int]) -> str:
    return ",".join(f"{k:016x}:{chunks[k]}" for k in sorted(chunks))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of an edited copy, and how alike they are.

    The edited copy ends, instead of its own last ``n_chars // 2`` characters,
    with the first as many (or all) of the next document; after the last comes
    the first.  Documents are ordered by id, then text, nulls first; rows of
    one id, and rows repeated whole, are documents of their own.

    Result, one row for each input row: doc_id, n_chars, edited_text,
    fingerprint and edited_fingerprint (``digest:length`` of each distinct
    chunk, by digest), near_edited and near_next (``likeness`` to the edited
    copy, to the next document).  Null or empty text: no characters, an empty
    fingerprint.  A single document is its own next one.  Very long texts are
    cut into chunks piece by piece, as whole texts.  Other columns, whatever
    their names, are ignored.  An empty table gives an empty result.
    """
    units, _ = in_units(docs, id_col, text_col)
    guests = units.join(_ahead(units), (F.col("unit") == F.col("at")) & F.col("id").eqNullSafe(F.col("first")))
    # rows of one id may be many: each task keeps the least text, so a unit gets one guest
    least = F.min(F.struct(F.col("text").isNotNull().alias("has"), "id", "text")).alias("least")
    guests = guests.groupBy(F.col("before").alias("unit")).agg(least).select("unit", "least.id", "least.text", F.lit(True).alias("guest"))
    rows = units.withColumn("guest", F.lit(False)).unionAll(guests)
    return rows.groupBy("unit").applyInArrow(_fingerprint_unit, _SCHEMA)


def _ahead(units: DataFrame) -> DataFrame:
    """(at, first, before): the id that each unit begins with and the unit before it, the last one before the first.

    A row for each unit, that is for 1 to 32 MB of text.  It is written, so Spark knows its
    size when it chooses between a broadcast and a shuffled join.  Neighbours are found
    within spans of ``SPAN`` units, and over a row for each span at their borders."""
    has = F.struct(F.col("id").isNotNull().alias("has"), "id")
    firsts = units.groupBy("unit").agg(F.min(has).alias("least")).select("unit", F.col("least.id").alias("first"))
    firsts = written(firsts.withColumn("span", F.floor(F.col("unit") / SPAN)))
    in_order, spans = Window.partitionBy("span").orderBy("unit"), Window.partitionBy(F.lit(0)).orderBy("of_span")
    lasts = firsts.groupBy(F.col("span").alias("of_span")).agg(F.max("unit").alias("last"))
    everywhere = spans.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("of_span", F.coalesce(F.lag("last").over(spans), F.max("last").over(everywhere)).alias("before_span"))
    pairs = firsts.withColumn("inside", F.lag("unit").over(in_order)).join(lasts, F.col("span") == F.col("of_span"))
    return written(pairs.select(F.col("unit").alias("at"), "first", F.coalesce("inside", "before_span").alias("before")))


def _fingerprint_unit(rows: pa.Table) -> pa.Table:
    guests = by_id(rows.filter(rows["guest"]))
    own = by_id(rows.filter(pc.invert(rows["guest"])))
    texts = [x or "" for x in pa.concat_tables([own, guests.slice(0, 1)])["text"].to_pylist()]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
    sets, edited_sets = chunk_sets(pa.array(texts, pa.large_string())), chunk_sets(pa.array(edited, pa.large_string()))
    return pa.table(
        [
            own["id"],
            pa.array([len(x) for x in texts[:-1]], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([fingerprint_text(x) for x in sets[:-1]], pa.string()),
            pa.array([fingerprint_text(x) for x in edited_sets], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(sets, edited_sets)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(sets, sets[1:])], pa.float64()),
        ],
        schema=_ARROW,
    )
