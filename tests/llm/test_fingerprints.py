"""Fingerprints through the registered query against a plain version."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa

from tidewater.llm import fingerprints, spread
from tidewater.llm.fingerprints import LEAST, LOOSE_BITS, MOST, NORMAL, STRICT_BITS, chunk_sets, likeness
from tidewater.llm.queries import QUERIES
from tidewater.llm.text import utf8

R = random.Random(5)


def prose(n):
    return " ".join("".join(R.choice("abcdefghijklmnopqrstuvwxyzäß漢") for _ in range(R.randint(1, 9))) for _ in range(n))


LONG = prose(20_000)
DOCS = [(i, prose(R.randint(0, 200))) for i in range(40)]
DOCS += [(None, None), (None, "no id"), (None, "no id"), (7, ""), (7, None), (7, LONG), (7, LONG), (41, LONG + "x"), (42, "x" + LONG)]
DOCS += [((3 << 40) + i, prose(50)) for i in range(20)] + [(9, f"one id {i} " + prose(30)) for i in range(60)]


def plain_chunks(text):
    """Chunks by the definition: at each byte the sum of the gear values of the last 32, shifted by their distance."""
    gear = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, np.uint32).tolist()
    data, out, start = text.encode(), [], 0
    for end in range(1, len(data) + 1):
        size = end - start
        h = sum(gear[data[end - 1 - j]] << j for j in range(min(32, end))) % (1 << 32)
        bits = STRICT_BITS if size <= NORMAL else LOOSE_BITS
        if end == len(data) or size >= MOST or (size >= LEAST and h >> (32 - bits) == 0):
            out.append(data[start:end])
            start = end
    return out


def plain_likeness(a, b):
    a, b = set(plain_chunks(a)), set(plain_chunks(b))
    if not a or not b:
        return float(a == b)
    return sum(map(len, a & b)) / min(sum(map(len, a)), sum(map(len, b)))


def test_chunks_are_those_of_the_definition():
    texts = ["", "a", prose(3000), "z" * 5000, "ab" * 700 + prose(40)]
    for text, got in zip(texts, chunk_sets(pa.array(texts))):
        want = plain_chunks(text)
        assert b"".join(want) == text.encode()
        assert sorted(got.values()) == sorted(len(x) for x in set(want))
    two = chunk_sets(pa.array(texts[2:3] + texts[4:]))
    assert likeness(*two) == plain_likeness(texts[2], texts[4])


def test_registered_query(spark, tmp_path, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, unit string, guest int").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    order = sorted(DOCS, key=key)
    want = collections.Counter()
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]]):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        near = (plain_likeness(a, edited), plain_likeness(a, b)) if len(a) < 10_000 else None
        want[i, len(a), hashlib.sha256(edited.encode()).hexdigest(), near] += 1

    def result():
        got = QUERIES["op10_fingerprints"](spark, str(tmp_path)).collect()
        return collections.Counter(
            (r.doc_id, r.n_chars, r.edited_sha256, (r.near_edited, r.near_next) if r.n_chars < 10_000 else None) for r in got)

    assert result() == want  # one unit
    monkeypatch.setattr(spread, "LEAST_UNIT_BYTES", 1 << 12)  # many units, their neighbours over several spans
    monkeypatch.setattr(fingerprints, "SPAN", 3)
    assert result() == want


def test_all_chunks_of_a_column_are_read():
    parts = pa.chunked_array([["a", None], [], ["bc", "d"]], pa.string())
    data, ends = utf8(parts)
    assert bytes(data) == b"abcd" and ends.tolist() == [0, 1, 1, 3, 4]
    assert utf8(pa.chunked_array([], pa.string()))[1].tolist() == [0]


def test_null_ids_come_first_in_many_units(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST_UNIT_BYTES", 1 << 9)
    units, n = spread.in_units(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", "text")
    got = sorted(((r.id is not None, r.id or 0), r.unit) for r in units.select("id", "unit").collect())
    assert [u for _, u in got] == sorted(u for _, u in got) and got[0] == ((False, 0), 0) and got[-1][1] < n
