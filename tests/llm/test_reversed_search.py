"""Reversed search against brute force, and the registered query against its SQL."""

import math
import os
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

import tidewater.llm.reversed_search as rs
from tidewater.llm.oracle import ORACLE
from tidewater.llm.queries import op13_reversed_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RNG = np.random.Generator(np.random.PCG64(11))
WORDS = [f"w{i}" for i in range(120)] + ["É", "é", "Straße", "日本", "X1", "x1", "a-b", "c_d"]
SF = "/root/testdata/sf0.01"


def prose(n):
    return " ".join(WORDS[min(len(WORDS) - 1, int(i))] for i in RNG.exponential(25, n))


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in b for b in map(set, (b for _, b in bags))) for t in set().union(*wanted.values())} if wanted else {}
    out = []
    for item, ts in wanted.items():
        found = []
        for i, bag in bags:
            if bag:
                m = 10 + (90 * len(bag) * n_docs) // total
                score = 0
                for t in ts & set(bag):
                    tf = bag.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
                if score > 0:
                    found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


DOCS = [(i, prose(int(RNG.integers(1, 60)))) for i in range(300, 0, -1)]
DOCS += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, None), (900, None), (901, ""), (902, " -_ "), (903, prose(20_000)), *((1000 + k, "w7 w8 w9") for k in range(15))]
ITEMS = [(k, prose(12)) for k in range(30)] + [(40, None), (41, ""), (42, "nowhere"), (43, "W1 w1 w2"), (44, "w3"), (44, "w4"), (None, "w7 w8"), (50, prose(5000))]


def by_rank(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 3, 1) for i, t in DOCS], "doc_id long, text string, rank int, neighbours int").repartition(5)
    return docs, spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, score int")


def test_search_is_brute_force(tables):
    for k in (1, 10):
        got = [tuple(r) for r in rs.search(*tables, k=k).collect()]
        assert by_rank(got) == by_rank(brute(DOCS, ITEMS, k))


def test_blocks_of_items_and_neighbouring_heaps(tables, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_TERMS", 50)
    docs, items = tables
    some = items.where("item_id < 8 or item_id > 39")
    got = [tuple(r) for r in rs.search(docs, some, k=3).collect()]
    assert by_rank(got) == by_rank(brute(DOCS, [x for x in ITEMS if x[0] is not None and (x[0] < 8 or x[0] > 39)], 3))


def test_heaps_keep_the_best_however_they_are_offered(monkeypatch):
    ids = [None, *range(400, 0, -1)]
    scores = RNG.integers(0, 30, (len(ids), 6))
    want = {j: sorted(((-int(s), i is None, i or 0) for s, i in zip(scores[:, j], ids) if s > 0))[:4] for j in range(6)}
    for step in (1, 7, 401):
        heaps = rs.Heaps(6, 4)
        for at in range(0, len(ids), step):
            part = scores[at : at + step]
            doc, item = np.nonzero(part)
            heaps.offer(item, part[doc, item], doc + at, ids)
        assert {j: sorted((-s, not has, -neg) for s, has, neg in h) for j, h in enumerate(heaps.heaps)} == want


def test_cells_bound_what_is_scored_at_once(monkeypatch):
    texts = pa.array([t for _, t in DOCS[:200]])
    hasher = rs.Hasher()
    words = sorted({t for _, x in ITEMS[:20] for t in terms(x)})
    w, hashes = rs._words(*rs.utf8(pa.array(words)), hasher)
    rows = [(k, int(h), len(t.encode())) for k, (_, x) in enumerate(ITEMS[:20]) for t, h in zip(words, hashes.view(np.int64)) if t in terms(x)]
    index = rs.Index.of(pa.table(dict(zip(("item_id", "hash", "length"), map(list, zip(*rows))))))
    got = []
    for cells in (rs.CELLS, 100, 1):
        monkeypatch.setattr(rs, "CELLS", cells)
        heaps = rs.Heaps(len(index.item_ids), 5)
        rs._score(texts, list(range(200)), index, np.arange(1, len(index.hashes) + 1), 200, 5000, heaps, hasher)
        got.append([sorted(h) for h in heaps.heaps])
    assert got[0] == got[1] == got[2] and any(got[0])


def test_length_part_is_exact_beyond_64_bits():
    n = np.array([1, 10**8, 123_456_789], np.int64)
    for docs, total in ((10**11, 5 * 10**13), (3, 7)):
        assert rs.length_part(n, docs, total).tolist() == [10 + int(Fraction(90 * x * docs, total)) for x in n.tolist()]


def test_empty_tables(spark, tables):
    docs, items = tables
    assert rs.search(docs.limit(0), items).count() == 0
    assert rs.search(docs, items.limit(0)).count() == 0
    assert rs.search(docs, items.where("item_id in (40, 41)")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_registered_query_is_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"select item_id, rank, doc_id, score from ({ORACLE['op13_reversed_search']})").fetchall()
    out = op13_reversed_search(spark, SF)
    got = [tuple(r) for r in out.collect()]
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"] and got
    assert sorted(got) == sorted(want)
