"""The corpus pipeline and the registered queries on small tables."""

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm.oracle import ORACLE
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _prose(seed, n=60):
    return " ".join(f"thword{k}ing" for k in np.random.Generator(np.random.PCG64(seed)).integers(0, 9999, n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = {k: _prose(k) for k in range(20)}
    texts[20] = texts[1]  # a copy
    texts[21] = texts[2] + " more"  # a near copy
    texts[22] = _prose(50, 30) + " " + _prose(999, 14) + " end"  # a benchmark passage
    texts[23] = _prose(51) + " password: hunter2hunter2 and so on"
    texts[24] = "12345 --- 678"
    texts[25] = None
    texts[26] = ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, _prose(999, 14))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = set(texts)
    for (name, stage), goes in zip(corpus_pipeline.STAGES, ({24, 25, 26}, {20, 21}, {22}, set())):
        after = stage(spark, docs, folder)
        assert after.dtypes == docs.dtypes, name
        docs = corpus_pipeline.written(after)
        want -= goes
        assert {r.doc_id for r in docs.collect()} == want, name
    changed = {r.doc_id: (r.text, r.n_chars) for r in docs.collect() if r.text != texts[r.doc_id]}
    text = texts[23].replace("password: hunter2hunter2", "[secret]")
    assert changed == {23: (text, len(text))}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == want
    for i in want:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(n for _, n in own) == next(p.doc_tokens for p in pieces if p.doc_id == i)


def test_stages_equal_a_plain_pass(spark, tables):
    """What is left, and with which text, by definition over sets and patterns; repeated rows, null ids, clashing columns."""
    folder, texts = tables
    schema = "doc_id long, text string, lang string, judged_score double, scan_text string, _same string, unit int, n_chars int"
    rows = [(i, t) for i, t in texts.items()] + [(3, texts[3]), (None, texts[7]), (None, _prose(70)), (None, None), (30, _prose(71, 4000) + " api_key=abcdefgh12345678")]
    docs = spark.createDataFrame([(i, t, "en", 0.5, "s", "t", 1, len(t or "")) for i, t in rows], schema)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets, root = [shingles(t) for _, t in kept], list(range(len(kept)))
    for b in range(len(kept)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = root[b], root[a]
                root = [min(old, new) if r in (old, new) else r for r in root]
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    item = _prose(999, 14).split()
    windows = {tuple(item[k : k + 10]) for k in range(5)}
    kept = [(i, t) for i, t in kept if not windows & {tuple(t.split()[k : k + 10]) for k in range(len(t.split()) - 9)}]
    secret = re.compile(r"(?:password|api_key)(?:: |=)[A-Za-z0-9]{8,}")
    want = sorted((i is None, i or 0, secret.sub("[secret]", t)) for i, t in kept)
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == names
    left = docs.collect()
    assert {(r.lang, r.judged_score, r.scan_text, r._same, r.unit) for r in left} == {("en", 0.5, "s", "t", 1)}
    assert all(r.n_chars == len(r.text) for r in left)
    got = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in left})
    assert got == want


def test_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(map(repr, con.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()))


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_native_operator_runs_no_python(spark):
    plan = QUERIES["op8_secret_scans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
