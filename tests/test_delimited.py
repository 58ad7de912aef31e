"""Delimited files with line breaks in cells: against Python's csv and pandas, at splits smaller than a record."""

import csv
import io
import random

import pandas as pd
import pytest

from tidewater.sources import delimited, files
from tidewater.sources.delimited import Lines, quote_patterns, read_delimited


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells(df):
    cols = [c for c in df.columns if c not in ("file_name", "row_no")]
    return cols, [tuple(r[c] or "" for c in cols) for r in sorted(df.collect(), key=lambda r: (r.file_name, r.row_no))], df


def python_rows(text, sep=","):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r and not (len(r) == 1 and not r[0].strip())]
    return [tuple((r + [""] * len(rows[0]))[: len(rows[0])]) for r in rows[1:]]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def random_file(seed, sep=",", end="\n"):
    g = random.Random(seed)
    cell = lambda: "".join(g.choice(["a", "é", '"', sep, "\n", "\r\n", " ", "x" * 30, "7", "\\"]) for _ in range(g.randrange(0, 9)))
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["id", "A B", "note"])
    for k in range(30):
        w.writerow([k, cell() if g.random() < 0.5 else g.randrange(10**6), cell() if g.random() < 0.3 else "plain"])
        if g.random() < 0.1:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("sep,end", [(",", "\n"), (",", "\r\n"), ("\t", "\n")])
def test_records_at_splits_smaller_than_a_record(spark, small_splits, tmp_path, seed, sep, end):
    text = random_file(seed, sep, end)
    path = write(tmp_path, "f.csv", text)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    cols, got, df = cells(read_delimited(spark, [path], sep))
    assert cols == ["id", "a b", "note"]
    assert got == python_rows(text, sep)
    assert sorted(r.row_no for r in df.collect()) == list(range(30))


def test_one_split_gives_the_same(spark, tmp_path):
    text = random_file(11)
    _, got, _ = cells(read_delimited(spark, [write(tmp_path, "f.csv", text)]))
    assert got == python_rows(text)


def test_more_splits_than_are_broadcast(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "BROADCAST_SPLITS", 0)
    text = random_file(12)
    _, got, _ = cells(read_delimited(spark, [write(tmp_path, "f.csv", text)]))
    assert got == python_rows(text)


def test_header_of_several_lines_over_splits(spark, small_splits, tmp_path):
    text = '"a\n' + "h" * 100 + '\nend",b\n1,2\n"x\ny",4\n'
    cols, got, _ = cells(read_delimited(spark, [write(tmp_path, "f.csv", text)]))
    assert len(cols) == 2 and cols[1] == "b" and got == [("1", "2"), ("x\ny", "4")]


def test_a_stray_quote_costs_one_line(spark, small_splits, tmp_path):
    text = "a,b\n1,2\n3,\"open\n" + "".join(f"{k},{k}\n" for k in range(100, 140))
    _, got, _ = cells(read_delimited(spark, [write(tmp_path, "f.csv", text)]))
    assert got[0] == ("1", "2") and got[1][0] == "3" and got[2:] == [(str(k), str(k)) for k in range(100, 140)]


def test_quotes_inside_unquoted_cells_are_text(spark, tmp_path):
    text = 'a,b\n5" pipe,x\n"q"tail,y\n"dou""ble",z\n,"\n"\n'
    path = write(tmp_path, "f.csv", text)
    _, got, _ = cells(read_delimited(spark, [path]))
    want = [tuple("" if x != x else str(x) for x in r) for r in pd.read_csv(path, dtype=str, keep_default_na=False).itertuples(index=False)]
    assert len(got) == len(want) == 4
    assert got[0] == want[0] == ('5" pipe', "x") and got[2:] == want[2:]


def test_several_headers_and_empty_files(spark, small_splits, tmp_path):
    paths = [write(tmp_path, "a.csv", 'x,y\n1,"p\nq"\n'), write(tmp_path, "b.csv", "﻿y,x\n2,3\n\n4,5"), write(tmp_path, "c.csv", ""), write(tmp_path, "d.csv", "\n\nx,y\n"), write(tmp_path, "e.csv", "X , y\r9,8\r7,6")]
    got = sorted((r.file_name, r.row_no, r.x, r.y) for r in read_delimited(spark, paths).collect())
    assert got == [("a.csv", 0, "1", "p\nq"), ("b.csv", 0, "3", "2"), ("b.csv", 1, "5", "4"), ("e.csv", 0, "9", "8"), ("e.csv", 1, "7", "6")]
    empty = read_delimited(spark, [paths[2]])
    assert empty.count() == 0 and empty.columns == ["file_name", "row_no"]


def state_after(line, state, sep=","):
    """One character at a time: 0 at a cell's start, 1 in an unquoted cell, 2 in quotes, 3 after a quote in quotes."""
    s = 2 if state else 0
    for c in line:
        if s == 0:
            s = 2 if c == '"' else 0 if c == sep else 1
        elif s == 1:
            s = 0 if c == sep else 1
        elif s == 2:
            s = 3 if c == '"' else 2
        else:
            s = 2 if c == '"' else 0 if c == sep else 1
    return s == 2


def test_lines_as_functions_on_the_quote_state():
    import itertools

    import numpy as np
    import pyarrow as pa

    texts = ["".join(t) for n in range(7) for t in itertools.product('a",', repeat=n)]
    lines = Lines(pa.array(texts), ",")
    for begin in (0, 1):
        assert lines.after[begin].tolist() == [state_after(t, begin) for t in texts]
        before, after = lines.states(begin)
        state = bool(begin)
        for k, t in enumerate(texts):
            assert before[k] == state
            state = state_after(t, state)
            assert after[k] == state
    assert len(quote_patterns(";")) == 2 and np.any(lines.after[0])


def test_no_shuffle_of_raw_rows(spark, small_splits, tmp_path):
    """Above the raw scan: no exchange, even where Spark itself would not broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100 * 1024))
    try:
        path = write(tmp_path, "f.csv", "a,b\n" + "1,2\n" * 200)
        for df in (read_delimited(spark, [path]), files.read_ndjson_lines(spark, path)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_upload_keeps_line_breaks_in_cells(spark, small_splits, tmp_path):
    from tidewater import jobs

    store = str(tmp_path / "store")
    jobs.init_store(spark, store, [(2, "AIS")], [(1, "Redicent", 4)])
    path = write(tmp_path, "ais.csv", 'BaseDateTime,LAT,LON,SOG,Heading,VesselName\n2024-01-01T00:00:00,1,2,11,90,"MV ""A""\nsecond line"\n2024-01-01T00:01:00,1,2,12,90,B\n')
    res = jobs.upload(spark, [path], "AIS", store, "2025-01-01 00:00:00")
    s = res.summary.first()
    assert (s["attempted"], s["saved"], s["failed"]) == (2, 2, 0)
    names = {r.row_no: r.vessel_name for r in spark.read.parquet(f"{store}/cdf_data").collect()}
    assert names == {0: 'MV "A"\nsecond line', 1: "B"}
