"""Kept files opened by uuid, and pages of the history."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from builders import docx, png
from tidewater import jobs
from tidewater.operators import history
from tidewater.plans.registry import QUERIES
from tidewater.schemas import FILE_CATALOG_SCHEMA
from tidewater.sinks import objects

SF = "/root/testdata/sf0.001"


def entries(spark, rows):
    cols = "uuid string, bucket string, filename string, timestamp string, upload_id string, content_type string"
    return spark.createDataFrame([(*r, "text/csv") for r in rows], cols)


def put(spark, path, upload, rows, **kw):
    objects.put_objects(spark.createDataFrame(rows, "uuid string, bucket string, filename string, content binary"), path, upload, **kw)


def test_bytes_come_back_whole_in_chunks(spark, tmp_path):
    path = str(tmp_path / "objects")
    body = os.urandom(10_001)
    put(spark, path, "u0", [("a", "csv", "x.csv", bytearray(body)), ("b", "csv", "empty.csv", bytearray(b"")), ("c", "csv", "one.csv", bytearray(b"1234"))], chunk_bytes=1000)
    put(spark, path, "u1", [("d", "csv", "x.csv", bytearray(b"later"))])
    cat = entries(spark, [("a", "csv", "x.csv", "2024-01-01", "u0"), ("b", "csv", "empty.csv", "2024-01-01", "u0"),
                          ("c", "csv", "one.csv", "2024-01-01", "u0"), ("d", "csv", "x.csv", "2024-01-02", "u1")])
    held = spark.read.parquet(path)
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("nobody",), (None,)], "uuid string")
    got = {}
    for r in objects.open_files(cat, held, wanted).orderBy("chunk").collect():
        got.setdefault((r["uuid"], r["current_uuid"], r["found"], r["size"]), []).append(bytes(r["content"]))
    # "a" was replaced: its name holds the later upload's bytes
    assert {k: b"".join(v) for k, v in got.items()} == {
        ("a", "d", False, 5): b"later", ("b", "b", True, 0): b"", ("c", "c", True, 4): b"1234"}
    before = cat.where("upload_id = 'u0'")
    rows = objects.open_file(before, held, "a").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == body and [r["chunk"] for r in rows] == list(range(11))
    with pytest.raises(LookupError):
        objects.open_file(cat, held, "nobody")
    put(spark, path, "u1", [("d", "csv", "x.csv", bytearray(b"again"))])  # a rerun replaces its own
    again = spark.read.parquet(path)
    assert [bytes(r["content"]) for r in objects.open_file(cat, again, "a").collect()] == [b"again"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_only_partitions_of_located_files_are_read(spark):
    plan = QUERIES["file_bytes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    one = objects.open_file
    path = tempfile.mkdtemp(prefix="tidewater-obj-")
    put(spark, f"{path}/o", "u0", [(f"k{i}", "csv", f"f{i}.csv", bytearray(b"x" * 50)) for i in range(64)])
    cat = entries(spark, [(f"k{i}", "csv", f"f{i}.csv", "2024-01-01", "u0") for i in range(64)])
    df = one(cat, spark.read.parquet(f"{path}/o"), "k7")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(upload_id" in plan and "EqualTo(uuid,k7)" in plan and df.count() == 1


def rows_of(spark, n, run):
    k = F.col("id")
    # a third of the rows have one time; every 50th has none
    at = F.when(k % 50 == 0, None).when(k % 3 == 0, "2024-05-05 00:00:00").otherwise(F.format_string("2024-%02d-01 00:00:00", k % 12 + 1))
    cols = {f.name: F.lit(None).cast(f.dataType) for f in FILE_CATALOG_SCHEMA.fields} | {
        "uuid": F.format_string(f"{run}-%05d", k), "timestamp": at, "size": k}
    return spark.range(n).select(*[c.alias(name) for name, c in cols.items()])


def test_pages_are_the_history(spark, tmp_path):
    path, frames = str(tmp_path / "history"), [rows_of(spark, 900, "r0"), rows_of(spark, 400, "r1")]
    for k, frame in enumerate(frames):
        history.append_history(frame, path, f"r{k}", block_rows=60)
    frames[1].limit(10).withColumn("block", F.lit(0)).write.partitionBy("block").parquet(f"{path}/rows/run=failed")  # a run that did not end
    want = sorted(((r["timestamp"] or "", r["uuid"]) for f in frames for r in f.collect()), reverse=True)
    got, before = [], None
    while True:
        page = [(r["timestamp"] or "", r["uuid"]) for r in history.history_page(spark, path, FILE_CATALOG_SCHEMA, 130, before).collect()]
        got += page
        if len(page) < 130:
            break
        before = page[-1]
    assert got == want
    history.append_history(frames[1], path, "r1", block_rows=100)  # repeated: no row twice
    assert history.history_page(spark, path, FILE_CATALOG_SCHEMA, 5000).count() == 1300
    nothing = str(tmp_path / "empty")
    history.append_history(frames[0].limit(0), nothing, "r0")
    assert history.history_page(spark, nothing, FILE_CATALOG_SCHEMA, 10).count() == 0


def test_a_page_reads_few_blocks(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = rows_of(spark, 6000, "r0").withColumn("timestamp", F.format_string("2024 %06d", F.col("size")))
    history.append_history(rows, path, "r0", block_rows=100)
    page = history.history_page(spark, path, FILE_CATALOG_SCHEMA, 50, ("2024 003000", ""))
    assert [r["size"] for r in page.collect()] == list(range(2999, 2949, -1))
    scan = page._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in scan
    files = rows.sparkSession.read.parquet(f"{path}/rows").select(F.input_file_name()).distinct().count()
    leaves = [x for x in _scans(page) if "dynamicpruning" in x[0]]
    assert files >= 40 and leaves and all(n <= 4 for _, n in leaves)


def _scans(df):
    """(location, files read) of the scans of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        elif p.nodeName().startswith("Scan parquet"):
            out.append((p.toString(), p.metrics().apply("numFiles").value()))
        else:
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_jobs_keep_and_open(spark):
    d, store = tempfile.mkdtemp(prefix="tidewater-up-"), tempfile.mkdtemp(prefix="tidewater-store-")
    text = "MMSI,BaseDateTime,LAT,LON,SOG,Heading\n1,2024-01-01T00:00:00,1,2,11,90\n"
    open(f"{d}/ais.csv", "w").write(text)
    png(f"{d}/a.png")
    docx(f"{d}/r.docx", ["Hello"])
    jobs.init_store(spark, store, [(2, "AIS")], [(1, "Redicent", 4)])
    jobs.upload(spark, [f"{d}/ais.csv"], "AIS", store, "2025-01-02 00:00:00", "text/csv", keep_bytes=True)
    jobs.extract_images(spark, [f"{d}/a.png"], store, "2025-01-03 00:00:00")
    jobs.upload_documents(spark, [f"{d}/r.docx"], store, "2025-01-04 00:00:00")
    for r in jobs.file_history(spark, store).collect():
        got = jobs.open_file(spark, store, r["uuid"]).collect()
        body = b"".join(bytes(c["content"]) for c in got)
        assert hashlib.sha256(body).digest() == hashlib.sha256(open(f"{d}/{r['filename']}", "rb").read()).digest()
        assert got[0]["found"] and got[0]["content_type"] == r["content_type"]
    with pytest.raises(LookupError):
        jobs.open_file(spark, store, "nobody")
    index = jobs.index_history(spark, store)
    first = jobs.file_history_page(spark, index, 2).collect()
    assert [r["filename"] for r in first] == ["r.docx", "a.png"]
    rest = jobs.file_history_page(spark, index, 2, (first[-1]["timestamp"], first[-1]["uuid"])).collect()
    assert [r["filename"] for r in rest] == ["ais.csv"]
