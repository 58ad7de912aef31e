"""The record store: commits, compaction, look-ups that skip what they need not read."""

import re

import pytest
from pyspark.sql import functions as F

from tidewater import jobs
from tidewater.functions.records import stable_uuid
from tidewater.operators import ingest
from tidewater.schemas import CDF_SCHEMA
from tidewater.sinks import buckets, store as st, writers
from tidewater.streaming.ingest import start_file_ingest

AT = "2025-01-01 00:00:00"
HEAD = "BaseDateTime,LAT,LON,SOG,Heading\n"
TABLES = ("cdf_data", "upload_summary", "upload_metadata", "file_catalog")


@pytest.fixture()
def store(spark, tmp_path):
    s = str(tmp_path / "store")
    jobs.init_store(spark, s, [(1, "Piracy"), (2, "AIS"), (3, "DMAS")], [(1, "Redicent", 4)])
    return s


def csv_file(tmp_path, name, days, n=3):
    path = tmp_path / name
    path.write_text(HEAD + "".join(f"{d}T00:00:{k:02d},1,{k},11,90\n" for d in days for k in range(n)) + "bad,1,1,1,1\n")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.select("uuid", "file_name", "row_no", "status", "day").collect())


def test_tables_of_an_upload_appear_together(spark, store, tmp_path, monkeypatch):
    path = csv_file(tmp_path, "a.csv", ["2024-01-01"])

    def fail(*a, **k):
        raise RuntimeError("lost")

    for broken in ("write_upload_records", "append_catalog"):
        with monkeypatch.context() as m:
            m.setattr(writers, broken, fail)
            with pytest.raises(RuntimeError):
                jobs.upload(spark, [path], "AIS", store, AT)
        assert st.read_records(spark, store).count() == 0 if broken == "append_catalog" else True
        if broken == "append_catalog":  # the first tables are written, and not to be seen
            assert spark.read.parquet(f"{store}/cdf_data").count() == 4
            assert st.read_committed(spark, store, "cdf_data").count() == st.read_committed(spark, store, "upload_metadata").count() == 0
    for _ in range(2):
        jobs.upload(spark, [path], "AIS", store, AT)
        assert [st.read_committed(spark, store, t).count() for t in TABLES] == [4, 1, 1, 1]
        assert st.read_records(spark, store).count() == 4
    with monkeypatch.context() as m:  # a rerun that fails takes the upload out of sight until it is done
        m.setattr(writers, "append_catalog", fail)
        with pytest.raises(RuntimeError):
            jobs.upload(spark, [path], "AIS", store, AT)
    assert [st.read_committed(spark, store, t).count() for t in TABLES] == [0, 0, 0, 0]


def test_a_stream_batch_that_fails_between_two_writes_is_replayed_once(spark, store, tmp_path, monkeypatch):
    src, sub = spark.read.parquet(f"{store}/source"), spark.read.parquet(f"{store}/sub_source")
    folder, ckpt = tmp_path / "in", str(tmp_path / "ckpt")
    folder.mkdir()
    line = '{"latitude": "1.5", "longitude": "2.5", "speed": "1", "bearing": "4", "course": "5", "sys_trk_no": "7", "struct_update_track_timestamp": {"date_dd": "5", "date_mm": "3", "date_yy": "2024"}}'
    (folder / "a.ndjson").write_text(line + "\n\nnot json\n")

    def run():
        q = start_file_ingest(spark, str(folder), store, "DMAS", source_dim=src, sub_source_dim=sub, checkpoint_location=ckpt, uploaded_at=AT)
        q.awaitTermination(120)

    real, calls = writers.append_catalog, []

    def fails_once(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(writers, "append_catalog", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()
    assert spark.read.parquet(f"{store}/cdf_data").count() == 3 and st.read_records(spark, store).count() == 0
    run()
    run()
    assert len(calls) == 2
    assert [st.read_committed(spark, store, t).count() for t in TABLES] == [3, 1, 1, 1]
    entry = jobs.file_history(spark, store).first()
    assert (entry["filename"], entry["content_type"], entry["source"], entry["timestamp"]) == ("a.ndjson", "application/x-ndjson", "DMAS", AT)
    assert entry["size"] == (folder / "a.ndjson").stat().st_size
    assert entry["uuid"] == spark.read.parquet(f"{store}/cdf_data").first()["file_uuid"]
    meta = jobs.list_upload_metadata(spark, store).first()
    assert (meta["file_name"], meta["source"], meta["record_count"]) == ("a.ndjson", "DMAS", 1)


def data_files(df):
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().count()


def live_files(spark, store):
    data = spark.read.parquet(f"{store}/records/data")
    live = buckets.current_buckets(spark, f"{store}/records", st.STORE_SCHEMA, st.BUCKETS)
    return data.select(*st.BUCKETS, "gen", "_metadata.file_path").join(live, [*st.BUCKETS, "gen"], "left_semi").select("file_path").distinct().count()


def test_compaction_keeps_rows_and_bounds_files(spark, store, tmp_path):
    days = ["2024-01-01", "2024-01-20", "2024-02-03"]
    counts = []
    for k in range(4):
        jobs.upload(spark, [csv_file(tmp_path, f"u{k}.csv", days)], "AIS", store, AT)
        before = rows(st.read_records(spark, store))
        assert jobs.compact(spark, store) == 1 and jobs.compact(spark, store) == 0
        assert rows(st.read_records(spark, store)) == before
        counts.append(live_files(spark, store))
    assert len(before) == 40 and counts[0] == counts[-1] == 3  # two months of saved rows, and the rejects
    path = f"{store}/records"
    assert buckets.last_version(spark, path) == 4
    old = buckets.read_buckets(spark, path, st.STORE_SCHEMA, st.BUCKETS, version=2)
    assert sorted({r.file_name for r in old.collect()}) == ["u0.csv", "u1.csv"] and old.count() == 20


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    jobs.upload(spark, [csv_file(tmp_path, "a.csv", ["2024-01-01", "2024-02-01"])], "AIS", store, AT)
    jobs.compact(spark, store)
    jobs.upload(spark, [csv_file(tmp_path, "b.csv", ["2024-03-01"])], "AIS", store, AT)
    jobs.compact(spark, store)
    gens = {r.month: r.gen[:8] for r in buckets.current_buckets(spark, f"{store}/records", st.STORE_SCHEMA, st.BUCKETS).collect()}
    assert gens == {"2024-01": "00000001", "2024-02": "00000001", "2024-03": "00000002", st.NO_MONTH: "00000002"}


def test_compaction_that_fails_changes_nothing(spark, store, tmp_path, monkeypatch):
    jobs.upload(spark, [csv_file(tmp_path, "a.csv", ["2024-01-01"])], "AIS", store, AT)
    jobs.compact(spark, store)
    path = csv_file(tmp_path, "b.csv", ["2024-01-02"])
    jobs.upload(spark, [path], "AIS", store, AT)
    want = rows(st.read_records(spark, store))

    def fail(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # buckets are committed, the list of runs is not
        real = buckets.replace_buckets
        m.setattr(buckets, "replace_buckets", lambda *a, **k: (real(*a, **k), fail()))
        with pytest.raises(RuntimeError):
            jobs.compact(spark, store)
    assert rows(st.read_records(spark, store)) == want
    assert jobs.compact(spark, store) == 1
    assert rows(st.read_records(spark, store)) == want
    jobs.upload(spark, [path], "AIS", store, AT)  # a rerun of what is compacted
    assert rows(st.read_records(spark, store)) == want
    assert jobs.compact(spark, store) == 1 and rows(st.read_records(spark, store)) == want


def scanned_rows(df):
    """Rows that the Parquet scans of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        if "FileSourceScan" in p.getClass().getName():
            total += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return total


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """60,000 records of 60 files over 30 days, in small row groups."""
    path = str(tmp_path_factory.mktemp("big") / "records")
    k = F.col("id")
    cols = {
        "row_no": k, "file_name": F.concat(F.lit("f"), (k % 60).cast("string")), "feed": F.lit("AIS"), "source_id": F.lit(2),
        "logged_timestamp": F.timestamp_add("DAY", (k % 30).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")), "speed": k.cast("double"),
        "raw_data": F.repeat(F.md5(k.cast("string")), 4), "status": F.lit("saved"), "reject_reason": F.lit(None).cast("string"),
    }
    df = spark.range(60_000).withColumns(cols).withColumns({"uuid": stable_uuid("file_name", "row_no"), "file_uuid": stable_uuid("file_name")})
    for f in CDF_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    st.write_clustered(df.drop("id"), path, row_group_bytes=200_000)
    return spark.read.parquet(path)


def test_look_ups_skip_row_groups(spark, big):
    n = big.count()
    assert n == 60_000
    file_uuid = spark.range(1).select(stable_uuid(F.lit("f7")).alias("u")).first()["u"]
    found = st.of_file(big, file_uuid).select("uuid", "row_no")
    assert found.count() == 1000 and scanned_rows(found) < n / 4
    uuid = found.first()["uuid"]
    one = big.where(F.col("uuid") == uuid).select("row_no")  # uuids are spread: no statistics help, the Bloom filters do
    assert one.count() == 1 and scanned_rows(one) < n / 4
    absent = big.where(F.col("uuid") == "0" * 36).select("row_no")
    assert absent.count() == 0 and scanned_rows(absent) < n / 20
    days = st.of_days(big, "2024-01-03", "2024-01-04").select("row_no")
    assert days.count() == 4000 and scanned_rows(days) < n / 4


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return set(re.findall(r"shuffle_\w+\.\w+", files))


def test_rounds_leave_no_shuffle_files(spark, big, tmp_path):
    """The shuffle files of a round are gone before the next, and the session's setting is as it was."""
    before, old, seen = spark.conf.get(st.CLEANUP_CONF, None), shuffle_files(spark), []
    rec = big.select(*[c for c in big.columns if c not in ("day", "month")])

    def rounds():
        for k in range(3):
            seen.append(shuffle_files(spark) - old)
            yield rec.where(F.col("row_no") % 3 == k)

    st.write_clustered_rounds(rounds(), str(tmp_path / "t"))
    assert seen == [set()] * 3 and shuffle_files(spark) <= old
    st.write_clustered(rec.where("row_no < 9"), str(tmp_path / "plain"))
    assert shuffle_files(spark) - old  # else this test sees nothing
    assert spark.conf.get(st.CLEANUP_CONF, None) == before
    got = spark.read.schema(big.schema).parquet(str(tmp_path / "t"))
    assert got.count() == 60_000 and got.exceptAll(big).isEmpty() and big.exceptAll(got).isEmpty()


def test_each_row_is_in_one_round(spark):
    """Large files are divided, small ones stay whole; null names and numbers and repeated rows are rows like others."""
    rows = [("a", k) for k in range(100)] + [(f"f{k}", j) for k in range(30) for j in range(5)] + [(None, None), (None, 1), ("f1", 1), ("f1", None)]
    raw = spark.createDataFrame(rows, "file_name string, row_no long").coalesce(2)
    rounds = [[tuple(r) for r in raw.where(own).collect()] for own, _ in st.file_rounds(raw, 40)]
    assert sorted(map(str, sum(rounds, []))) == sorted(map(str, rows))
    assert max(map(len, rounds)) < 60 and len(rounds) >= 7
    for name in {n for n, _ in rows} - {"a"}:
        assert sum(name in {n for n, _ in r} for r in rounds) == 1
    assert len(st.file_rounds(raw, 1000)) == 1 and st.file_rounds(raw.limit(0), 10) == []


def test_small_files_have_small_filters(spark, tmp_path):
    """A Bloom filter is as large as its row group's keys need, not 1 MB in a file of 20 rows."""
    df = spark.range(20).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in CDF_SCHEMA.fields if f.name not in ("uuid", "file_uuid", "row_no")],
                                F.col("id").alias("row_no"), F.lit("f").alias("file_name"), F.lit("saved").alias("status"), F.lit(None).cast("string").alias("reject_reason"))
    df = df.withColumns({"uuid": stable_uuid("file_name", "row_no"), "file_uuid": stable_uuid("file_name")})
    st.write_clustered(df, str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*/*/*/*.parquet")
    assert file.stat().st_size < 100_000


def test_look_ups_prune_buckets(spark, store, tmp_path):
    jobs.upload(spark, [csv_file(tmp_path, "a.csv", ["2024-01-01", "2024-02-01", "2024-03-01"], n=20)], "AIS", store, AT)
    jobs.compact(spark, store)
    where = (F.col("status") == "saved") & (F.col("month") == "2024-02")
    got = st.read_records(spark, store, where)
    assert got.count() == 20 and {str(r.day) for r in got.select("day").collect()} == {"2024-02-01"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: ")[1].split("]")[0] + plan.split("PartitionFilters: ")[2].split("]")[0]


def test_ids_that_look_like_numbers_stay_text(spark, store):
    run = st.begin(spark, store, "12e3")
    st.commit(spark, store, "12e3", run, ["x"])
    assert [r.upload_id for r in st.commits(spark, store).collect()] == ["12e3"]
    assert ingest.UPLOAD_TABLES == list(TABLES)
